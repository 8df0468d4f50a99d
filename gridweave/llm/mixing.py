"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

A source's target over its size is the number of times each of its documents is wanted. Equal rows are one
unit, wanted as often as all of them; a unit's whole copies are taken at once and the fraction of one copy
is rounded. Units meet in pairs: words of probability move from one to the other, in a random direction that keeps both
expectations, until one of the two is in or out for good. A pair keeps its words in total, so only
the last unit of a source can move the source off its target; it is rounded to the nearer side. Chunks of about CHUNK units are
folded in parallel and their residual units meet in the next level: a reduction tree.

The random numbers are hashes of the units and the seed: reruns and reruns of lost tasks agree.

Nulls and odd inputs: a null text has size 0 and is never taken; a null source is a source of its
own, the last; rows equal in doc_id, source and text share their unit's copies evenly, one more for the first
of them where they don't divide; an empty table or one without words gives targets of 0. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stored, small, stored
from .components import HUB, HUBS

#: Weights of the sources in their order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
#: Words wanted in all, as a multiple of all words, and of a source at most.
SHARE, MOST = 1.5, 2.0
#: Units that meet in one fold, about.
CHUNK = 64

#: Bytes of a source's name, about, in a broadcast.
_NAME = 64

WORD = r"[^\x20\x09-\x0D]+"


def unit_name(docs: DataFrame) -> tuple[Column, Column]:
    """128 bits that name a row's unit: rows equal in doc_id, source and text are one."""
    text = F.coalesce(docs["text"], F.lit(""))
    parts = (docs["source"].isNull(), F.coalesce(docs["source"], F.lit("")), docs["doc_id"].isNull(), docs["doc_id"], F.xxhash64(text), F.xxhash64(F.lit(1), text))
    return F.xxhash64(*parts), F.xxhash64(F.lit(2), *parts)


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and the 128-bit name of each row's unit."""
    u1, u2 = unit_name(docs)
    return docs.select(
        docs["doc_id"],
        docs["source"],
        F.regexp_count(F.coalesce(docs["text"], F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        u1.alias("u1"),
        u2.alias("u2"),
    )


def source_targets(units: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, units, target: a row for each source.

    The level at which shares stop at their caps is found in one pass over the sources in the
    order of cap over weight: a source is capped if the level of those from it on exceeds its own.
    Its windows are over a row a source. units: source, size, rows.
    """
    per = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count("*").alias("units"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    per = per.withColumn("edge", F.col("cap") / F.col("weight"))
    order = Window.orderBy("edge", F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    per = per.withColumn("level", (share * F.sum("source_size").over(whole) - before) / after)
    first = F.min(F.when(F.col("level") <= F.col("edge"), F.struct("edge", F.col("source").isNull(), "source", "level"))).over(whole)
    per = per.withColumn("level", first["level"])
    target = F.when(F.col("edge") < F.col("level"), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("weight")))
    return per.select("source", "source_size", "units", F.coalesce(target, F.lit(0.0)).alias("target"))


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / float(1 << 53)


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def _unit(u1, u2, p, w) -> Column:
    return F.struct(u1.alias("u1"), u2.alias("u2"), p.alias("p"), w.alias("w"))


def fold(items: Column, level: int, seed: int) -> Column:
    """(left: unit or null, done: array of (u1, u2, taken)) of a chunk of units met one after the other."""
    none = F.lit(None).cast("struct<u1:bigint,u2:bigint,p:double,w:double>")
    start = F.struct(none.alias("left"), F.lit([]).cast("array<struct<u1:bigint,u2:bigint,taken:int>>").alias("done"))

    def meet(a: Column, b: Column) -> Column:
        """a and b after the transfer: (p of a, p of b), one of them 0 or 1."""
        a_in, a_out = (1 - a["p"]) * a["w"], a["p"] * a["w"]  # words a can take up, give away
        b_in, b_out = (1 - b["p"]) * b["w"], b["p"] * b["w"]
        to_a, to_b = F.least(a_in, b_out), F.least(a_out, b_in)
        up = uniform(F.lit(seed), F.lit(level), a["u1"], b["u1"]) * (to_a + to_b) < to_b
        pa = F.when(up, F.when(a_in <= b_out, 1.0).otherwise(a["p"] + b_out / a["w"])).otherwise(F.when(a_out <= b_in, 0.0).otherwise(a["p"] - b_in / a["w"]))
        pb = F.when(up, F.when(b_out <= a_in, 0.0).otherwise(b["p"] - a_in / b["w"])).otherwise(F.when(b_in <= a_out, 1.0).otherwise(b["p"] + a_out / b["w"]))
        return F.struct(pa.alias("a"), pb.alias("b"))

    def step(s: Column, e: Column) -> Column:
        def after(m: Column) -> Column:
            a_done, b_done = (m["a"] <= 0) | (m["a"] >= 1), (m["b"] <= 0) | (m["b"] >= 1)
            settle = lambda x, p: F.struct(x["u1"].alias("u1"), x["u2"].alias("u2"), p.cast("int").alias("taken"))
            fresh = F.filter(
                F.array(F.when(a_done, settle(s["left"], m["a"])), F.when(b_done, settle(e, m["b"]))), lambda x: x.isNotNull()
            )
            rest = F.when(~a_done, _unit(s["left"]["u1"], s["left"]["u2"], m["a"], s["left"]["w"])).when(~b_done, _unit(e["u1"], e["u2"], m["b"], e["w"]))
            return F.struct(rest.alias("left"), F.concat(s["done"], fresh).alias("done"))

        return F.when(s["left"].isNull(), F.struct(e.alias("left"), s["done"].alias("done"))).otherwise(_let(meet(s["left"], e), after))

    return F.aggregate(items, start, step)


def rounded(units: DataFrame, sources: DataFrame, n_sources: int, seed: int = 0) -> DataFrame:
    """u1, u2, taken (0 or 1): whether a unit has one copy more than the whole ones; stored.

    units: source, u1, u2, size (of one row), rows.
    """
    wanted = sources.select(F.col("source").alias("s"), (F.col("target") / F.col("source_size")).alias("times"), "units").filter("source_size > 0")
    units = units.filter("size > 0").join(small(wanted, n_sources, _NAME * n_sources), F.col("source").eqNullSafe(F.col("s")))
    wish = F.col("times") * F.col("rows")
    units = units.select("source", "u1", "u2", (wish - F.floor(wish)).alias("p"), F.col("size").cast("double").alias("w"), F.col("units").alias("n")).filter("p > 0")
    most = sources.agg(F.max("units")).head()[0] or 0
    out, level, spent = [], 0, []
    while True:
        chunks = F.ceil(F.col("n") / CHUNK)
        bucket = F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "u1", "u2"), chunks)
        # the largest first: small ones settle them, and the unit that is left over is a small one
        met = units.groupBy("source", bucket.alias("bucket")).agg(
            F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("w", "u1", "u2", "p")), asc=False).alias("items")
        )
        items = F.transform("items", lambda x: _unit(x["u1"], x["u2"], x["p"], x["w"]))
        met = stored(met.select("source", F.ceil(F.col("n") / CHUNK).alias("n"), fold(items, level, seed).alias("f")), "mix")
        spent.append(met)
        out.append(met.select(F.inline("f.done")))
        left = met.filter("f.left is not null").select("source", "f.left.u1", "f.left.u2", "f.left.p", "f.left.w", "n")
        if most <= CHUNK:
            last = (F.col("p") >= 0.5).cast("int")  # nearest to the target
            out.append(left.select("u1", "u2", last.alias("taken")))
            break
        units, level, most = left, level + 1, -(-most // CHUNK)
    decided = out[0]
    for part in out[1:]:
        decided = decided.unionByName(part)
    decided = stored(decided, "mixed")
    drop_stored(*spent)
    return decided


def _nth(rows: DataFrame, repeated: DataFrame, n_repeated: int) -> DataFrame:
    """rows (with u1, u2) and `nth`: a row's number, from 0, among those of its unit.

    Only units of several rows are numbered, in each partition of the scan by itself and from there on by the
    partitions' counts, so a unit that fills a third of the table is met by no task as a whole.
    """
    if not n_repeated:
        return rows.withColumn("__gw_nth", F.lit(0).cast("long"))
    named = rows.withColumn("__gw_part", F.spark_partition_id())
    names = repeated.select(F.col("u1").alias("__gw_r1"), F.col("u2").alias("__gw_r2"))
    named = named.join(small(names, n_repeated), (F.col("u1") == F.col("__gw_r1")) & (F.col("u2") == F.col("__gw_r2")), "left")
    single = named.filter("__gw_r1 is null").withColumn("__gw_nth", F.lit(0).cast("long"))
    several = named.filter("__gw_r1 is not null")
    key = ["u1", "u2", "__gw_part"]
    before = Window.partitionBy("u1", "u2").orderBy("__gw_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = several.groupBy(*key).agg(F.count("*").alias("__gw_n")).withColumn("__gw_before", F.coalesce(F.sum("__gw_n").over(before), F.lit(0)))
    own = F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0))) - 1
    several = several.withColumn("__gw_own", own).join(counts, key).withColumn("__gw_nth", F.col("__gw_before") + F.col("__gw_own"))
    names = [*rows.columns, "__gw_nth"]
    return single.select(*names).union(several.select(*names))


def decided(rows: DataFrame, seed: int) -> tuple[DataFrame, DataFrame, int]:
    """(u1, u2, rows, copies in all: of every unit that is wanted, stored; sources, stored; number of sources)."""
    units = stored(rows.groupBy("source", "u1", "u2").agg(F.max("size").alias("size"), F.count("*").alias("rows")), "units")
    sources = stored(source_targets(units), "sources")
    n = sources.count()
    more = rounded(units, sources, n, seed)
    per = sources.select(F.col("source").alias("s"), "source_size", "target")
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    out = units.filter("size > 0").join(small(per, n, _NAME * n), F.col("source").eqNullSafe(F.col("s"))).join(more, ["u1", "u2"], "left")
    out = stored(out.select("u1", "u2", "rows", (F.floor(times * F.col("rows")) + F.coalesce("taken", F.lit(0))).alias("all")), "decided")
    drop_stored(units, more)
    return out, sources, n


def _copies(rows: DataFrame, choice: DataFrame) -> DataFrame:
    """rows (with u1, u2) and `__gw_copies` of each: its even part of its unit's copies."""
    repeated = choice.filter("rows > 1")
    n = repeated.count()
    per = choice.select(F.col("u1").alias("__gw_u1"), F.col("u2").alias("__gw_u2"), F.col("rows").alias("__gw_rows"), F.col("all").alias("__gw_all"))
    same = (F.col("u1") == F.col("__gw_u1")) & (F.col("u2") == F.col("__gw_u2"))
    numbered, units, most = _nth(rows, repeated, n), *choice.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).head()
    hinted = small(per, units)
    if hinted is not per:
        joined = numbered.join(hinted, same, "left")
    else:  # units of many rows, of which there are few, are broadcast; the rest meet by a shuffle without a hot key
        hub = F.col("__gw_rows") > max(HUB, most // HUBS)
        met = numbered.join(F.broadcast(per.filter(hub)), same, "left")
        rest = met.filter("__gw_u1 is null").select(*numbered.columns).join(per.filter(~hub), same, "left")
        joined = met.filter("__gw_u1 is not null").unionByName(rest)
    whole = F.floor(F.col("__gw_all") / F.col("__gw_rows"))
    copies = whole + (F.col("__gw_nth") < F.col("__gw_all") - whole * F.col("__gw_rows")).cast("long")
    return joined.withColumn("__gw_copies", F.coalesce(copies, F.lit(0)).cast("int")).drop("__gw_u1", "__gw_u2", "__gw_rows", "__gw_all", "__gw_nth")


def mixed(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken and the unit's name (u1, u2) of every row of docs."""
    rows = stored(sized(docs), "sizes")
    choice, sources, n = decided(rows, seed)
    per = sources.select(F.col("source").alias("s"), "source_size", "target")
    out = _copies(rows, choice).join(small(per, n, _NAME * n), F.col("source").eqNullSafe(F.col("s"))).withColumnRenamed("__gw_copies", "copies")
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), "u1", "u2")


def mix_documents(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The rows of docs as often as the mix takes them, with their own columns."""
    rows = stored(sized(docs), "sizes")
    choice, sources, _ = decided(rows, seed)
    drop_stored(rows, sources)
    names = docs.columns
    u1, u2 = unit_name(docs)
    # the rows' own columns travel as one, so that none of their names clashes
    named = docs.select(F.struct(*docs.columns).alias("__gw_row"), u1.alias("u1"), u2.alias("u2"))
    kept = _copies(named, choice).filter("__gw_copies > 0")
    return kept.select("__gw_row", F.explode(F.sequence(F.lit(1), F.col("__gw_copies"))).alias("__gw_copy")).select(*(F.col("__gw_row")[c].alias(c) for c in names))
