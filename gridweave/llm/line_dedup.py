r"""Line dedup over a distributed suffix array of line ids, in DataFrame operations only.

The lines of all documents that hold a character other than ASCII white space form one sequence, by
ascending doc_id (null ids last) and place, with a gap after each document.

Up: prefix doubling ranks the prefixes of 1, 2, 4, ... lines of every suffix. A level's names number
the pairs of names of the level below in their order, so positions in the order of names are the
suffix array. Only prefixes of two or more suffixes go on, so a level holds repeated text alone, and
doubling ends when no run of twice the length repeats.

Down: longest-common-prefix intervals are found by halving. An interval at first holds suffixes that
share 2**k lines, of which no two share twice as many; it has its first suffix, and the
others each have an earlier copy of those lines. Halving splits it by the names of the next 2**(k-1) lines,
then 2**(k-2), and so on: of suffixes that share them, all but the first go to a longer interval, and the
first ones stay, to be split by the next half. Each suffix but an interval's first is thus in
one interval at a time, and when the half is one line the interval's lines are the longest run from it on that has
an earlier copy.

A maximal run is one that no run from an earlier line of the document reaches the end of. Later copies of
maximal runs with at least `min_chars` characters in all (line ends not counted) are deleted. Blank lines are
kept; they neither break a run nor belong to one.

Every step is a grouped minimum, counted with map-side partial counts, and an equi-join back to it: a line that
is a third of all lines is met by no task as a whole.

Nulls and odd inputs: a null text is an empty text, has no lines and stays null. Rows that are equal
in doc_id and text are one document and lose the same lines; equal texts under different ids are
copies. An empty table gives no rows. Columns other than doc_id and text pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stored, small, stored

#: Characters of a repeated run, at least, for its later copies to go.
MIN_CHARS = 40

_BLANK = r"^[\x20\x09-\x0D]*$"
_KEYS = ("doc_id", "t1", "t2")


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _text_keys(docs: DataFrame) -> dict[str, Column]:
    text = F.coalesce(docs["text"], F.lit(""))
    return {"t1": F.xxhash64(text), "t2": F.xxhash64(F.lit(1), text)}


def _shortest(chars: Column, at: Column, most: int) -> Column:
    """Lines of the shortest run of `most` characters or more from line `at` on, or null."""
    near = F.slice(chars, at + 1, F.lit(most))
    start = F.struct(F.lit(0).alias("chars"), F.lit(0).alias("lines"))
    more = lambda s, c: F.when(s["chars"] >= most, s).otherwise(F.struct((s["chars"] + c).alias("chars"), (s["lines"] + 1).alias("lines")))
    got = F.aggregate(near, start, more)
    return F.when(got["chars"] >= most, got["lines"])


def numbered(keys: DataFrame) -> DataFrame:
    """keys with `base`, the place of a document's first line: lines and a gap of all before it, by partial sums; stored."""
    order = [F.col("doc_id").asc_nulls_last(), "t1", "t2"]
    sorted_ = keys.repartitionByRange(*order).sortWithinPartitions(*order)
    keys = stored(sorted_.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("number")), "order")
    own = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    parts = keys.groupBy("part").agg(F.sum(F.col("n_lines") + 1).alias("all")).select("part", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("start"))
    base = F.col("start") + F.coalesce(F.sum(F.col("n_lines") + 1).over(own), F.lit(0))
    out = stored(keys.join(F.broadcast(parts), "part").select(*_KEYS, base.alias("base")), "bases")
    drop_stored(keys)
    return out


def line_table(docs: DataFrame, min_chars: int) -> tuple[DataFrame, DataFrame]:
    """(lines: pos, base, h1, h2, ahead: the lines of the shortest run of min_chars; documents: key and base). Both are stored."""
    text = F.coalesce(docs["text"], F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: ~x.rlike(_BLANK))
    each = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(1), x).alias("h2"), F.length(x).alias("chars")))
    compact = stored(docs.select(docs["doc_id"], *(v.alias(k) for k, v in _text_keys(docs).items()), each.alias("lines")).filter(F.size("lines") > 0).withColumn("n_lines", F.size("lines").cast("long")), "compact")
    keys = numbered(compact.select(*_KEYS, "n_lines").distinct())
    n = keys.count()
    if n != compact.count():
        compact = compact.dropDuplicates(list(_KEYS))
    known = keys.select(F.col("doc_id").alias("k0"), F.col("t1").alias("k1"), F.col("t2").alias("k2"), "base")
    joined = compact.join(small(known, n), F.col("doc_id").eqNullSafe(F.col("k0")) & (F.col("t1") == F.col("k1")) & (F.col("t2") == F.col("k2")))

    def measured(chars: Column) -> Column:
        def one(x: Column, at: Column) -> Column:
            ahead = F.when(x["chars"] >= min_chars, 1).otherwise(_shortest(chars, at, min_chars))
            return F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"), ahead.alias("ahead"))

        return F.transform("lines", one)

    chars = F.transform("lines", lambda x: x["chars"])
    out = joined.select("base", F.posexplode(_let(chars, measured)).alias("at", "x"))
    table = stored(out.select((F.col("base") + F.col("at")).alias("pos"), "base", "x.*"), "lines")
    drop_stored(compact)
    return table, keys


def _level(rows: DataFrame, by: list[str], *more: str) -> tuple[DataFrame, int]:
    """(pos, name, first of the rows whose `by` repeats, and its rows). Names number the values of `by` in their order."""
    groups = stored(rows.groupBy(*by).agg(F.min("pos").alias("first"), F.count("*").alias("n")).filter("n > 1"), "groups")
    n, members = groups.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).head()
    ranked = groups.repartitionByRange(*by).sortWithinPartitions(*by).select(*by, "first", F.monotonically_increasing_id().alias("name"))
    level = stored(rows.join(small(ranked, n), by).select("pos", "name", "first", *more), "level")
    drop_stored(groups)
    return level, members


def suffix_levels(lines: DataFrame) -> list[tuple[DataFrame, int]]:
    """Level k, and its rows: pos, name, first of the suffixes whose first 2**k lines repeat; `name` is their rank. Level 0 has
    base and ahead as well. All are stored; the last that holds anything ends the list."""
    levels = [_level(lines, ["h1", "h2"], "base", "ahead")]
    while levels[-1][1]:
        level, n = levels[-1]
        width = 1 << (len(levels) - 1)
        after = level.select((F.col("pos") - width).alias("pos"), F.col("name").alias("name2"))
        levels.append(_level(level.select("pos", F.col("name").alias("name1")).join(small(after, n), "pos"), ["name1", "name2"]))
    drop_stored(levels.pop()[0])
    return levels


def earlier_copies(levels: list[tuple[DataFrame, int]]) -> DataFrame:
    """pos, first, m: m lines from pos on have an earlier copy at `first`, and m + 1 lines have none; of all such pos. Stored."""
    active, above, n_above = None, None, 0
    for k in range(len(levels) - 1, -1, -1):
        level, n = levels[k]
        begun = level.filter("pos <> first").select("pos", "first", F.lit(1 << k).cast("long").alias("m"))
        if above is not None:  # the others are in an interval of more lines
            begun = begun.join(small(above.filter("pos <> first").select("pos"), n_above), "pos", "left_anti")
        active = begun if active is None else active.union(begun)
        above, n_above = level, n
        if k:
            active = _halved(active, *levels[k - 1], 1 << (k - 1))
    return stored(active, "runs")


def _halved(active: DataFrame, level: DataFrame, n: int, half: int) -> DataFrame:
    """Intervals split by the names of their next `half` lines; stored."""
    active = active.select("pos", "first", "m")
    every = active.union(active.select(F.col("first").alias("pos"), "first", "m").distinct())
    names = level.select(F.col("pos").alias("next"), "name")
    named = stored(every.join(small(names, n), F.col("pos") + F.col("m") == F.col("next"), "left").select("pos", "first", "m", "name"), "named")
    groups = stored(named.filter("name is not null").groupBy("first", "m", "name").agg(F.min("pos").alias("own"), F.count("*").alias("n")).filter("n > 1").drop("n"), "halves")
    found = named.join(small(groups, groups.count()), ["first", "m", "name"], "left")
    longer = F.coalesce(F.col("pos") != F.col("own"), F.lit(False))
    first, m = F.when(longer, F.col("own")).otherwise(F.col("first")), F.when(longer, F.col("m") + half).otherwise(F.col("m"))
    out = stored(found.filter("pos <> first").select("pos", first.alias("first"), m.alias("m")), "intervals")
    drop_stored(named, groups)
    return out


def maximal_runs(lines: DataFrame) -> DataFrame:
    """base, pos, first, m, fresh: the maximal runs of min_chars or more characters that have an earlier copy, at `first`; `fresh` is
    the first of its lines that no maximal run before it in the document has. Stored."""
    levels = suffix_levels(lines)
    if not levels:
        return lines.limit(0).selectExpr("base", "pos", "pos as first", "pos as m", "pos as fresh")
    found = earlier_copies(levels)
    own = levels[0][0].select("pos", "base", "ahead").filter("ahead is not null")
    runs = own.join(small(found, levels[0][1]), "pos").filter("m >= ahead")
    before = Window.partitionBy("base").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("reached", F.max(F.col("pos") + F.col("m")).over(before))
    runs = runs.filter("reached is null or pos + m > reached")
    out = stored(runs.select("base", "pos", "first", "m", F.greatest("pos", "reached").alias("fresh")), "maximal")
    drop_stored(found, *(level for level, _ in levels))
    return out


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with the later copies gone from `text`, and __gw_lines, __gw_gone: its lines that aren't blank, and those gone."""
    lines, keys = line_table(docs, min_chars)
    runs = maximal_runs(lines)
    cuts = runs.groupBy("base").agg(F.flatten(F.collect_list(F.sequence(F.col("fresh") - F.col("base"), F.col("pos") + F.col("m") - 1 - F.col("base")))).alias("__gw_at"))
    cuts = cuts.withColumn("__gw_at", F.transform("__gw_at", lambda x: x.cast("int"))).withColumnRenamed("base", "b")
    per = cuts.join(keys, F.col("base") == F.col("b")).select(F.col("doc_id").alias("__gw_id"), F.col("t1").alias("__gw_t1"), F.col("t2").alias("__gw_t2"), "__gw_at")
    per = stored(per, "cuts")
    n_cut, n_gone = per.agg(F.count("*"), F.coalesce(F.sum(F.size("__gw_at")), F.lit(0))).head()
    drop_stored(lines, keys, runs)
    own = {f"__gw_{k}": v for k, v in _text_keys(docs).items()}
    named = docs.withColumns({"__gw_k1": own["__gw_t1"], "__gw_k2": own["__gw_t2"]})
    joined = named.join(
        small(per, n_cut, 4 * n_gone),
        F.col("doc_id").eqNullSafe(F.col("__gw_id")) & (F.col("__gw_k1") == F.col("__gw_t1")) & (F.col("__gw_k2") == F.col("__gw_t2")),
        "left",
    )

    def cut(parts: Column) -> Column:
        every = F.sequence(F.lit(0), F.size(parts) - 1)
        used = F.filter(every, lambda i: ~parts[i].rlike(_BLANK))
        return _let(used, lambda u: F.array_join(F.transform(F.array_except(every, F.transform("__gw_at", lambda j: u[j])), lambda i: parts[i]), "\n"))

    text = F.when(F.col("__gw_at").isNull(), F.col("text")).otherwise(_let(F.split("text", "\n"), cut))
    count = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: ~x.rlike(_BLANK)))
    out = {"text": text, "__gw_lines": count.cast("long"), "__gw_gone": F.coalesce(F.size("__gw_at"), F.lit(0)).cast("long")}
    return joined.withColumns(out).select(*docs.columns, "__gw_lines", "__gw_gone")


def drop_emptied(deduped: DataFrame) -> DataFrame:
    """Without the documents that lost every line, and with the columns of documents alone."""
    return deduped.filter((F.col("__gw_gone") == 0) | (F.col("__gw_gone") < F.col("__gw_lines"))).drop("__gw_lines", "__gw_gone")


def oracle_ctes(source: str = "documents", min_chars: int = MIN_CHARS) -> str:
    """DuckDB: CTE `deduped` (doc_id, n_lines, n_removed, text) over a table with unique doc_ids."""
    return rf"""
parts AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM {source}),
used AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS j, sum(length(line)) OVER (PARTITION BY doc_id ORDER BY i) AS chars
         FROM parts WHERE NOT regexp_full_match(line, '[\x20\x09-\x0D]*')),
ahead AS (SELECT a.doc_id, a.j AS first, min(b.j) AS last FROM used a JOIN used b ON a.doc_id = b.doc_id AND b.j >= a.j AND b.j < a.j + {min_chars}
          AND b.chars - a.chars + length(a.line) >= {min_chars} GROUP BY ALL),
back AS (SELECT b.doc_id, max(a.j) AS first, b.j AS last FROM used a JOIN used b ON a.doc_id = b.doc_id AND b.j >= a.j AND b.j < a.j + {min_chars}
         AND b.chars - a.chars + length(a.line) >= {min_chars} GROUP BY ALL),
runs AS (SELECT DISTINCT * FROM (SELECT * FROM ahead UNION ALL SELECT * FROM back)),
filled AS (SELECT r.doc_id, r.first, r.last, string_agg(u.line, chr(10) ORDER BY u.j) AS content FROM runs r JOIN used u ON u.doc_id = r.doc_id AND u.j BETWEEN r.first AND r.last GROUP BY ALL),
later AS (SELECT * FROM filled QUALIFY row_number() OVER (PARTITION BY content ORDER BY doc_id, first) > 1),
gone AS (SELECT DISTINCT u.doc_id, u.i FROM used u JOIN later l ON l.doc_id = u.doc_id AND u.j BETWEEN l.first AND l.last),
deduped AS (
  SELECT d.doc_id, (SELECT count(*) FROM used u WHERE u.doc_id = d.doc_id) AS n_lines, (SELECT count(*) FROM gone g WHERE g.doc_id = d.doc_id) AS n_removed,
         CASE WHEN d.text IS NULL THEN NULL ELSE coalesce((SELECT string_agg(p.line, chr(10) ORDER BY p.i) FROM parts p WHERE p.doc_id = d.doc_id
              AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = p.doc_id AND g.i = p.i)), '') END AS text
  FROM {source} d)"""
