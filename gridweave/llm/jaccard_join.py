"""N-gram Jaccard join: multiple-global-order filtering, exact, with links kept linear in a group.

A document's set are its distinct word shingles. Equal sets are one class. Two classes link when
their Jaccard similarity reaches `num`/100.

Orders. All classes sort their tokens by the same global order; then similar sets share a token of
their prefixes, of size n - ceil(t n) + 1. Two orders are used: rare tokens first, and the order of the tokens'
hashes; in both, tokens of one class alone come first of all. A candidate must share prefix tokens in both, and both
filters are applied before any overlap is counted. Frequencies are exact counts over all classes, but for hot tokens:
those that a sample shows to be in HOT classes or more, a bounded number, have the sample's estimate for a frequency
(any order will do if it is the same for all) and are never gathered by token. Tokens found in one class come first, so a class with
more of them than its prefix has no partner; such classes go, frequencies are counted again over
the others, and what stays has few tokens in its prefix.

What is written stays linear in a group of copies: each token first links its classes to its most
central one only (a star). The links that verify give components. Classes that share a prefix token
with a class of another component then meet in blocks, where candidates are tried in place and
only links that join components leave, so no link between components is lost. A class goes to those blocks only
in which a class shares a prefix token with it.

Token lists travel as packed arrays, dealt by hash ranges of tokens or of classes whose number
follows the input. What a prefix token's list is needed for, its centre and whether it spans components, are grouped minima
with map-side partial results, so a list that is a third of all classes is met by no task as a whole.

Nulls and odd inputs: a null or empty text has no shingle, links to nothing and is its own component.
A null doc_id has its own count and a null component. Rows with one doc_id and different texts are
separate nodes with one id. Equal rows are one class. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_view, drop_stored, map_batches, small, stored, texts_of, trim, trimmed
from .components import components, with_values
from .shingles import finalised, set_key, shingle_sets

SIZE, NUM = 5, 75

#: Tokens of one bucket about, and classes of one.
BUCKET_TOKENS, BUCKET_NODES = 500_000, 2_000

#: Classes that meet with their tokens in one block at most, about, and classes of small families that share a task.
BLOCK_NODES, PACK_NODES = 8_192, 1_024

#: One class of SAMPLE is looked at for hot tokens; classes of a hot token at least, and hot tokens at most.
SAMPLE, HOT, HOT_TOKENS = 64, 100_000, 1_000_000

_PACKED = "bucket int, nodes binary, tokens binary"
_COUNTED = "bucket int, nodes binary, tokens binary, freq binary"


def class_sets(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n and the 128-bit name of each row's set, and the sets of the sample; stored."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(texts_of(batch["text"]), size)
        keys = [set_key(s) for s in sets]
        return pa.record_batch(
            {
                "doc_id": batch["doc_id"].cast(pa.int64()),
                "n": pa.array([len(s) for s in sets], pa.int64()),
                "k1": pa.array([k[0] for k in keys], pa.int64()),
                "k2": pa.array([k[1] for k in keys], pa.int64()),
                "sample": pa.array([s.tobytes() if len(s) and k[0] % SAMPLE == 0 else None for s, k in zip(sets, keys, strict=True)], pa.binary()),
            }
        )

    return stored(map_batches(doc_view(docs, "doc_id", "text"), run, "doc_id long, n long, k1 long, k2 long, sample binary"), "sets")


def hot_tokens(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(tokens in order, frequencies): those of HOT classes or more by the sample, at most HOT_TOKENS about."""

    def run(batches):
        for batch in batches:
            yield pa.record_batch({"token": pa.array(np.frombuffer(b"".join(batch["sample"].to_pylist()), np.int64))})

    sampled = sets.filter("sample is not null").groupBy("n", "k1", "k2").agg(F.first("sample").alias("sample"))
    total = sampled.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    least = max(1, HOT // SAMPLE, total // HOT_TOKENS)
    if sampled.count() < least:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    rows = sampled.select("sample").mapInArrow(run, "token long").groupBy("token").count().filter(F.col("count") >= least).toPandas()  # bounded
    tokens = rows["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], rows["count"].to_numpy(np.int64)[order] * SAMPLE


def _split(bucket: np.ndarray, buckets: int, *columns: np.ndarray) -> tuple[list, ...]:
    """The columns' bytes by bucket."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    parts = [c[order] for c in columns]
    used = np.flatnonzero(np.diff(cuts))
    return (used.astype(np.int32), *([p[cuts[k] : cuts[k + 1]].tobytes() for k in used] for p in parts))


def _rows(schema: pa.Schema, *columns) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_PACKED_SCHEMA = pa.schema([("bucket", pa.int32()), ("nodes", pa.binary()), ("tokens", pa.binary())])
_COUNTED_SCHEMA = _PACKED_SCHEMA.append(pa.field("freq", pa.binary()))


def _read(table: pa.Table, name: str, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(table[name].to_pylist()), dtype)


def _need(n: np.ndarray, num: int) -> np.ndarray:
    """Common tokens that a set of n needs with any partner."""
    return -(-n * num // 100)


def _among(tokens: np.ndarray, hot: np.ndarray) -> np.ndarray:
    if not len(hot):
        return np.zeros(len(tokens), bool)
    return hot[np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)] == tokens


def _with_hot(columns: tuple, away: tuple) -> tuple:
    """Packed rows by token, and those of hot tokens by class in buckets below 0."""
    return (np.concatenate([columns[0], -1 - away[0]]), *([*c, *a] for c, a in zip(columns[1:], away[1:], strict=True)))


class Join:
    """The steps of one join; classes: node, rep, n, k1, k2 (stored); hot: hot tokens and their frequencies."""

    def __init__(self, docs: DataFrame, classes: DataFrame, size: int, num: int, hot: tuple[np.ndarray, np.ndarray]):
        self.docs, self.size, self.num = docs, size, num
        self.hot = docs.sparkSession.sparkContext.broadcast(hot)
        self.classes = classes
        self.count, total = classes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).head()
        self.token_buckets = 1 << max(4, (total // BUCKET_TOKENS).bit_length())
        self.node_buckets = max(16, -(-self.count // BUCKET_NODES))

    def tokens(self) -> DataFrame:
        """All tokens of all classes, packed by token: the low bits choose the bucket, 6 bytes go along. Hot tokens
        are packed by class, whole, in buckets below 0."""
        reps = self.classes.select(F.col("rep").alias("doc_id"), "node", "k1", "k2")
        texts = doc_view(self.docs, "doc_id", "text").join(small(reps, self.count), "doc_id")
        buckets, node_buckets, size, hot = self.token_buckets, self.node_buckets, self.size, self.hot
        bits = np.uint64(buckets.bit_length() - 1)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            k1, k2 = batch["k1"].to_pylist(), batch["k2"].to_pylist()
            sets = shingle_sets(texts_of(batch["text"]), size)
            mine = [k for k, s in enumerate(sets) if set_key(s) == (k1[k], k2[k])]  # not another text under the same id
            tokens = np.concatenate([np.empty(0, np.uint64), *(sets[k] for k in mine)])
            nodes = np.repeat(np.asarray(batch["node"], np.int64)[mine], [len(sets[k]) for k in mine])
            is_hot = _among(tokens, hot.value[0])
            away = _split((nodes[is_hot] % node_buckets).astype(np.int32), node_buckets, nodes[is_hot], tokens[is_hot])
            tokens, nodes = tokens[~is_hot], nodes[~is_hot]
            bucket = (tokens & np.uint64(buckets - 1)).astype(np.int32)
            six = (tokens >> bits).view(np.uint8).reshape(-1, 8)[:, :6]
            columns = _with_hot(_split(bucket, buckets, nodes, six), away)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PACKED_SCHEMA, strict=True)], schema=_PACKED_SCHEMA)

        return map_batches(texts, run, _PACKED, size=8 << 20, rows=10_000)

    def counted(self, packed: DataFrame, wide: bool) -> DataFrame:
        """Tokens of two classes or more with their frequency, packed by class. wide: tokens come with 8 bytes."""
        buckets, node_buckets, hot = self.token_buckets, self.node_buckets, self.hot
        bits = np.uint64(buckets.bit_length() - 1)

        def run(table: pa.Table) -> pa.Table:
            nodes = _read(table, "nodes", np.int64)
            own = table["bucket"][0].as_py()
            if own < 0:  # classes' hot tokens
                tokens = _read(table, "tokens", np.uint64)
                pairs = np.unique(np.stack([nodes.view(np.uint64), tokens], 1), axis=0)  # equal rows of a class count once
                nodes, tokens = pairs[:, 0].view(np.int64), np.ascontiguousarray(pairs[:, 1])
                freq = hot.value[1][np.searchsorted(hot.value[0], tokens)]
                return _rows(_COUNTED_SCHEMA, [-1 - own], [nodes.tobytes()], [tokens.tobytes()], [freq.tobytes()])
            if wide:
                tokens = _read(table, "tokens", np.uint64)
            else:
                eight = np.zeros((len(nodes), 8), np.uint8)
                eight[:, :6] = _read(table, "tokens", np.uint8).reshape(-1, 6)
                tokens = (eight.reshape(-1).view(np.uint64) << bits) | np.uint64(own)
            order = np.lexsort((nodes, tokens))
            tokens, nodes = tokens[order], nodes[order]
            if len(tokens):  # equal rows of a class count once
                keep = np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (nodes[1:] != nodes[:-1])])
                tokens, nodes = tokens[keep], nodes[keep]
            begin = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.empty(0, int)
            freq = np.repeat(np.diff(np.append(begin, len(tokens))), np.diff(np.append(begin, len(tokens)))).astype(np.int64)
            keep = freq > 1
            nodes, tokens, freq = nodes[keep], tokens[keep], freq[keep]
            return _rows(_COUNTED_SCHEMA, *_split((nodes % node_buckets).astype(np.int32), node_buckets, nodes, tokens, freq))

        return packed.groupBy("bucket").applyInArrow(lambda table: trimmed(run, table), _COUNTED)

    def _by_node(self, counted: DataFrame, emit, schema: str) -> DataFrame:
        """emit(node, n, tokens, freq) over the classes that keep enough shared tokens to have a partner."""
        num, node_buckets = self.num, self.node_buckets

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            nodes, tokens, freq = _read(left, "nodes", np.int64), _read(left, "tokens", np.uint64), _read(left, "freq", np.int64)
            order = np.argsort(nodes, kind="stable")
            nodes, tokens, freq = nodes[order], tokens[order], freq[order]
            names, begin, shared = np.unique(nodes, return_index=True, return_counts=True)
            known, n = np.asarray(right["node"], np.int64), np.asarray(right["n"], np.int64)
            by = np.argsort(known)
            size = n[by][np.searchsorted(known[by], names)] if len(names) else np.empty(0, np.int64)
            alive = shared >= _need(size, num)
            return emit([(int(names[k]), int(size[k]), tokens[begin[k] : begin[k] + shared[k]], freq[begin[k] : begin[k] + shared[k]]) for k in np.flatnonzero(alive)])

        sizes = self.classes.select(F.pmod("node", F.lit(node_buckets)).cast("int").alias("bucket"), "node", "n")
        return counted.groupBy("bucket").cogroup(sizes.groupBy("bucket")).applyInArrow(lambda left, right: trimmed(run, left, right), schema)

    def again(self, counted: DataFrame) -> DataFrame:
        """Shared tokens of the classes that may have a partner, packed by token."""
        buckets, node_buckets, hot = self.token_buckets, self.node_buckets, self.hot

        def emit(found: list) -> pa.Table:
            tokens = np.concatenate([np.empty(0, np.uint64), *(f[2] for f in found)])
            nodes = np.repeat(np.array([f[0] for f in found], np.int64), [len(f[2]) for f in found])
            is_hot = _among(tokens, hot.value[0])
            away = _split((nodes[is_hot] % node_buckets).astype(np.int32), node_buckets, nodes[is_hot], tokens[is_hot])
            tokens, nodes = tokens[~is_hot], nodes[~is_hot]
            return _rows(_PACKED_SCHEMA, *_with_hot(_split((tokens & np.uint64(buckets - 1)).astype(np.int32), buckets, nodes, tokens), away))

        return self._by_node(counted, emit, _PACKED)

    def alive(self, counted: DataFrame) -> DataFrame:
        """node, n, own (how many of its tokens no other class has), tokens (shared ones, sorted), and the shared ones
        in its prefix by each order."""
        num = self.num
        names = pa.list_(pa.int64())
        schema = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("own", pa.int64()), ("tokens", pa.binary()), ("first", names), ("second", pa.binary())])

        def emit(found: list) -> pa.Table:
            rows = []
            for node, n, tokens, freq in found:
                quota = n - int(_need(np.int64(n), num)) + 1 - (n - len(tokens))  # tokens of one class fill the prefix first
                one = tokens[np.lexsort((tokens, freq))[:quota]]
                two = tokens[np.argsort(finalised(tokens))[:quota]]
                rows.append((node, n, n - len(tokens), np.sort(tokens).tobytes(), one.view(np.int64), np.sort(two).tobytes()))
            return _rows(schema, *(list(c) for c in zip(*rows, strict=True))) if rows else schema.empty_table()

        return self._by_node(counted, emit, "node long, n long, own long, tokens binary, first array<long>, second binary")

    def stars(self, alive: DataFrame) -> DataFrame:
        """Candidates (a, b): each class of a token's list with the list's most central one, which is the one
        with the fewest tokens of its own: variants of a text that link to any other mostly link to it."""
        post = alive.select(F.explode("first").alias("token"), "node", "own")
        centre = post.groupBy("token").agg(F.min(F.struct("own", "node"))["node"].alias("hub"), F.count("*").alias("n")).filter("n > 1").select("token", "hub")
        met = post.select("token", "node").join(small(centre, self.prefixes // 2), "token").filter("hub <> node")
        return met.select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct()

    def across(self, placed: DataFrame) -> DataFrame:
        """Links (a, b) between components that the stars left apart, as many as join them.

        Classes that share prefix tokens with others of another component form families. A small family meets in
        one block with its tokens; a large one is dealt over blocks of about BLOCK_NODES classes, and a class
        goes to the pairs of its block with those blocks that hold a class with one of its prefix tokens. There
        both filters are taken over inverted lists, for all partners of a class at once, then the exact overlap, and
        only links that join two components leave: no more rows than classes, whatever the size of a group.
        """
        num, size = self.num, BLOCK_NODES
        post = placed.select(F.explode("first").alias("token"), "node", "component")
        lists = post.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("node").alias("hub"))
        lists = stored(lists.filter("low <> high").select("token", "hub"), "lists")
        met = stored(post.select("token", "node").join(small(lists, lists.count()), "token"), "met")
        pairs = met.filter("hub <> node").select(F.col("hub").alias("a"), F.col("node").alias("b"))
        family = stored(components(pairs).withColumnsRenamed({"component": "family"}), "members")
        total = family.count()
        blocks = family.groupBy("family").agg(F.ceil(F.count("*") / size).cast("int").alias("blocks"), F.count("*").alias("n"))
        mine = F.pmod(F.xxhash64("component"), F.col("blocks")).cast("int")  # classes of a component mostly share a block
        spread = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
        family = with_values(family, blocks, "family", total).join(placed.select("node", "component"), "node")
        crowded = family.groupBy("component").agg(F.count("*").alias("members")).filter(F.col("members") > size).select("component", F.lit(True).alias("crowded"))
        family = family.join(small(crowded, total // size), "component", "left").withColumn("mine", F.when(F.col("crowded"), spread).otherwise(mine))
        family = stored(family.select("node", "family", "blocks", "mine"), "families")
        large = family.agg(F.coalesce(F.max("blocks"), F.lit(0))).head()[0]
        packs = max(1, -(-total // PACK_NODES))  # small families share a task, a large one has blocks of its own
        pack = F.when(F.col("blocks") > 1, F.col("family")).otherwise(-1 - F.pmod(F.xxhash64("family"), F.lit(packs)))
        dealt = family.filter("blocks = 1").select("node", pack.alias("pack"), "mine", F.lit(0).alias("i"), F.lit(0).alias("j"))
        if large > 1:
            held = met.join(small(family.filter("blocks > 1").select("node", "family", "mine"), total), "node")
            places = held.select("token", "family", F.col("mine").alias("other")).distinct()
            goes = held.join(places, ["token", "family"]).select("node", F.col("family").alias("pack"), "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
            dealt = dealt.union(goes.distinct())
        dealt = stored(dealt, "dealt")
        dealt = placed.select("node", "n", "component", "tokens", "first", "second").join(small(dealt, dealt.count()), "node")
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def probe(table: pa.Table) -> pa.Table:
            one_block = table["i"][0].as_py() == table["j"][0].as_py()
            nodes, n, comp, block = (np.asarray(table[k], np.int64) for k in ("node", "n", "component", "mine"))
            parent: dict[int, int] = {}

            def root(c: int) -> int:
                while (up := parent.get(c, c)) != c:
                    parent[c] = parent.get(up, up)
                    c = up
                return c

            def inverted(sets: list[np.ndarray]):
                lengths = np.array([len(x) for x in sets])
                ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
                order = np.argsort(ids, kind="stable")
                rows = np.repeat(np.arange(len(sets)), lengths)[order]
                cuts = np.searchsorted(ids[order], np.arange(ids.max(initial=-1) + 2))
                ends = np.cumsum(lengths)
                return lambda k: np.bincount(np.concatenate([np.empty(0, np.int64), *(rows[cuts[t] : cuts[t + 1]] for t in ids[ends[k] - lengths[k] : ends[k]])]), minlength=len(sets))

            first = inverted([np.asarray(x, np.int64) for x in table["first"].to_pylist()])
            second, overlap = (inverted([np.frombuffer(x, np.uint64) for x in table[name].to_pylist()]) for name in ("second", "tokens"))
            names, counts = np.unique(comp, return_counts=True)
            largest = names[counts.argmax()]
            out = []
            for k in np.flatnonzero(comp != largest).tolist():
                could = (first(k) > 0) & (comp != comp[k]) & (100 * np.minimum(n, n[k]) >= num * np.maximum(n, n[k]))
                if not one_block:
                    could &= block != block[k]
                if not could.any():
                    continue
                could &= second(k) > 0
                if not could.any():
                    continue
                common = overlap(k)
                for y in np.flatnonzero(could & (100 * common >= num * (n + n[k] - common))).tolist():
                    p, q = root(int(comp[k])), root(int(comp[y]))
                    if p != q:
                        parent[max(p, q)] = min(p, q)
                        out.append((int(nodes[k]), int(nodes[y])))
            return _rows(schema, [o[0] for o in out], [o[1] for o in out])

        return dealt.groupBy("pack", "i", "j").applyInArrow(lambda table: trimmed(probe, table), "a long, b long")

    def verified(self, pairs: DataFrame, alive: DataFrame) -> DataFrame:
        """The pairs that pass the second order's filter and then reach the similarity."""
        num = self.num
        one = alive.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"), F.col("second").alias("sa"))
        two = alive.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"), F.col("second").alias("sb"))

        def run(batches):
            for batch in batches:
                good = []
                for na, nb, sa, sb, ta, tb in zip(*(batch[k].to_pylist() for k in ("na", "nb", "sa", "sb", "ta", "tb")), strict=True):
                    ok = 100 * min(na, nb) >= num * max(na, nb)
                    ok = ok and len(np.intersect1d(np.frombuffer(sa, np.uint64), np.frombuffer(sb, np.uint64), assume_unique=True)) > 0
                    if ok:
                        common = len(np.intersect1d(np.frombuffer(ta, np.uint64), np.frombuffer(tb, np.uint64), assume_unique=True))
                        ok = 100 * common >= num * (na + nb - common)
                    good.append(ok)
                yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))
            trim()

        return pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "sa", "sb", "ta", "tb").mapInArrow(run, "a long, b long")

    def links(self) -> DataFrame:
        """(node, component) of every class with a link."""
        first = self.counted(self.tokens(), wide=False)
        packed = stored(self.again(first), "shared")
        alive = stored(self.alive(self.counted(packed, wide=True)), "alive")
        drop_stored(packed)
        self.prefixes = alive.agg(F.coalesce(F.sum(F.size("first")), F.lit(0))).head()[0]
        stars = stored(self.stars(alive), "stars")
        near = stored(self.verified(stars, alive), "near")
        groups = stored(components(near), "groups")
        placed = alive.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
        far = stored(self.across(placed), "far")
        if far.take(1):
            groups = stored(components(near.union(far)), "groups")
        drop_stored(alive, stars, near, far)
        return groups


def near_duplicates(docs: DataFrame, size: int = SIZE, num: int = NUM) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs."""
    sets = class_sets(docs, size)
    by = ["n", "k1", "k2"]
    named = sets.filter("n > 0 and doc_id is not null").groupBy(*by).agg(F.min("doc_id").alias("rep"))
    classes = stored(named.select(F.monotonically_increasing_id().alias("node"), "rep", *by), "classes")
    groups = Join(docs, classes, size, num, hot_tokens(sets)).links()
    count, linked = classes.count(), groups.count()
    reps = classes.join(small(groups, linked), "node", "left")
    several = reps.filter("component is not null")
    least = several.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("n"))
    answer = with_values(several, least, "component", linked).select(*by, "component_id")
    answer = answer.union(reps.filter("component is null").select(*by, F.col("rep").alias("component_id")))
    out = sets.drop("sample").join(small(answer, count), by, "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def drop_copies(docs: DataFrame, size: int = SIZE, num: int = NUM) -> DataFrame:
    """docs with one row of each group of linked rows: the first by doc_id (null ids last) and text. Rows are told
    apart by doc_id and text, so a text under an id that other texts share goes only for its own links, and
    rows equal in both are copies; rows without a shingle all stay."""
    text = F.coalesce(docs["text"], F.lit(""))
    keyed = docs.withColumns({"__gw_t1": F.xxhash64(text), "__gw_t2": F.xxhash64(F.lit(1), text)})
    order = [F.col("k0").asc_nulls_last(), "k1", "k2"]
    keys = keyed.select(F.col("doc_id").alias("k0"), F.col("__gw_t1").alias("k1"), F.col("__gw_t2").alias("k2")).distinct()
    keys = stored(keys.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__gw_row", F.monotonically_increasing_id()), "order")
    same = F.col("doc_id").eqNullSafe(F.col("k0")) & (F.col("__gw_t1") == F.col("k1")) & (F.col("__gw_t2") == F.col("k2"))
    count = keys.count()
    rows = keyed.join(small(keys, count), same).select(F.col("__gw_row").alias("doc_id"), "text")
    groups = near_duplicates(rows, size, num)
    later = F.max(F.col("component_id") != F.col("doc_id")).alias("__gw_later")
    marks = groups.filter("n_shingles > 0").groupBy(F.col("doc_id").alias("__gw_row")).agg(later, F.count("*").alias("n")).filter("__gw_later or n > 1")
    marks = stored(marks.join(small(keys, count), "__gw_row").select("k0", "k1", "k2", "__gw_later"), "copies")
    marked = keyed.join(small(marks, marks.count()), same, "left")
    once = marked.filter("__gw_later is null").select(*docs.columns)
    if not marks.filter("not __gw_later").take(1):
        return once
    first = marked.filter("not __gw_later").groupBy("k0", "k1", "k2").agg(F.min(F.struct(*docs.columns)).alias("x"))
    return once.union(first.select("x.*"))


def oracle_sql(size: int = SIZE, num: int = NUM) -> str:
    """DuckDB SQL for the result over a table with unique ids: all pairs that share a shingle, and closure."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""WITH RECURSIVE split AS (SELECT doc_id, regexp_extract_all({lower}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
windows AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {size - 1}, 1) + 1)) AS k FROM split WHERE len(ws) > 0),
shingles AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, k, k + {size - 1}), ' ') AS s FROM windows),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= {num} * (x.n + y.n - c)),
reach AS (SELECT doc_id, doc_id AS other FROM split UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.other = links.a)
SELECT split.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id FROM split JOIN reach USING (doc_id) LEFT JOIN sizes USING (doc_id) GROUP BY 1"""
