"""SimHash near duplicates by the generalised pigeonhole principle.

The 64 bits are grouped into PARTS parts, correlated bits together. If the parts' thresholds e satisfy sum(e + 1) =
distance + 1, two fingerprints within the distance agree up to e bits in some part (a threshold of -1 leaves a part out). The
thresholds are unequal: dynamic programming takes those of least cost, from the number of candidate pairs of each part and
threshold, counted on the parts' values over all fingerprints, and the rows that probing sends. A fingerprint goes to the bucket of its own
value in a part and, as a visitor, to those of smaller values within the threshold, so a pair meets once a part.

Buckets of more than LIMIT rows are split: whoever links differs in at most `distance` of the bits that are left, so agrees in one of
distance + 1 groups of them, and each row goes on to a bucket for each group. A bucket that has used all but 12 bits
holds no more than LIMIT fingerprints, so every bucket becomes small whatever the data, and no row is dropped.
In a bucket each home row is compared with all rows, and what goes on is a forest of its links, not its pairs.

Nulls and odd inputs: a null or wordless text has fingerprint zero and is linked like any other. Fingerprints are compared
once however many rows have them. A null doc_id is passed through and names no component while another row has an id; a
component of null ids only has a null id. Equal ids are rows like others. Other columns are ignored; an empty table gives no rows. A long
text is hashed CHUNK bytes at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_view, drop_stored, map_batches, stored, texts_of, trim
from .components import components, with_values

#: Words of a shingle, seed, most differing bits of linked fingerprints.
SIZE, SEED, DISTANCE = 4, 42, 4

#: Parts of the 64 bits, and bits of each.
PARTS, WIDTH = 4, 16

#: Rows of a bucket that are compared together; it is 2**12, so that a bucket of which 12 bits are left can't hold more fingerprints.
LIMIT = 4096

#: Comparisons that cost as much as a row sent to a bucket.
ROW_COST = 50

#: Bytes of a text hashed at a time; pairs compared at a time.
CHUNK, TOGETHER = 1 << 20, 1 << 20

_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def _pieces(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text in lower case, about CHUNK bytes of it at a time."""
    at = 0
    while at < len(data):
        end = min(at + CHUNK, len(data))
        if end < len(data):
            found = _BLANK.search(data, end)
            end = found.start() if found else len(data)
        yield data[at:end].lower().split()
        at = end


def fingerprint(data: bytes) -> int:
    """Bit b is set if it is in more than half the hashes of a text's shingles, repeats included."""
    ones, n, rest = np.zeros(64, np.int64), 0, []
    for some in _pieces(data):
        words = rest + some
        if len(words) >= SIZE:
            text = b" ".join(words)
            size = np.fromiter(map(len, words), np.int64, len(words))
            begin = np.cumsum(size + 1) - size - 1
            end = (begin + size)[SIZE - 1 :].tolist()
            hashes = np.array([xxhash.xxh64_intdigest(text[a:b], SEED) for a, b in zip(begin.tolist(), end, strict=False)], np.uint64)
            ones += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
            n += len(hashes)
            words = words[-(SIZE - 1) :]
        rest = words
    if not n:
        return xxhash.xxh64_intdigest(b" ".join(rest), SEED) if rest else 0
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a long) of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(t) for t in texts_of(batch["text"])], np.uint64)
        return pa.record_batch({"doc_id": batch["doc_id"], "fp": pa.array(found.view(np.int64))})

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(doc_view(docs, "doc_id", "text"), run, f"doc_id {id_type}, fp long")


def bit_groups(classes: DataFrame) -> list[list[int]]:
    """PARTS groups of WIDTH bits, correlated bits together; the 64 x 64 counts are summed over all fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((64, 64))
        for batch in batches:
            bits = np.unpackbits(np.asarray(batch["fp"]).view(np.uint8), bitorder="little").reshape(-1, 64).astype(np.float64)
            both += bits.T @ bits
        yield pa.record_batch({"cell": pa.array(np.arange(4096), pa.int32()), "n": pa.array(both.ravel().astype(np.int64))})

    rows = classes.select("fp").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # 4,096 at most
    both = np.zeros(4096)
    for r in rows:
        both[r["cell"]] = r["n"]
    both = both.reshape(64, 64) / max(1, classes.count())
    p = np.diag(both)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    near = np.abs(both - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(near, 0)
    left, groups = list(range(64)), []
    while left:
        group = [max(left, key=lambda b: (near[b, left].sum(), -b))]
        while len(group) < WIDTH:
            group.append(max((b for b in left if b not in group), key=lambda b: (near[b, group].sum(), -b)))
        groups.append(sorted(group))
        left = [b for b in left if b not in group]
    return groups


def part_value(fp: str, group: list[int]):
    """The bits of a group as a small integer."""
    bit = lambda b, k: F.shiftleft(F.shiftrightunsigned(fp, b).bitwiseAND(1), k)
    value = bit(group[0], 0)
    for k, b in enumerate(group[1:], 1):
        value = value.bitwiseOR(bit(b, k))
    return value


def masks(width: int, most: int) -> list[int]:
    """Numbers of 1 to `most` bits of `width`."""
    return [sum(1 << b for b in some) for k in range(1, most + 1) for some in combinations(range(width), k)]


def candidate_counts(histogram: np.ndarray, most: int) -> list[float]:
    """Pairs of rows whose values differ in at most e bits, e = 0 to most; histogram: rows of each of 2**WIDTH values."""
    n = histogram.astype(np.float64)
    values, near, out = np.arange(len(n)), n.copy(), [float(n @ (n - 1)) / 2]
    for e in range(1, most + 1):
        for m in masks(WIDTH, e)[len(masks(WIDTH, e - 1)) :]:
            near += n[values ^ m]
        out.append(float(n @ (near - 1)) / 2)
    return out


def allocate(cost: list[list[float]], distance: int) -> list[int]:
    """Thresholds e of each part, -1 at least, with sum(e + 1) = distance + 1 and least sum of cost[part][e + 1]."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in cost:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (total, chosen) in best.items():
            for units in range(distance + 2 - used):
                new = (total + own[units], [*chosen, units - 1])
                if used + units not in step or new < step[used + units]:
                    step[used + units] = new
        best = step
    return best[distance + 1][1]


def thresholds(classes: DataFrame, groups: list[list[int]], distance: int) -> list[int]:
    """Allocated on the parts' values of all fingerprints; their histograms have 2**WIDTH numbers a part, whatever the data."""
    parts = F.explode(F.array(*(F.struct(F.lit(k).alias("part"), part_value("fp", g).alias("value")) for k, g in enumerate(groups)))).alias("p")
    found = classes.select(parts).groupBy("p.part", "p.value").agg(F.count("*").alias("n")).toPandas()
    cost = []
    for k in range(len(groups)):
        own = found[found["part"] == k]
        histogram = np.zeros(1 << WIDTH, np.int64)
        histogram[own["value"].to_numpy(np.int64)] = own["n"]
        rows = histogram.sum() * ROW_COST
        sent = [rows * (1 + len(masks(WIDTH, e)) / 2) for e in range(distance + 1)]
        cost.append([0.0, *(c + s for c, s in zip(candidate_counts(histogram, distance), sent, strict=True))])
    return allocate(cost, distance)


def probes(classes: DataFrame, groups: list[list[int]], chosen: list[int]) -> DataFrame:
    """key, used (mask of the part's bits), home, fp: each fingerprint in the buckets of its parts and as a visitor of others."""
    out = None
    for k, (group, most) in enumerate(zip(groups, chosen, strict=True)):
        if most < 0:
            continue
        rows = classes.select("fp", part_value("fp", group).alias("value"))
        own = rows.select("fp", "value", F.lit(True).alias("home"))
        if most:
            near = F.transform(F.array(*map(F.lit, masks(WIDTH, most))), lambda m: F.col("value").bitwiseXOR(m))
            own = own.union(rows.select("fp", F.explode(F.filter(near, lambda v: v < F.col("value"))).alias("value"), F.lit(False)))
        used = sum(1 << b for b in group)
        keyed = own.select(F.xxhash64(F.lit(k), "value").alias("key"), F.lit(_signed(used)).cast("long").alias("used"), "home", "fp")
        out = keyed if out is None else out.union(keyed)
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def split(rows: DataFrame, distance: int) -> DataFrame:
    """Rows of large buckets in buckets for each of distance + 1 groups of the bits that are left."""
    table = []
    for r in rows.select("used").distinct().collect():  # a few: PARTS * (distance + 1) ** level at most
        left = [b for b in range(64) if not (r["used"] >> b) & 1]
        table.append((r["used"], [_signed(sum(1 << b for b in left[k :: distance + 1])) for k in range(distance + 1)]))
    next_masks = rows.sparkSession.createDataFrame(table, "used long, masks array<long>")
    spread = rows.join(F.broadcast(next_masks), "used").withColumn("mask", F.explode("masks"))
    bits = F.col("fp").bitwiseAND(F.col("mask"))
    return spread.select(F.xxhash64("key", "mask", bits).alias("key"), F.col("used").bitwiseOR(F.col("mask")).alias("used"), "home", "fp")


def _merged(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """labels (each node's least known node) after links i - j."""
    while True:
        a, b = labels[i], labels[j]
        differ = a != b
        if not differ.any():
            return labels
        i, j = i[differ], j[differ]
        np.minimum.at(labels, np.maximum(a, b)[differ], np.minimum(a, b)[differ])
        while not np.array_equal(up := labels[labels], labels):
            labels = up


def forest(home: np.ndarray, visitors: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what the links of home rows with all rows join, fewer than rows."""
    every = np.concatenate([home, visitors])
    labels = np.arange(len(every))
    step = max(1, TOGETHER // max(1, len(every)))
    for at in range(0, len(home), step):
        i, j = np.nonzero(np.bitwise_count(home[at : at + step, None] ^ every[None, at:]) <= distance)
        labels = _merged(labels, i + at, j + at)
    moved = np.flatnonzero(labels != np.arange(len(every)))
    return every[moved], every[labels[moved]]


def verified(buckets: DataFrame, distance: int) -> DataFrame:
    """a, b: the forest of links of each bucket; compares in numpy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = []
            for name in ("homes", "visitors"):
                column = batch[name]
                lists.append((np.asarray(column.offsets), np.asarray(column.values).view(np.uint64)))
            (ho, hv), (vo, vv) = lists
            found = [forest(hv[ho[k] : ho[k + 1]], vv[vo[k] : vo[k + 1]], distance) for k in range(batch.num_rows)]
            a, b = (np.concatenate([np.empty(0, np.uint64), *(f[k] for f in found)]).view(np.int64) for k in (0, 1))
            yield pa.record_batch({"a": pa.array(a), "b": pa.array(b)})
        trim()

    return buckets.select("homes", "visitors").mapInArrow(run, "a long, b long")


def links(classes: DataFrame, distance: int = DISTANCE, limit: int = LIMIT) -> DataFrame:
    """Links (a, b) of distinct fingerprints (fp) that join all those at `distance` or fewer bits."""
    groups = bit_groups(classes)
    rows = stored(probes(classes, groups, thresholds(classes, groups, distance)), "probes")
    tables, found = [rows], None
    while True:
        count = rows.groupBy("key", "used").agg(F.count("*").alias("n"), F.sum(F.col("home").cast("long")).alias("h")).filter("n > 1 and h > 0")
        sizes = stored(count, "buckets")
        tables.append(sizes)
        many = F.col("n") > limit
        some = rows.join(sizes.filter(~many), ["key", "used"], "left_semi")
        lists = [F.collect_list(F.when(F.col("home") == flag, F.col("fp"))).alias(name) for flag, name in ((True, "homes"), (False, "visitors"))]
        own = stored(verified(some.groupBy("key", "used").agg(*lists), distance).distinct(), "near")
        found = own if found is None else found.union(own)
        if not sizes.filter(many).head(1):
            break
        rows = stored(split(rows.join(sizes.filter(many), ["key", "used"], "left_semi"), distance), "probes")
        tables.append(rows)
    drop_stored(*tables)
    return found


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, limit: int = LIMIT) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id of every row of docs."""
    rows = stored(fingerprints(docs), "fingerprints")
    classes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "classes")
    most = rows.count()
    found = links(classes, distance, limit)
    joined = components(found)
    label = F.coalesce("component", "fp").alias("label")
    of = stored(classes.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", "n", label), "labels")
    drop_stored(found, joined, classes)
    least = of.groupBy("label").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    per = with_values(of.select("fp", "n", "label"), least, "label", most).select("fp", "n", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return with_values(rows, per, "fp", most).select("doc_id", hexed, "component_id")
