"""Approximate nearest neighbours by a permutation index.

Vectors are represented by their NEAR nearest pivots in order. Blocks of vectors are posted in
pivot inverted files: the list of a pivot holds the block's vectors that have it among theirs, with
its rank. A query visits the lists of its VISIT nearest pivots only. They give the footrule distance of what they
hold, as it falls by twice the sum of VISIT - max(rank, rank) over shared pivots; the share
`rerank` of a block nearest by footrule is ranked again by cosine, in double precision, and the best of all
blocks are the answer. With PIVOTS lists a vector stands in NEAR of them, so a query meets about
NEAR * VISIT / PIVOTS postings a vector: one, against the 64 components that brute force multiplies.

Pivots are fitted on a bounded sample (PIVOT_SAMPLE vectors, chosen by a hash of their id); every
vector is posted. Equal vectors are posted once, with their smallest ids, as many as an answer can
hold; so a vector that fills a third of the table is one entry. Blocks are dealt by rows, not by
pivot, so no pivot's list is a hot spot. Queries go to the blocks in blocks.

Nulls and odd inputs: a vector that is null, all zero, or holds a null or a component that isn't
finite takes no part, nor does one without an id. Vectors of several lengths have pivots and blocks for
each length: a vector is searched among those of its own length, and the driver plans once a length.
Equal ids with different vectors are all candidates and all queries, so one candidate may come once for each. Ties go to the smaller id.
With fewer candidates than k all are returned; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small, stored

#: Pivots at most (and the vectors they are drawn from), pivots of a vector and of a query, share ranked again.
PIVOTS = PIVOT_SAMPLE = 2048
NEAR, VISIT, RERANK = 32, 64, 0.1
BLOCK, QUERY_BLOCK = 8192, 1024

#: Vectors of a block that are ranked again, at least.
LEAST = 384


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(places, lengths, doubles' bytes) of the usable vectors; any length."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), 0), np.int64)
    flat = np.asarray(column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), np.float64)  # a null is a nan
    row = np.repeat(np.arange(len(column)), lengths)
    good = np.bincount(row, ~np.isfinite(flat), len(column)) == 0
    good &= np.bincount(row, flat != 0, len(column)) > 0
    places = np.flatnonzero(good)
    ends = np.concatenate([[0], np.cumsum(lengths[places] * 8)]).astype(np.int32)
    data = np.ascontiguousarray(flat[good[row]])
    return places, lengths[places], pa.Array.from_buffers(pa.binary(), len(places), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def usable(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id, dim, vector (its doubles' bytes) of the vectors that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, dims, found = _vectors(batch["vector"])
            ids = batch["id"].cast(pa.int64()).take(pa.array(places, pa.int64()))
            yield pa.record_batch({"id": ids, "dim": pa.array(dims, pa.int32()), "vector": found})

    picked = table.select(table[id_col].alias("id"), table[vec_col].alias("vector")).filter("id is not null and vector is not null")
    return stored(picked.mapInArrow(run, "id long, dim int, vector binary"), "vectors")


def pivots(vectors: DataFrame, count: int = PIVOTS) -> np.ndarray:
    """Unit pivots of vectors of one length: the first `count` different ones of the sample."""
    rows = vectors.orderBy(F.xxhash64("id"), "id", "vector").limit(PIVOT_SAMPLE).collect()  # bounded
    if not rows:
        return np.empty((0, 0))
    different = list(dict.fromkeys(bytes(r["vector"]) for r in rows))
    p = np.stack([np.frombuffer(x) for x in different[:count]])
    return p / np.linalg.norm(p, axis=1, keepdims=True)


def nearest_pivots(x: np.ndarray, p: np.ndarray, near: int, together: int = 1024) -> np.ndarray:
    """Each vector's nearest pivots in order, about `together` vectors at a time."""
    out = [np.empty((0, min(near, len(p))), np.int64)]
    for at in range(0, len(x), together):
        far = -(x[at : at + together] @ p.T)
        some = np.argpartition(far, near - 1, axis=1)[:, :near] if near < len(p) else np.broadcast_to(np.arange(len(p)), far.shape)
        out.append(np.take_along_axis(some, np.argsort(np.take_along_axis(far, some, 1), axis=1, kind="stable"), 1))
    return np.concatenate(out)


class Block:
    """Inverted files of one block of different vectors."""

    def __init__(self, x: np.ndarray, p: np.ndarray, near: int, visit: int):
        self.x, self.norm = x, np.linalg.norm(x, axis=1)
        order = nearest_pivots(x, p, near)
        self.visit = visit
        flat = order.ravel()
        by = np.argsort(flat, kind="stable")
        self.cuts = np.searchsorted(flat[by], np.arange(len(p) + 1)).tolist()
        self.row, rank = np.divmod(by, order.shape[1])
        self.gain = (visit - rank).astype(np.float64)

    def closeness(self, own: np.ndarray) -> np.ndarray:
        """What the footrule distance of each vector falls by, over the lists of the query's nearest pivots."""
        lists = [(self.cuts[t], self.cuts[t + 1], self.visit - rank) for rank, t in enumerate(own.tolist())]
        rows = np.concatenate([self.row[a:b] for a, b, _ in lists])
        return np.bincount(rows, np.concatenate([np.minimum(self.gain[a:b], g) for a, b, g in lists]), len(self.x))

    def nearest(self, q: np.ndarray, own: np.ndarray, share: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, cosines) of the best; own: the query's nearest pivots."""
        n = len(self.x)
        take = min(n, max(LEAST, int(np.ceil(share * n))))
        if take < n:
            key = self.closeness(own) * n - np.arange(n)  # ties go to the earlier row
            best = np.sort(np.argpartition(-key, take - 1)[:take])
        else:
            best = np.arange(n)
        score = np.einsum("ij,j->i", self.x[best], q) / (self.norm[best] * np.sqrt(q @ q))
        top = np.argsort(-score, kind="stable")[: k + 1]
        return best[top], score[top]


def nearest(table: DataFrame, queries: DataFrame | None = None, k: int = 5, near: int = NEAR, visit: int = VISIT, rerank: float = RERANK, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query, its own row left out.

    queries: a table like `table`; the rows of `table` whose id is divisible by 50 if it is None.
    """
    vectors = usable(table, id_col, vec_col)
    asked = usable(queries, id_col, vec_col) if queries is not None else vectors.filter("id % 50 = 0")
    found = table.sparkSession.createDataFrame([], "query_id long, vec_id long, score double")
    for dim in sorted(r["dim"] for r in asked.select("dim").distinct().collect()):  # a row a length
        own = F.col("dim") == dim
        found = found.union(nearest_of_length(vectors.filter(own), asked.filter(own), dim, k, near, visit, rerank))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.distinct().withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_of_length(vectors: DataFrame, asked: DataFrame, dim: int, k: int, near: int, visit: int, rerank: float) -> DataFrame:
    """query_id, vec_id, score: the best of each block of vectors, all of dim components as the queries are."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots(vectors))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Equal vectors of a batch as one row: what a hot vector sends on doesn't grow with its rows."""
        for batch in batches:
            ids: dict[bytes, list[int]] = {}
            for i, v in zip(batch["id"].to_pylist(), batch["vector"].to_pylist(), strict=True):
                ids.setdefault(v, []).append(i)
            yield pa.record_batch({"vector": pa.array(list(ids), pa.binary()), "ids": pa.array([sorted(x)[: k + 1] for x in ids.values()], pa.list_(pa.int64()))})

    different = (
        vectors.select("id", "vector").mapInArrow(merged, "vector binary, ids array<long>")
        .groupBy("vector").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids"))
    )

    def packed(size: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept: list[tuple[list[int], bytes]] = []

            def block(some):
                some = sorted(some)
                ids = np.full((len(some), k + 1), -1, np.int64)
                count = np.array([len(i) for i, _ in some], np.int64)
                for row, (i, _) in zip(ids, some, strict=True):
                    row[: len(i)] = i
                return pa.record_batch({"ids": [ids.tobytes()], "counts": [count.tobytes()], "x": [b"".join(v for _, v in some)]}, schema=pa.schema([("ids", pa.binary()), ("counts", pa.binary()), ("x", pa.binary())]))

            for batch in batches:
                kept += zip(batch["ids"].to_pylist(), batch["vector"].to_pylist(), strict=True)
                while len(kept) >= size:
                    yield block(kept[:size])
                    kept = kept[size:]
            if kept:
                yield block(kept)

        return run

    blocks = stored(different.select("ids", "vector").mapInArrow(packed(BLOCK), "ids binary, counts binary, x binary"), "blocks")
    asked = asked.select(F.array("id").alias("ids"), "vector")
    asked = stored(asked.mapInArrow(packed(QUERY_BLOCK), "ids binary, counts binary, x binary"), "queries").selectExpr("ids as q_ids", "x as q")
    n_asked, n_bytes = asked.agg(F.count("*"), F.coalesce(F.sum(F.length("q_ids") + F.length("q")), F.lit(0))).head()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, block = b"", None
        for batch in batches:
            for one in range(batch.num_rows):
                row = {name: batch[name][one].as_py() for name in ("ids", "counts", "x", "q_ids", "q")}
                if row["x"] != last:
                    last = row["x"]
                    block = Block(np.frombuffer(last).reshape(-1, dim), shared.value, near, visit)
                ids, counts = np.frombuffer(row["ids"], np.int64).reshape(-1, k + 1), np.frombuffer(row["counts"], np.int64)
                q, q_ids = np.frombuffer(row["q"]).reshape(-1, dim), np.frombuffer(row["q_ids"], np.int64).reshape(-1, k + 1)[:, 0]
                own = nearest_pivots(q, shared.value, visit)
                out: list[tuple[int, int, float]] = []
                for x, name, pivot in zip(q, q_ids.tolist(), own, strict=True):
                    rows, score = block.nearest(x, pivot, rerank, k)
                    got = [(name, int(i), float(s)) for r, s in zip(rows, score, strict=True) for i in ids[r, : counts[r]] if i != name]
                    out += sorted(got, key=lambda g: (-g[2], g[1]))[:k]
                yield pa.record_batch([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.float64())], ["query_id", "vec_id", "score"])

    return blocks.crossJoin(small(asked, n_asked, n_bytes)).mapInArrow(search, "query_id long, vec_id long, score double")
