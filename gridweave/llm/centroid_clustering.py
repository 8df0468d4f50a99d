"""k-means over vectors of integers, exact: GEMM where it is exact, integers elsewhere.

Components are floor(SCALE * x). Squared distances come from |x|^2 - 2x.c + |c|^2 in blocks of float64 BLAS wherever magnitudes
bound every partial sum below 2^53, so that any order of summation gives the same integer. Other rows or centroids, only those,
take 64-bit integers while a bound below 2^63 holds, and Python's integers beyond. Sums and counts of each round are combined
by treeAggregate over the blocks; what reaches the driver is k sums, however many vectors there are.

Vectors are packed in blocks in the shared folder once, as 32-bit integers where they fit and as given
otherwise, so a lost executor's blocks are read again and each round reads a fourth to a half of the vectors as doubles.

Nulls and odd inputs: a vector that is null, of another length, or that holds a null or a component that isn't finite takes no part. One without
an id is clustered but can't be a first centroid. Equal ids are vectors of their own; if they have equal hashes, the smaller
vector comes first. With fewer vectors than k there are as many centroids as ids allow; without any, no rows.
Distances or sums that don't fit in a long are null. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, trim

K, ROUNDS, DIM, SCALE, SEED = 40, 5, 64, 256, 2

#: Vectors of a block, and rows of a GEMM.
BLOCK, TOGETHER = 4096, 1024

#: Integers below it are exact in float64, and in 64 bits.
EXACT, LONG = 1 << 53, 1 << 63


def usable(table: DataFrame, dim: int = DIM, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id, vector (doubles) of the vectors that take part."""
    picked = table.select(table[id_col].alias("id"), table[vec_col].cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return picked.filter((F.size("vector") == dim) & finite)


def scaled(x: float) -> int:
    """floor(SCALE * x), exactly, whatever the size of x."""
    y = SCALE * x
    return math.floor(y) if math.isfinite(y) else SCALE * int(x)


def first_centroids(vectors: DataFrame, k: int = K, seed: int = SEED) -> list[list[int]]:
    """The vectors of the k smallest hashes of their ids, in that order."""
    named = vectors.filter("id is not null").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("h"), "vector")
    return [list(map(scaled, r["vector"])) for r in named.orderBy("h", "vector").limit(k).collect()]


def blocks(vectors: DataFrame, dim: int = DIM) -> DataFrame:
    """ids, wide, x: blocks of vectors as 32-bit integers, or (wide) as doubles that aren't scaled yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                some = batch.slice(at, BLOCK)
                x = np.asarray(some["vector"].flatten(), np.float64)
                wide = bool((np.abs(x) >= (1 << 30) / SCALE).any())
                data = x if wide else np.floor(SCALE * x).astype(np.int32)
                yield pa.record_batch({"ids": pa.array([some["id"].cast(pa.int64()).to_pylist()], pa.list_(pa.int64())), "wide": [wide], "x": [data.tobytes()]})

    return stored(vectors.mapInArrow(run, "ids array<long>, wide boolean, x binary"), "vectors")


def integers(wide: bool, data: bytes, dim: int) -> np.ndarray:
    """A block's vectors: 64-bit integers, or objects where some need more."""
    if not wide:
        return np.frombuffer(data, np.int32).astype(np.int64).reshape(-1, dim)
    x = np.frombuffer(data, np.float64).reshape(-1, dim)
    if np.abs(x).max(initial=0) < (1 << 61) / SCALE:
        return np.floor(SCALE * x).astype(np.int64)
    return np.array([list(map(scaled, row)) for row in x.tolist()], object).reshape(-1, dim)


def _largest(x: np.ndarray, axis: int | None = None):
    return np.abs(x).max(axis=axis, initial=0)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of x to rows of c: the cheapest way whose bound holds."""
    bound = x.shape[1] * (int(_largest(x)) + int(_largest(c))) ** 2
    if bound < EXACT:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return (np.einsum("ij,ij->i", a, a)[:, None] - 2 * (a @ b.T) + np.einsum("ij,ij->i", b, b)).astype(np.int64)
    kind = np.int64 if bound < LONG else object
    a, b = x.astype(kind), c.astype(kind)
    out = np.empty((len(a), len(b)), kind)
    for j, own in enumerate(b):
        d = a - own
        out[:, j] = (d * d).sum(axis=1)
    return out


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest row of c, squared distance) of each row of x; ties go to the smaller number."""
    room = math.isqrt(EXACT // x.shape[1]) // 2 - 1  # of magnitudes that a GEMM takes on both sides
    small_x, small_c = (np.asarray(_largest(v, 1) <= room, bool) for v in (x, c))
    best, far = np.zeros(len(x), np.int64), np.empty(len(x), object)
    for at in range(0, len(x), TOGETHER):
        for own in (small_x, ~small_x):
            rows = at + np.flatnonzero(own[at : at + TOGETHER])
            if not len(rows):
                continue
            found = None
            for cols in (np.flatnonzero(small_c), np.flatnonzero(~small_c)):
                if not len(cols):
                    continue
                d = squared(x[rows], c[cols])
                j = d.argmin(axis=1)
                new = (cols[j], d[np.arange(len(rows)), j])
                if found is None:
                    found = new
                else:
                    closer = np.asarray((new[1] < found[1]) | ((new[1] == found[1]) & (new[0] < found[0])), bool)
                    found = tuple(np.where(closer, n, f) for n, f in zip(new, found, strict=True))
            best[rows], far[rows] = found
    return best, far


def summed(x: np.ndarray, cluster: np.ndarray, k: int) -> np.ndarray:
    """Componentwise sums of each cluster's rows, as Python's integers."""
    if len(x) * int(_largest(x)) < EXACT:
        of = np.zeros((k, len(x)))
        of[cluster, np.arange(len(x))] = 1
        return (of @ x.astype(np.float64)).astype(np.int64).astype(object)
    out = np.zeros((k, x.shape[1]), object)
    np.add.at(out, cluster, x.astype(object))
    return out


def _long(x) -> int | None:
    return int(x) if x < LONG else None


def clusters(table: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, seed: int = SEED, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that takes part."""
    vectors = usable(table, dim, id_col, vec_col)
    start = first_centroids(vectors, k, seed)
    packed = blocks(vectors, dim)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not start:
        return table.sparkSession.createDataFrame([], schema)
    centroids = [tuple(c) for c in start]

    def exact(c: list[tuple[int, ...]]) -> np.ndarray:
        fits = all(-(1 << 61) < v < 1 << 61 for own in c for v in own)
        return np.array(c, np.int64 if fits else object).reshape(-1, dim)

    def gathered(c: list[tuple[int, ...]], distances: bool):
        """Sums and counts of each cluster, or its distances' sum."""

        def add(acc, row):
            x = integers(row["wide"], row["x"], dim)
            cluster, far = nearest(x, exact(c))
            count = np.bincount(cluster, minlength=len(c)).astype(object)
            if distances:
                total = np.zeros(len(c), object)
                np.add.at(total, cluster, far)
                return acc[0] + total, acc[1] + count
            return acc[0] + summed(x, cluster, len(c)), acc[1] + count

        zero = np.zeros(len(c) if distances else (len(c), dim), object)
        return packed.rdd.treeAggregate((zero, np.zeros(len(c), object)), add, lambda p, q: (p[0] + q[0], p[1] + q[1]), depth=2)

    for _ in range(rounds):
        sums, counts = gathered(centroids, False)
        centroids = [tuple(int(v) // int(n) for v in s) if n else own for s, n, own in zip(sums, counts, centroids, strict=True)]
    inertia, _ = gathered(centroids, True)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    each, total = [_long(v) for v in inertia], _long(sum(inertia))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = exact(centroids)
        for batch in batches:
            for row in batch.to_pylist():
                cluster, far = nearest(integers(row["wide"], row["x"], dim), c)
                of = cluster.tolist()
                columns = [pa.array(row["ids"], pa.int64()), pa.array(of, pa.int32()), pa.array(list(map(_long, far)), pa.int64()), pa.array([each[j] for j in of], pa.int64())]
                columns += [pa.array([total] * len(of), pa.int64()), pa.array([names[j] for j in of], pa.string())]
                yield pa.record_batch(columns, ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])
        trim()

    return packed.mapInArrow(run, schema)


def oracle_sql(k: int = K, rounds: int = ROUNDS, dim: int = DIM, seed: int = SEED) -> str:
    """The same by definition, for values whose squares are exact in doubles."""
    near = "list_inner_product(CAST(k.v AS DOUBLE[]), CAST(k.v AS DOUBLE[])) - 2 * list_inner_product(CAST(k.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) + list_inner_product(CAST(c.v AS DOUBLE[]), CAST(c.v AS DOUBLE[]))"
    parts = [
        f"""kept AS (SELECT row_number() OVER () AS r, vec_id, [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
 WHERE len(embedding) = {dim} AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)""",
        f"named AS (SELECT sha256('{seed}:' || vec_id) AS h, v FROM kept WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {k})",
        "c0 AS (SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INT) AS cluster, v FROM named)",
    ]
    for i in range(rounds + 1):
        parts.append(f"d{i} AS (SELECT r, vec_id, k.v, cluster, CAST({near} AS BIGINT) AS distance FROM kept k CROSS JOIN c{i} c)")
        parts.append(f"a{i} AS (SELECT * FROM d{i} QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, cluster) = 1)")
        if i < rounds:
            parts.append(f"e{i} AS (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM a{i})")
            parts.append(f"s{i} AS (SELECT cluster, pos, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM e{i} GROUP BY 1, 2)")
            parts.append(f"m{i} AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY pos) AS v FROM s{i} GROUP BY 1)")
            parts.append(f"c{i + 1} AS (SELECT cluster, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m USING (cluster))")
    return f"""WITH {', '.join(parts)} SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
 CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} c USING (cluster)"""
