"""SimHash near duplicates and exact clustering against brute force."""

import hashlib
import math

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gridweave.llm import centroid_clustering as cc
from gridweave.llm import simhash_dedup as sd

# --- simhash ---------------------------------------------------------------------------------------


def brute_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lower = lower.replace(c, " ")
    words = [w for w in lower.split(" ") if w]
    grams = [" ".join(words[k : k + 4]) for k in range(max(len(words) - 3, 1))] if words else []
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum((h >> b) & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    distinct = sorted(set(fps))
    label = {f: f for f in distinct}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for k, x in enumerate(distinct):
        for y in distinct[:k]:
            if (x ^ y).bit_count() <= 4:
                label[max(root(x), root(y))] = min(root(x), root(y))
    least = {}
    for (i, _), f in zip(rows, fps, strict=True):
        if i is not None:
            least[root(f)] = min(least.get(root(f), i), i)
    return sorted((i is None, i or 0, f"{f:016x}", least.get(root(f), -1)) for (i, _), f in zip(rows, fps, strict=True))


def corpus(seed, families, copies):
    r = np.random.default_rng(seed)
    word = lambda: "".join(r.choice(list("abcdefghij"), r.integers(2, 8)))
    texts = []
    for _ in range(families):
        base = [word() for _ in range(r.integers(40, 200))]
        for _ in range(r.integers(1, copies)):
            own = list(base)
            for _ in range(r.integers(0, 3)):
                own[r.integers(0, len(own))] = word()
            texts.append(" ".join(own))
    return texts


def family(copies):
    """Copies of one text that each differ in a word or two: a ball of fingerprints larger than a small limit."""
    r = np.random.default_rng(11)
    base = [f"w{k}" for k in range(120)]
    return [" ".join("changed" if k in (i, 2 * i) else w for k, w in enumerate(base)) for i in r.permutation(copies)]


def answers(spark, rows, **how):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["fingerprint"], -1 if r["component_id"] is None else r["component_id"]) for r in sd.near_duplicates(docs, **how).collect())


@pytest.mark.parametrize("limit", [sd.LIMIT, 60])
def test_components_equal_brute_force(spark, limit):
    texts = [*corpus(1, 12, 8), *corpus(3, 1, 2), *corpus(4, 1, 2)[:1] * 3, *family(90), None, "", " \n", "one", "One", "a b c", "a b c d", "A\tb\x0bc\x0cd", "é É x y z", " non breaking", "same words " * 300]
    rows = [(7 * k % 1009, t) for k, t in enumerate(texts)]
    rows += [(None, texts[0]), (None, "nobody else has this one"), (rows[3][0], texts[3])]
    assert answers(spark, rows, limit=limit) == brute_components(rows)


def test_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "a b c d e")], "doc_id long, text string").withColumns({c: F.lit(0) for c in ("fp", "key", "n", "label", "component")})
    assert sorted(map(tuple, sd.near_duplicates(docs).select("doc_id", "component_id").collect())) == [(1, 1), (2, 1)]
    assert sd.near_duplicates(docs.limit(0)).count() == 0


def test_long_text_in_pieces_equals_the_whole(monkeypatch):
    texts = [" ".join(corpus(2, 3, 4)), "\n\n" + "word " * 50, "x" * 500, "a b c " * 4, ""]
    want = [brute_fingerprint(t) for t in texts]
    for chunk in (1, 7, 100, 1 << 20):
        monkeypatch.setattr(sd, "CHUNK", chunk)
        assert [sd.fingerprint(t.encode()) for t in texts] == want


def test_every_link_is_found_at_any_thresholds(spark):
    r = np.random.default_rng(9)
    base = r.integers(0, 1 << 63, 20, np.uint64)
    values = {int(b) for b in base}
    for b in base:
        for n in range(1, 7):
            for _ in range(8):
                x = int(b)
                for k in r.choice(64, n, replace=False):
                    x ^= 1 << int(k)
                values.add(x)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    classes = spark.createDataFrame([(v,) for v in signed], "fp long")
    groups = sd.bit_groups(classes)
    assert sorted(b for g in groups for b in g) == list(range(64)) and all(len(g) == sd.WIDTH for g in groups)
    pairs = {(x, y) for x in values for y in values if x < y and (x ^ y).bit_count() <= 4}
    for chosen in ([0, 0, 0, 1], [-1, 2, 1, -1], [4, -1, -1, -1], [1, 0, 1, -1], sd.thresholds(classes, groups, 4)):
        assert sum(e + 1 for e in chosen) == 5
        met = sd.probes(classes, groups, chosen).groupBy("key").agg(F.collect_list(F.when(F.col("home"), F.col("fp"))).alias("h"), F.collect_list("fp").alias("all")).collect()
        found = {(min(a % (1 << 64), b % (1 << 64)), max(a % (1 << 64), b % (1 << 64))) for m in met for a in m["h"] for b in m["all"]}
        assert pairs <= found


def test_allocation_is_least_cost():
    from itertools import product

    r = np.random.default_rng(4)
    for _ in range(20):
        cost = np.cumsum(np.column_stack([np.zeros(4), r.random((4, 5))]), axis=1).tolist()
        got = sd.allocate(cost, 4)
        total = lambda e: sum(c[x + 1] for c, x in zip(cost, e, strict=True))
        assert total(got) == pytest.approx(min(total(e) for e in product(range(-1, 5), repeat=4) if sum(e) == 1))


# --- clustering ------------------------------------------------------------------------------------


def brute_clusters(rows, k, rounds, dim):
    kept = [(i, [math.floor(256 * x) if math.isfinite(256 * x) else 256 * int(x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            if own := [v for (_, v), c in zip(kept, of, strict=True) if c == j]:
                centroids[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    done = [(i, *near(v)[::-1]) for i, v in kept]
    total = [sum(d for _, c, d in done if c == j) for j in range(len(centroids))]
    fits = lambda x: x if x < 1 << 63 else None
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i is None, i or 0), c, fits(d) is None, fits(d) or 0, fits(total[c]), fits(sum(total)), digest[c]) for i, c, d in done)


@pytest.mark.parametrize("scale", [1.0, 3e4, 1e5, 1e7, 1e9, 1e200, 1.5e307, "mixed"])
def test_clusters_are_exact_at_any_magnitude(spark, scale):
    r = np.random.default_rng(6)
    dim, n = 6, 90
    size = 10.0 ** r.integers(0, 12, (n, 1)) if scale == "mixed" else scale
    v = np.clip(r.normal(size=(n, dim)), -3, 3) * size
    v[5] = v[6] = v[7]
    rows = [(k, x) for k, x in enumerate(v.tolist())] + [(200, None), (201, [1.0]), (202, [float("nan")] * dim), (203, [None] * dim), (204, [float("inf")] * dim), (None, [0.5] * dim), (3, [-0.001] * dim), (3, [0.0] * dim)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("id", "vector", "x", "cluster")}).repartition(3)
    got = cc.clusters(table, k=7, rounds=3, dim=dim).collect()
    mine = sorted(((r["vec_id"] is None, r["vec_id"] or 0), r["cluster"], r["distance"] is None, r["distance"] or 0, r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in got)
    assert mine == brute_clusters(rows, 7, 3, dim)


def test_clusters_of_few_or_no_vectors(spark):
    rows = [(k, [float(k)] * 3) for k in range(4)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert len(cc.clusters(table, k=7, dim=3).collect()) == 4
    assert cc.clusters(table.limit(0), k=7, dim=3).count() == 0


def test_ways_meet_at_their_bounds():
    r = np.random.default_rng(8)
    for top in (10, cc.math.isqrt(cc.EXACT // 64) // 2, 1 << 24, 1 << 27, 1 << 31, 1 << 40):
        x, c = r.integers(-top, top, (9, 64)), r.integers(-top, top, (5, 64))
        want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, q, strict=True)) for q in c] for p in x]
        assert cc.squared(x, c).tolist() == want
