"""Paths that only large tables take: shuffled joins instead of broadcasts, hubs, hot tokens, blocks; and the bounds of what is broadcast."""

import numpy as np
import pytest
from test_corpus_operators import brute_components, brute_sets, docs_of, lines_by_sql, variants

from gridweave.llm import common, components, jaccard_join, line_dedup, mixing, permutation_index, token_output


def near_copies(seed, families=5, each=30):
    r = np.random.default_rng(seed)
    passage = [f"p{k}" for k in range(60)]
    texts = []
    for f in range(families):
        base = [f"{f}w{k}" for k in range(int(r.integers(30, 80)))]
        texts += [variants(r, base, int(r.integers(0, 7))) for _ in range(each)]
    return texts + [" ".join([*passage[: int(r.integers(30, 60))], *(str(r.integers(10**6)) for _ in range(12))]) for _ in range(60)]


def same_components(spark, texts):
    rows = [(k, t, "s") for k, t in enumerate(texts)]
    got = {d["doc_id"]: d["component_id"] for d in jaccard_join.near_duplicates(docs_of(spark, rows)).collect()}
    return got == brute_components(list(range(len(texts))), brute_sets(texts))


def test_hot_tokens_change_no_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SAMPLE", 1)
    monkeypatch.setattr(jaccard_join, "HOT", 4)
    texts = near_copies(1)
    tokens, freq = jaccard_join.hot_tokens(jaccard_join.class_sets(docs_of(spark, [(k, t, "s") for k, t in enumerate(texts)])))
    assert len(tokens) > 100 and freq.min() >= 4 and (np.diff(tokens.astype(object)) > 0).all()
    assert same_components(spark, texts)


def test_large_families_are_dealt_by_prefix_tokens(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_NODES", 6)
    assert same_components(spark, near_copies(2))


def test_nothing_needs_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(components, "HUB", 3)
    texts = near_copies(3, 3, 20)
    assert same_components(spark, texts)
    links = spark.createDataFrame([(0, k) for k in range(1, 40)] + [(k, k + 100) for k in range(40)], "a long, b long")
    assert {r["component"] for r in components.components(links).collect()} == {0}
    r = np.random.default_rng(4)
    rows = [(k, "\n".join(r.choice(["a", "bb", "a long line of text", "another long line"], r.integers(1, 9)))) for k in range(40)]
    got = line_dedup.dedup_lines(docs_of(spark, [(i, t, "s") for i, t in rows]), 6).collect()
    assert {d["doc_id"]: (d["__gw_lines"], d["__gw_gone"], d["text"]) for d in got} == lines_by_sql(rows, 6)


@pytest.mark.parametrize("module", [jaccard_join, components, line_dedup, mixing, token_output, permutation_index])
def test_no_broadcast_exceeds_its_counted_rows(spark, monkeypatch, module, tmp_path):
    seen = []

    def checked(df, rows, *more):
        seen.append((df.count(), rows))
        return common.small(df, rows, *more)

    monkeypatch.setattr(module, "small", checked)
    if module is jaccard_join:
        monkeypatch.setattr(jaccard_join, "BLOCK_NODES", 6)
    docs = docs_of(spark, [(k, t, "ab"[k % 2]) for k, t in enumerate([*near_copies(5, 3, 15), "x y z", "x y z"] * 2)])
    if module is line_dedup:
        line_dedup.dedup_lines(docs, 6)
    elif module is mixing:
        mixing.mixed(docs).collect()
    elif module is token_output:
        token_output.read_tokens(spark, token_output.write_tokens(docs, str(tmp_path / "set"))).collect()
    elif module is permutation_index:
        permutation_index.nearest(spark.createDataFrame([(k, [float(k % 7), 1.0, 2.0]) for k in range(200)], "vec_id long, embedding array<double>")).collect()
    else:
        jaccard_join.near_duplicates(docs).collect()
    assert seen and all(there <= told for there, told in seen)


def test_the_second_order_filters_beyond_the_first():
    """Candidates of the first order alone, of both, and links: the second drops a third of the pairs that are none, and no link."""
    r = np.random.default_rng(6)
    pool = r.integers(0, 2**63, 600, np.int64).astype(np.uint64)
    sets = [np.sort(r.choice(600, 40, replace=False)) for _ in range(150)]
    sets += [np.unique(np.append(s[:-2], r.integers(600, size=2))) for s in sets[:50]]
    freq = np.bincount(np.concatenate(sets), minlength=600)
    prefix = lambda s, *key: set(s[np.lexsort(key)[: len(s) - -(-len(s) * 75 // 100) + 1]].tolist())
    first = [prefix(s, pool[s], freq[s]) for s in sets]
    second = [prefix(s, jaccard_join.finalised(pool[s])) for s in sets]
    one = both = links = 0
    for a in range(len(sets)):
        for b in range(a):
            common_ = len(np.intersect1d(sets[a], sets[b]))
            link = 100 * common_ >= 75 * (len(sets[a]) + len(sets[b]) - common_)
            one += bool(first[a] & first[b])
            both += bool(first[a] & first[b] and second[a] & second[b])
            links += link
            assert not link or (first[a] & first[b] and second[a] & second[b])
    assert links >= 50 and both - links < 0.67 * (one - links)


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Remote:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError):
        common.shared_dir(Remote)
    assert common.shared_dir(spark)


def test_mixing_by_hubs_gives_the_same_copies(spark, monkeypatch):
    from gridweave.llm import common, mixing

    rows = [(k, "the same words here" if k % 3 == 0 else f"document {k} " * (k % 7 + 1), "ab"[k % 2]) for k in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sorted(map(tuple, mixing.mixed(docs).select("doc_id", "taken").collect()))
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(mixing, "HUB", 10)
    monkeypatch.setattr(mixing, "HUBS", 1 << 40)
    assert sorted(map(tuple, mixing.mixed(docs).select("doc_id", "taken").collect())) == want


def test_a_round_of_few_links_is_a_shuffle_shorter(spark, monkeypatch):
    links = [(k, k // 2) for k in range(1, 60)] + [(k, 0) for k in range(1, 20)] + [(100, 101), (101, 100), (102, 102)]
    edges = spark.createDataFrame(links, "a long, b long")
    found = []
    for most in (common.BROADCAST_BYTES, 0):
        monkeypatch.setattr(common, "BROADCAST_BYTES", most)
        plan = components._star(edges, True, len(links))._jdf.queryExecution().optimizedPlan().toString()
        assert (plan.count("Aggregate [") == 1) == (most > 0)  # the minima alone; 2 before
        found.append({r["node"]: r["component"] for r in components.components(edges).collect()})
    assert found[0] == found[1] == {**dict.fromkeys(range(60), 0), 100: 100, 101: 100}
