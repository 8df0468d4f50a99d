"""Registered queries over whole tables against their contracts: brute force, held-out labels."""

import os
import zlib

import numpy as np
import pandas as pd
import pytest
from test_corpus_operators import brute_targets
from test_text_operators import brute_license, brute_stats

from gridweave.llm.queries import QUERIES

DATA, LABELLED = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{DATA}/documents.parquet").sort_values("doc_id")


@pytest.fixture(scope="module")
def texts(docs):
    return {k: t or "" for k, t in zip(docs["doc_id"].tolist(), docs["text"], strict=True)}


def rows_of(spark, name, texts):
    rows = QUERIES[name](spark, DATA).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(got) and set(got) == set(texts)
    return got


def test_license_scan(spark, texts):
    got = rows_of(spark, "op1_license_scan", texts)
    for k, t in texts.items():
        n, places, labels = brute_license(t)
        r = got[k]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (n, len(places), ",".join(labels))
        assert (r["first_word"], r["last_word"]) == ((places[0], places[-1]) if places else (None, None))
        assert set(labels) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_quality_rules(spark, texts):
    got = rows_of(spark, "op2_quality_rules", texts)
    for k, t in texts.items():
        r, want = got[k], brute_stats(t)
        assert [r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] == want
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert r["base_failed"] == failed and not (failed and r["kept"])


@pytest.mark.skipif(not os.path.isdir(LABELLED), reason="no test data")
def test_quality_classifier_on_held_out_labels(spark):
    labels = pd.read_parquet(f"{LABELLED}/labels.parquet").dropna(subset=["doc_id", "quality"])
    quality = dict(zip(labels["doc_id"].tolist(), labels["quality"].tolist(), strict=True))
    good, bad = [], []
    for r in QUERIES["op3_quality_classifier"](spark, LABELLED).collect():
        held = zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
        assert r["held_out"] == held and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        if held and r["doc_id"] in quality:
            (good if quality[r["doc_id"]] == 1 else bad).append(r["score"])
    assert good and bad
    wins = np.array(good)[:, None] - np.array(bad)
    assert ((wins > 0) + 0.5 * (wins == 0)).mean() >= 0.95


def test_mixing(spark, docs, texts):
    got = rows_of(spark, "op5_mixing", texts)
    source = dict(zip(docs["doc_id"].tolist(), docs["source"], strict=True))
    sizes, largest, taken = {}, {}, {}
    for k, t in texts.items():
        s, size = source[k], brute_stats(t)[0]
        sizes[s], largest[s] = sizes.get(s, 0) + size, max(largest.get(s, 0), size)
        taken[s] = taken.get(s, 0) + got[k]["taken"]
        assert got[k]["size"] == size and got[k]["taken"] <= 2 * size
    want = brute_targets(sizes)
    for k in texts:
        assert got[k]["source_size"] == sizes[source[k]] and got[k]["target"] == pytest.approx(want[source[k]])
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in sizes)


def test_bpe_ids_and_decoded_text(spark, texts):
    import hashlib

    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_truncation()
    library.no_padding()
    got = rows_of(spark, "op9_bpe", texts)
    for k, t in texts.items():
        ids = library.encode(t, add_special_tokens=False).ids
        r = got[k]
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def passes_luhn(digits):
    return sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def brute_personal(t):
    import re

    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(re.sub("[^0-9]", "", m)) <= 19 and passes_luhn(re.sub("[^0-9]", "", m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
    }
    return {kind: [(m.start(), m.end()) for m in re.finditer(p, t) if good(m[0])] for kind, (p, good) in rules.items()}


def test_personal_data_base(spark, texts):
    import hashlib

    got = rows_of(spark, "op6_personal_data", texts)
    found = 0
    for k, t in texts.items():
        want = brute_personal(t)
        spans = ",".join(f"{kind}:{a}:{b}" for kind, own in want.items() for a, b in own)
        r = got[k]
        assert [r[f"n_{kind}"] for kind in want] == [len(own) for own in want.values()]
        assert r["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()
        assert set(filter(None, spans.split(","))) <= set(r["spans"].split(","))
        found += len(spans) > 0
    assert found


def test_cards_that_follow_each_other_stay_several():
    from gridweave.llm.pii import _cards

    one = "4465758382889437"
    text = f"x {one} {one}, 4111 1111 1111 1111 y"
    assert _cards(text, 2, 18) == [(2, 18)] and _cards(text, 2, 35) == [(2, 18), (19, 35)]
    assert _cards(text, 2, len(text) - 2) == [(2, 18), (19, 35), (37, 56)]
    assert _cards("1234 5678", 0, 9) == [] and _cards("0" * 33, 0, 33) == []
