"""The streaming transducer: every byte goes through it, in pieces of any size, in bounded memory."""

import os
import resource

import numpy as np
import pytest

from gridweave.llm import bpe

DATA = "/root/testdata/sf0.01/documents.parquet"

PIECES = [" ", "  ", "\n", "\t", " \n ", "a", "bc", "'s", "'", "'ll", "'r", "e", "1", "23", "é", "ß", "!", "--", "...", "<|end", "oftext|>", "<|endoftext|>", "the", " of", "日本", "\xa0", "\u2003",
          "a" * 300, " " * 400, "=" * 700, "7" * 300, "\n" * 300, "'" * 280, "é" * 200]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


@pytest.fixture(scope="module")
def merges():
    with open(bpe.default_path(), "rb") as f:
        return bpe.MergeList(f.read())


def test_any_cuts_give_the_same_ids(library, merges):
    r = np.random.default_rng(3)
    encoder = bpe.Encoder(merges)
    for _ in range(1500):
        text = "".join(PIECES[k] for k in r.integers(len(PIECES), size=r.integers(25)))
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(text.encode()), "<u4").tolist() == want, repr(text)
        cuts, at = [], 0
        while at < len(text):
            step = int(r.choice([1, 2, 3, 5, 20, 200]))
            cuts.append(text[at : at + step])
            at += step
        assert np.frombuffer(encoder.stream_out(cuts), "<u4").tolist() == want, (repr(text), cuts)


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test data")
def test_every_byte_of_real_texts_goes_through_the_transducer(library, merges):
    """With the memory of arcs off, the transducer's count of bytes is the texts'."""
    import pyarrow.parquet as pq

    texts = [t or "" for t in pq.read_table(DATA)["text"].to_pylist()]
    encoder = bpe.Encoder(merges)
    for t in texts:
        assert np.frombuffer(encoder.encode(t.encode()), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids
    stream, arcs = encoder.stream, encoder.stream.arcs
    assert stream.transducer.seen == sum(len(a.encode()) for a in arcs)  # each arc was taken once
    bare, some = bpe.Encoder(merges), texts[:60]
    bare.stream.arcs.__class__ = type("Forgetful", (bpe._Arcs,), {"__setitem__": lambda *_: None})
    for t in some:
        assert bare.encode(t.encode()) == encoder.encode(t.encode())
    assert bare.stream.transducer.seen == sum(len(t.encode()) for t in some)


def test_a_long_text_needs_no_more_than_its_ids(merges):
    encoder = bpe.Encoder(merges)
    encoder.encode(b"some words to begin with")
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    pieces = (x for _ in range(400) for x in ("word " * 3000, "x" * 20_000, " \n" * 5000))
    out = encoder.stream_out(pieces)  # 18 MB of text
    assert len(out) > 4_000_000
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 100_000  # KB
    assert len(encoder.stream.held) == len(encoder.stream.transducer.buffer) == 0


def test_ill_formed_bytes_and_ends(merges):
    encoder, decoder = bpe.Encoder(merges), bpe.Decoder(merges)
    for data in (b"\xff\xfe a", b"a \xe6\xbc", "漢".encode() * 40_000 + b"\xe6"):
        ids = np.frombuffer(encoder.encode(data), "<u4")
        assert decoder.text(ids) == data.decode("utf-8", "replace")


def test_edges(spark):
    rows = [(None, "a b", 1), (None, "a b", 1), (3, None, 2), (4, "", 3), (5, "long " * 50_000, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted(((d["doc_id"] or 0, d["n_tokens"], len(d["decoded"])) for d in bpe.encode_decode(docs).collect()))
    assert got == [(0, 2, 3), (0, 2, 3), (3, 0, 0), (4, 0, 0), (5, 50_001, 250_000)]
    assert bpe.encode_decode(docs.limit(0)).count() == 0


def test_classes_are_the_librarys_at_every_code_point(library, merges):
    cut = library.pre_tokenizer.pre_tokenize_str
    stream = bpe.Stream(merges)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 8192):
        some = points[k : k + 8192]
        for exact, own in enumerate((set(some) - stream.odd, set(some) & stream.odd)):
            text = "".join(f"a{c}a1{c}1!{c}! {c} {c}a\n" for c in sorted(own))
            assert [e for _, (_, e) in cut(text)] == [m.end() for m in stream.patterns[exact][0].finditer(text)]
    for text in ("\U0001df48蜛", "\U00018e08葢"):
        assert np.frombuffer(bpe.Encoder(merges).encode(text.encode()), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_memory_of_arcs_is_bounded_and_keeps_what_is_met_again(library, merges, monkeypatch):
    monkeypatch.setattr(bpe, "ARCS", 50, raising=False)
    encoder = bpe.Encoder(merges)
    arcs = encoder.stream.arcs
    for k in range(300):
        text = f"the same words, then other{'abcdefghij'[k % 10] * (k // 10 + 1)}"
        assert np.frombuffer(encoder.encode(text.encode()), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(arcs) + len(arcs.older) <= 100
    taken = encoder.stream.transducer.seen
    encoder.encode(b"the same words")
    assert encoder.stream.transducer.seen == taken


def test_a_batch_gives_what_each_text_gives_and_takes_a_distinct_unit_once(library, merges):
    import pyarrow as pa

    r = np.random.default_rng(11)
    texts = ["".join(PIECES[k] for k in r.integers(len(PIECES), size=r.integers(25))) for _ in range(1500)] + ["", None, "\u1680 x", "\u3000 x", "é x", "a <|endoftext|> b", " a", "  a"]
    for column in (pa.array(texts), pa.array([None, "gone", *texts]).slice(2)):
        got = bpe.Encoder(merges).encode_all(column).to_pylist()
        for t, ids in zip(texts, got, strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(t or "", add_special_tokens=False).ids, repr(t)
    odd = [b"\xc3 a b", b"a \xe6\xbc b", b"\xff\xfe \xc5\xff c"]
    for data, ids in zip(odd, bpe.Encoder(merges).encode_all(pa.array(odd, pa.binary())).to_pylist(), strict=True):
        assert ids == bpe.Encoder(merges).encode(data)
    assert bpe.Encoder(merges).encode_all(pa.array([], pa.string())).to_pylist() == []
    encoder, met = bpe.Encoder(merges), []
    whole = encoder.stream.whole
    encoder.stream.whole = lambda text: met.append(text) or whole(text)
    encoder.encode_all(pa.array(["x" + " the same words" * 200] * 50))
    assert sum(map(len, met)) == len(" the same words")


def test_neighbours_by_their_merges_are_those_of_the_definition(merges):
    r = np.random.default_rng(5)
    tokens = [i for i in merges.ids.values() if merges.alone(i)]
    pairs = [tuple(r.choice(tokens, 2).tolist()) for _ in range(3000)]
    for i in r.choice(tokens, 3000).tolist():  # cuts of tokens mostly have a merge across
        cut = int(r.integers(1, max(2, len(merges.bytes[i]))))
        pairs += [(merges.ids[a], merges.ids[b]) for a, b in ((merges.bytes[i][:cut], merges.bytes[i][cut:]),) if a in merges.ids and b in merges.ids]
    want = [merges.merge(merges.bytes[a] + merges.bytes[b]) == [a, b] for a, b in pairs]
    assert merges.split is not None and {True, False} == set(want)
    assert [merges.fits(a, b) for a, b in pairs] == want


def test_the_drivers_python_gives_back_what_it_took_for_the_classes():
    import subprocess
    import sys

    code = """
import re
import pyarrow
from gridweave.llm import bpe
def held():
    return sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024
before = held()
bpe.char_classes(open(bpe.default_path(), "rb").read())
print(held() - before)
"""
    got = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    assert float(got.stdout) < 25  # MB; 44 before
