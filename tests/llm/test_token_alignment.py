"""Cross-tokenizer alignment against the two libraries and a plain count over whole texts."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridweave.llm import common
from gridweave.llm import token_alignment as ta
from gridweave.llm.bpe import byte_alphabet

NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def libraries():
    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def brute(libraries, texts):
    first, second = libraries
    alphabet = byte_alphabet()
    docs = []
    for t in texts:
        whole = f" {t}".encode() if t else b""
        a = first.encode(f" {t}", add_special_tokens=False).ids if t else []
        b = second.encode(t) if t else []
        ab = [bytes(alphabet[c] for c in first.id_to_token(i)) for i in a]
        bb = [bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if b"".join(ab) != whole or b"".join(bb) != whole:
            a = b = ab = bb = []
        docs.append((a, np.cumsum([len(x) for x in ab]).tolist(), b, np.cumsum([len(x) for x in bb]).tolist()))
    links = [[(x, y) for x, e in zip(a, ae, strict=True) for y, f in zip(b, be, strict=True) if e == f] for a, ae, b, be in docs]
    n = Counter(p for own in links for p in own)
    most = {}
    for (_, y), k in n.items():
        most[y] = max(most.get(y, 0), k)
    out = []
    for (a, ae, b, be), own in zip(docs, links, strict=True):
        cuts, at, groups = sorted(set(ae) & set(be)), 0, []
        for c in cuts:
            groups.append("|".join(",".join(str(x) for x, e in zip(ids, ends, strict=True) if at < e <= c) for ids, ends in ((a, ae), (b, be))))
            at = c
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        out.append((len(a), len(b), len(groups), len(own), sum(n[p] == most[p[1]] for p in own), sum(n[p] for p in own), digest))
    return out


def texts_of(seed, count):
    r = np.random.default_rng(seed)
    pool = ["the", "The", "café", "naïve", "don't", "x=1;", "1234567", "\n", "\t", "  ", "   ", "", "日本語", "𝔘nicode", "ﬁ", "<|endoftext|>", "<s>", "</s>", "<0x41>", "…", "　", " ", "\x85", "\x1c", "á", "\r\n", "\x00", "aaaaaaaaaaaaaaaa", "supercalifragilistic", "İ", "'s", "ʼs", "​", "👩‍👩‍👧"]
    return [(" " if r.random() < 0.8 else "").join(r.choice(pool, r.integers(1, 40))) for _ in range(count)]


@pytest.mark.parametrize("limit", [None, 60 * ta.PAIR_BYTES, 0])
def test_alignment_equals_the_libraries(spark, libraries, limit):
    texts = [*texts_of(3, 250), None, "", " ", "  ", "a ", " a", "a  b", "with ▁ mark", "▁", "▁x", "a\n b", "a\n  b", "a \nb", "x" * 3000, "word " * 500, "the same text twice", "the same text twice"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: tuple(r[c] for c in NAMES) for r in ta.alignments(docs, limit=limit).collect()}
    assert [got[k] for k in range(len(texts))] == brute(libraries, texts)


def test_edges(spark, libraries):
    rows = [(None, "one text"), (7, "one text"), (7, "one text"), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("row", "pos", "units", "a", "pair")})
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, *(r[c] for c in NAMES)) for r in ta.alignments(docs).collect())
    want = brute(libraries, [t for _, t in rows])
    assert got == sorted((k is None, k or 0, *w) for (k, _), w in zip(rows, want, strict=True))
    empty = ta.alignments(docs.limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", *NAMES]


def test_small_memory_and_pieces_change_nothing(spark, libraries, monkeypatch):
    texts = [*texts_of(5, 60), "x " * 4000]
    own = ta.Coder(*(open(p, "rb").read() for p in ta.default_paths()))
    monkeypatch.setattr(ta, "MEMORY", 5)
    monkeypatch.setattr(ta, "CALL", 7)
    first, second = libraries
    for u in {u for t in texts for u in own.units(t)}:
        own.learn([u])
        got = own.known[u]
        want = (first.encode(f" {u}", add_special_tokens=False).ids, second.encode(u) or [second.piece_to_id("▁")])
        assert got is None or tuple(np.frombuffer(x, np.int32).tolist() for x in got) == want


def test_byte_encoder_equals_the_library_at_every_code_point(libraries):
    encode = ta.byte_encoder(open(ta.default_paths()[0], "rb").read())
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 4096):
        texts = [f"a{c}a1{c}1!{c}! {c} {c}a" for c in points[k : k + 4096]]
        whole = "\n".join(texts)
        assert encode(whole).tolist() == libraries[0].encode(whole, add_special_tokens=False).ids


def test_frequent_units_are_aligned_once_for_all_batches(spark):
    texts = [f"the same few words in every text but word{k}" for k in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    rows = ta.frequent(docs).collect()
    units = [u for r in rows for u in r["units"]]
    assert set(units) == set("the same few words in every text but".split())
    sizes = [np.concatenate([r[c] for r in rows]).astype(np.int32) for c in ("u_a", "u_b")]
    batches = ta.tokenised(docs, (units, sizes)).collect()
    assert sum(len(r["u_a"]) for r in batches) == 40 and all(n == 1 for r in batches for n in r["a_times"])
    met = Counter()
    for r in batches:
        met.update({units[x["code"]]: x["times"] for x in r["often"]})
    assert met == dict.fromkeys(units, 40)


def test_heavy_rows_go_to_python_and_to_files_a_few_at_a_time(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.record_batch({"text": batch["text"], "held": [batch.num_rows] * batch.num_rows})

    before = {k: spark.conf.get(k, None) for k in common.HEAVY}
    rows = spark.range(40, numPartitions=1).select(F.repeat(F.sha2(F.col("id").cast("string"), 256), 16_000).alias("text"))  # 1 MB each
    out = common.stored(rows.mapInArrow(sizes, "text string, held long"), "heavy", heavy=True)
    assert {k: spark.conf.get(k, None) for k in common.HEAVY} == before
    assert out.count() == 40 and max(r["held"] for r in out.select("held").collect()) <= 5
    for f in out.inputFiles():
        meta = pq.ParquetFile(f.removeprefix("file:")).metadata
        assert max(meta.row_group(k).num_rows for k in range(meta.num_row_groups)) <= 6


def test_settings_come_back_after_a_failure(spark):
    key = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(key)
    with pytest.raises(RuntimeError), common.settings(spark, {key: "7", "gridweave.unset": "x"}):
        assert spark.conf.get(key) == "7"
        raise RuntimeError
    assert spark.conf.get(key) == before and spark.conf.get("gridweave.unset", None) is None


def test_a_batch_is_copied_into_one_row_and_stored_alone(spark, libraries, monkeypatch):
    monkeypatch.setitem(common.HEAVY_FILES, "parquet.block.size", 64 << 10)
    seen, real = {}, ta.stored

    def stored(df, tag, *a, **k):
        plan = df._jdf.queryExecution().executedPlan().toString()
        seen[tag] = plan, real(df, tag, *a, **k)
        return seen[tag][1]

    monkeypatch.setattr(ta, "stored", stored)
    r = np.random.default_rng(11)
    texts = [" ".join(x.tobytes().decode() for x in r.integers(97, 123, (1200, 7), np.uint8)) for _ in range(400)]  # 3.8 MB, three batches
    texts[::50] = [t[:800] for t in texts[::50]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r for r in ta.alignments(docs).collect()}
    assert sorted(got) == list(range(400))
    own = [c for c in NAMES if c not in ("n_best", "count_sum")]  # the others need all texts
    for k, want in zip(range(0, 400, 50), brute(libraries, texts[::50]), strict=True):
        assert {c: got[k][c] for c in own} == {c: x for c, x in zip(NAMES, want, strict=True) if c in own}
    plan, base = seen["aligned"]
    assert "Join" not in plan and plan.count("Generate") == 1
    for f in base.inputFiles():
        meta = pq.ParquetFile(f.removeprefix("file:")).metadata
        assert meta.num_rows >= 4 and meta.num_row_groups >= 3
