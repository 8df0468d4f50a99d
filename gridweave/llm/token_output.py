"""Token ids in files: tokenise, order by doc_id, compress in rANS blocks, read back.

A file set is a folder of shards; a shard is a run of documents in ascending doc_id order (null
ids last), held as blocks of whole documents. Blocks are written by Spark's own committer to the
shared folder, so a lost executor's blocks are written again and none is seen twice. A block holds
its documents' ids and lengths and its symbols by the method of rans.py; the frequency table is
counted over all documents and stored once beside the blocks.

Nulls and odd inputs: a null text is an empty text and has the end id only. Rows with a null
doc_id come last. Rows that share a doc_id follow each other, ordered by their ids' hash; equal
rows have consecutive places. An empty table gives an empty file set. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import doc_view, drop_stored, map_batches, small, stored, table_path
from .pieces import distinct_pieces, joined
from .rans import Table, decode_block, encode_block

#: Id appended to each document.
END_ID = 2

#: Symbols of a block at least, unless the shard ends; a document is never split.
BLOCK_IDS = 1 << 18

#: Symbols of a shard about.
SHARD_IDS = 1 << 23

#: A run of these after letters is a pre-token of its own.
MARKS = "!#$%&*.,:;?|"

#: Entries of a worker's memory of words; it is emptied when full and changes no result.
MEMORY = 600_000

_LOADED: dict[str, WordCoder] = {}


class WordCoder:
    """A whole text by the tokenizers library, which meets each distinct word once.

    The file's pre-tokenizer drops white space and no token spans it, so a text's ids are those of
    its pieces between ASCII white space. Letters below U+0300 are their own normal form; of those a
    piece of letters, or of letters and then marks, is looked up in lower case. All other pieces go to
    the library as they are.
    """

    def __init__(self, source: bytes):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_buffer(source)
        self.lib.no_truncation()
        self.lib.no_padding()
        vocab = self.lib.get_vocab(with_added_tokens=True)
        self.size = max(vocab.values()) + 1
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.ends = np.zeros(self.size, bool)
        for token, i in vocab.items():
            self.ends[i] = token.endswith("</w>")
        self.known: dict[str, bytes] = {}
        self.lower = _words_only(source)

    def _pack(self, ids) -> bytes:
        return np.asarray(ids, self.dtype).tobytes()

    def _library(self, pieces: list[str]) -> None:
        for piece, got in zip(pieces, self.lib.encode_batch_fast(pieces, add_special_tokens=False), strict=True):
            self.known[piece] = self._pack(got.ids)

    def _words(self, words: list[str], group: int = 250) -> None:
        """Lower-case words of letters, many to a call: each ends with the one token that ends a word."""
        groups = [words[k : k + group] for k in range(0, len(words), group)]
        width = self.dtype.itemsize
        for some, got in zip(groups, self.lower.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(got.ids, self.dtype)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(some):
                self._library(some)
                continue
            blob, at = ids.tobytes(), 0
            for word, cut in zip(some, (cuts * width).tolist(), strict=True):
                self.known[word] = blob[at:cut]
                at = cut

    def _values(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece. Only words are remembered: they are fewer than the pieces made of them."""
        known = self.known
        if len(known) > MEMORY:
            known.clear()
        known[""] = b""
        values: list[bytes | None] = []
        split: list[tuple[int, str, str]] = []
        fresh: set[str] = set()
        others: list[str] = []
        for k, p in enumerate(pieces):
            got = known.get(p)
            values.append(got)
            if got is not None:
                continue
            low = p.lower()
            word = low.rstrip(MARKS)
            mark = low[len(word) :]
            if word and (not word.isalpha() or not word.isascii() and max(word) >= "\u0300"):
                word, mark = "", p
            if word not in known:
                fresh.add(word)
            if mark and mark not in known:
                others.append(mark)
            split.append((k, word, mark))
        self._words(list(fresh))
        self._library(list(dict.fromkeys(others)))
        for k, word, mark in split:
            values[k] = known[word] + known[mark] if mark else known[word]
        return values

    def encode(self, texts: pa.Array) -> list[bytes]:
        offsets, codes, pieces = distinct_pieces(texts)
        values = self._values(pieces)
        end = self._pack([END_ID])
        return [x + end for x in joined(offsets, codes, values, self.dtype)]


def coder(source: bytes) -> WordCoder:
    key = hashlib.sha256(source).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = WordCoder(source)
    return _LOADED[key]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _words_only(source: bytes):
    """The same model for text that is normal, in lower case and made of words and spaces already."""
    from tokenizers import Tokenizer

    spec = json.loads(source)
    bytewise = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
    spec |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, bytewise]}}
    return Tokenizer.from_str(json.dumps(spec))


# --- the file format ---------------------------------------------------------------------------


def pack_block(doc_ids: list[int | None], ids: list[np.ndarray], table: Table) -> bytes:
    """Documents' ids and lengths (deflated, with a null map), then the symbols."""
    known = np.array([d is not None for d in doc_ids], np.uint8)
    plain = np.array([d or 0 for d in doc_ids], "<i8")
    sizes = np.array([len(x) for x in ids], "<u4")
    deltas = np.diff(plain, prepend=np.int64(0))
    head = zlib.compress(known.tobytes() + deltas.astype("<i8").tobytes() + sizes.tobytes(), 1)
    symbols = np.concatenate(ids) if ids else np.empty(0, np.uint32)
    return struct.pack("<IIQ", len(doc_ids), len(head), len(symbols)) + head + encode_block(symbols.astype(np.int64), table)


def unpack_block(blob: bytes, table: Table) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc ids, lengths, symbols)."""
    n, size, _ = struct.unpack_from("<IIQ", blob)
    at = struct.calcsize("<IIQ")
    head = zlib.decompress(blob[at : at + size])
    known = np.frombuffer(head, np.uint8, n)
    plain = np.cumsum(np.frombuffer(head, "<i8", n, n))
    sizes = np.frombuffer(head, "<u4", n, 9 * n)
    return [int(d) if k else None for d, k in zip(plain, known, strict=True)], sizes, decode_block(blob[at + size :], table)


def tokenised(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id long, ids binary (16-bit integers if the vocabulary allows, else 32-bit), n_tokens."""
    with open(path or default_path(), "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = coder(shared.value)
        ids = own.encode(batch["text"])
        width = own.dtype.itemsize
        return pa.record_batch({"doc_id": batch["doc_id"].cast(pa.int64()), "ids": pa.array(ids, pa.binary()), "n_tokens": pa.array([len(x) // width for x in ids], pa.int64())})

    return map_batches(doc_view(docs, "doc_id", "text"), run, "doc_id long, ids binary, n_tokens long")


def symbol_counts(tokens: DataFrame, size: int, dtype: str) -> np.ndarray:
    """How often each id occurs: a vector of the vocabulary's length, whatever the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            column = batch["ids"]
            _, offsets, data = column.buffers()
            ends = np.frombuffer(offsets, np.int32, len(column) + 1, 4 * column.offset)
            if ends[-1] > ends[0]:
                ids = np.frombuffer(data, dtype, (ends[-1] - ends[0]) // np.dtype(dtype).itemsize, ends[0])
                total += np.bincount(ids, minlength=size)
        used = np.flatnonzero(total)
        yield pa.record_batch({"id": pa.array(used, pa.int32()), "n": pa.array(total[used], pa.int64())})

    rows = tokens.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(size, np.int64)
    counts[rows["id"].to_numpy(int)] = rows["n"].to_numpy(int)
    return counts


def write_tokens(docs: DataFrame, folder: str | None = None, path: str | None = None) -> str:
    """Tokenise docs and write a file set; returns its folder."""
    spark = docs.sparkSession
    folder = folder or table_path(spark, "tokens")
    with open(path or default_path(), "rb") as f:
        meta = coder(f.read())
    size, dtype = meta.size, meta.dtype.str
    tokens = stored(tokenised(docs, path), "ids")
    counts = symbol_counts(tokens, size, dtype)
    table = spark.sparkContext.broadcast(counts)
    shards = max(1, -(-int(counts.sum()) // SHARD_IDS), spark.sparkContext.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Table(table.value)
        shard = block = waiting = 0
        names: list[int | None] = []
        ids: list[np.ndarray] = []

        def made() -> pa.RecordBatch:
            nonlocal block, waiting, names, ids
            blob = pack_block(names, ids, own)
            row = {"shard": [shard], "block": [block], "n_docs": [len(names)], "n_ids": [waiting], "payload": [blob]}
            block, waiting, names, ids = block + 1, 0, [], []
            return pa.RecordBatch.from_pydict(row, pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary())]))

        for batch in batches:
            for doc, blob, part in zip(batch["doc_id"].to_pylist(), batch["ids"].to_pylist(), batch["part"].to_pylist(), strict=True):
                shard = part
                names.append(doc)
                ids.append(np.frombuffer(blob, dtype))
                waiting += len(ids[-1])
                if waiting >= BLOCK_IDS:
                    yield made()
        if names:
            yield made()

    tie = F.xxhash64("ids")
    ordered = (
        tokens.select("doc_id", "ids", tie.alias("tie"), F.monotonically_increasing_id().alias("row"))
        .repartitionByRange(shards, F.col("doc_id").asc_nulls_last(), "tie", "row")
        .sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "tie", "row")
        .select("doc_id", "ids", F.spark_partition_id().alias("part"))
    )
    ordered.mapInArrow(run, "shard int, block int, n_docs long, n_ids long, payload binary").write.option("compression", "none").parquet(f"{folder}/blocks")
    spark.createDataFrame([(bytearray(counts.astype("<i8").tobytes()),)], "counts binary").coalesce(1).write.parquet(f"{folder}/table")
    drop_stored(tokens)
    return folder


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, ids (little-endian 32-bit integers) of every document, decoded from the file set."""
    counts = np.frombuffer(bytes(spark.read.parquet(f"{folder}/table").head()[0]), "<i8")
    table = spark.sparkContext.broadcast(counts)
    blocks = spark.read.parquet(f"{folder}/blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Table(table.value)
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                names, sizes, ids = unpack_block(row["payload"][0].as_py(), own)
                ends = np.cumsum(sizes.astype(np.int64))
                yield pa.record_batch(
                    {
                        "shard": pa.array([row["shard"][0].as_py()] * len(names), pa.int32()),
                        "block": pa.array([row["block"][0].as_py()] * len(names), pa.int32()),
                        "doc_id": pa.array(names, pa.int64()),
                        "within": pa.array(ends - sizes, pa.int64()),
                        "n_tokens": pa.array(sizes, pa.int64()),
                        "ids": pa.array([ids[a:b].astype("<u4").tobytes() for a, b in zip(ends - sizes, ends, strict=True)], pa.binary()),
                    }
                )

    first = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # over a row a shard
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", F.coalesce(F.sum("n").over(first), F.lit(0)).alias("base"))
    own = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("shard", "block", "n_ids").withColumn("own", F.coalesce(F.sum("n_ids").over(own), F.lit(0))).join(shards, "shard")
    offsets = stored(offsets.select("shard", "block", (F.col("base") + F.col("own")).alias("offset")), "offsets")
    decoded = blocks.select("shard", "block", "payload").mapInArrow(run, "shard int, block int, doc_id long, within long, n_tokens long, ids binary")
    joined = decoded.join(small(offsets, offsets.count()), ["shard", "block"])
    return joined.select("doc_id", (F.col("offset") + F.col("within")).alias("start"), "n_tokens", "ids")
