"""Alignment of two tokenizers' tokens over the bytes of each text, and how often ids are linked.

Tasks tokenise: a text is cut where a space follows a character that isn't white space, which neither
tokenizer's tokens cross, so a text is a list of units. Units that are frequent in a bounded sample of texts are aligned
once for the whole table; a batch of texts holds the tokens of each other distinct unit once,
with how often it stands, and each text as its units' numbers, frequent ones first. The alignment is higher-order functions:
array_intersect of both tokenizations' ends gives a unit's cuts, from whose places groups and links are built in one step that
copies a batch into one row, and a text's groups are its units' by their numbers, put together and hashed in the last step. Links are counted over all texts, a unit's as
often as it stands, with map-side sums. While the pairs' counts fit a broadcast, tasks look links up in sorted arrays; beyond that
the most frequent pairs are broadcast and a rare pair's links meet its count by a shuffled join in which no pair is hot.

Which units are taken for frequent changes no result, only how often a unit is aligned.
A batch is about TOGETHER bytes or one longer text, a unit as long as its text only if no space follows another
character there. Every step is linear in the batch's tokens but for a sort of ascending runs.

Nulls and odd inputs: a text that is null or empty, or that one of the tokenizers doesn't give
back byte by byte after a leading space (U+2581 in it, as an example), has no tokens: zeros and
an empty groups string. A null doc_id is passed through, repeated rows are each aligned and counted, other columns
are ignored, ill-formed UTF-8 is read as U+FFFD. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_alphabet
from .common import BROADCAST_BYTES, doc_view, sliced, stored, trim

#: Bytes of texts that a task tokenises together, and bytes that a tokenizer gets in one call.
TOGETHER, CALL = 3 << 19, 1 << 14

#: Most frequent units that are aligned once, the most characters of one, and the texts and characters of a text that they are counted in.
MEMORY, SHORT = 120_000, 64
SAMPLE_ROWS, SAMPLE_CHARS = 6000, 1 << 16

#: What an id pair's first id is multiplied by in one number.
PAIR = 1 << 32

#: Bytes of a pair's row as a broadcast table holds it: key, count, flag and what a row takes.
PAIR_BYTES = 48

#: A unit begins with a space that follows what isn't white space to either tokenizer.
BORDER, UNSAFE = re.compile(r"(?<=\S) "), re.compile(r"\s ")

INTS = ("a", "a_ends", "a_of", "a_to", "a_times", "b", "b_ends", "b_of", "b_to", "u_a", "u_b", "u_to")
UNITS = ", ".join(f"{c} array<int>" for c in INTS) + ", a_last array<boolean>, a_text binary, b_text binary"
BATCH = UNITS + ", docs array<struct<doc_id: {id}, n_a: bigint, n_b: bigint, codes: array<int>>>, often array<struct<code: int, times: bigint>>"


def byte_encoder(source: bytes) -> Callable[[str], np.ndarray]:
    """Ids of a text by a byte-level file, special tokens' strings being text. Where ids ascend with the merges'
    ranks, as they do in the file of the contract, a vocabulary of ranks says all and tiktoken takes it;
    a test holds both libraries together over every code point."""
    spec = json.loads(source)
    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in merges]
    usual = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    if spec["pre_tokenizer"] == usual and not spec.get("normalizer") and made == sorted(set(made)):
        import public_tokenizers
        import tiktoken

        alphabet, merged = byte_alphabet(), set(made)
        ranks = {bytes(alphabet[c] for c in t): i for t, i in vocab.items() if i in merged or len(t) == 1}
        ranked = tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda text: ranked.encode_to_numpy(text, disallowed_special=()).astype(np.int32)
    from tokenizers import Tokenizer

    plain = Tokenizer.from_str(source.decode())
    plain.encode_special_tokens = True
    return lambda text: np.array(plain.encode(text, add_special_tokens=False).ids, np.int32)


class Coder:
    """Both tokenizers, which meet each distinct unit once."""

    def __init__(self, first: bytes, second: bytes):
        import sentencepiece

        self.a = byte_encoder(first)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=second)
        alphabet = byte_alphabet()
        vocab = json.loads(first)["model"]["vocab"]
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            self.a_bytes[i] = bytes(alphabet.get(c, 0) for c in t)  # a special token is never met
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.cuts = not any(re.search("[^▁]▁", p) for p in pieces)
        self.a_size, self.b_size = (np.array(list(map(len, x)), np.int32) for x in (self.a_bytes, self.b_bytes))
        self.a_name, self.b_name = ([b"%d," % i for i in range(len(x))] for x in (self.a_bytes, self.b_bytes))
        self.a_wide, self.b_wide = (np.array(list(map(len, x)), np.int32) for x in (self.a_name, self.b_name))
        self.space = np.array([self.b.piece_to_id("▁")], np.int32)
        self.known: dict[str, tuple[bytes, bytes] | None] = {}

    def both(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of a text by either tokenizer, None if they don't give a space and the text back."""
        x, y = self.a(f" {text}"), np.array(self.b.encode(text, num_threads=1), np.int32) if text else self.space
        whole = b" " + text.encode()
        back = b"".join(map(self.a_bytes.__getitem__, x.tolist())) == whole == b"".join(map(self.b_bytes.__getitem__, y.tolist()))
        return (x, y) if back else None

    def learn(self, units: list[str]) -> None:
        """Ids of units (without their leading space) into `known`, None for those that aren't given back."""
        for some, found in self.pieces(units):
            cut = []
            for ids, counts in found or ():
                edges, blob = np.cumsum([0, *counts * 4]).tolist(), ids.tobytes()
                cut.append([blob[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)])
            self.known.update(zip(some, zip(*cut, strict=True) if found else (None,), strict=True))

    def pieces(self, units: list[str]) -> Iterator[tuple[list[str], list[tuple[np.ndarray, np.ndarray]] | None]]:
        """Units in their order and, by either tokenizer, their ids and each unit's number of ids; None for one that isn't given back.
        About CALL bytes of units are one text to the tokenizers: it has their borders."""
        some: list[str] = []
        weight = 0
        for u in units:
            joins = u and not u[-1].isspace() and self.cuts
            if some and (not joins or weight > CALL):
                yield from self._pieces(some)
                some, weight = [], 0
            if joins:
                some.append(u)
                weight += len(u)
            else:
                yield from self._pieces([u])
        if some:
            yield from self._pieces(some)

    def _pieces(self, units: list[str]) -> Iterator[tuple[list[str], list[tuple[np.ndarray, np.ndarray]] | None]]:
        text = " ".join(units)
        found = self.both(text)
        if found is None and len(units) > 1:
            half = len(units) // 2
            yield from self._pieces(units[:half])
            yield from self._pieces(units[half:])
            return
        if found is None:
            yield units, None
            return
        ends = np.cumsum(list(map(len, units if text.isascii() else map(str.encode, units)))) + np.arange(1, len(units) + 1)
        cut = []
        for ids, size in zip(found, (self.a_size, self.b_size), strict=True):
            at = np.cumsum(size[ids])
            stop = np.searchsorted(at, ends)
            if not np.array_equal(at[stop], ends):
                raise ValueError("a token crosses a unit's border")
            cut.append((ids, np.diff(stop, prepend=-1)))
        yield units, cut

    def units(self, text: str) -> list[str]:
        if not self.cuts:
            return [text]
        return BORDER.split(text) if text[0] == " " or UNSAFE.search(text) else text.split(" ")

    def tokens(self, units: list[str]) -> tuple[list[str], list[np.ndarray], list[np.ndarray]]:
        """Units that aren't given back; ids of the others one after the other by either tokenizer, and each one's number of ids."""
        found, lost = [], []
        for some, own in self.pieces(units):
            if own is None:
                lost += some
            else:
                found.append(own)
        flat = lambda k, j: np.concatenate([np.empty(0, np.int32), *(x[k][j] for x in found)]).astype(np.int32)
        return lost, [flat(k, 0) for k in (0, 1)], [flat(k, 1) for k in (0, 1)]

    def columns(self, ids: list[np.ndarray], counts: list[np.ndarray], times: np.ndarray) -> dict[str, pa.Array]:
        """The columns of UNITS, one row."""
        out, u_to = {}, 0
        for name, flat, n, size, width, names in zip("ab", ids, counts, (self.a_size, self.b_size), (self.a_wide, self.b_wide), (self.a_name, self.b_name), strict=True):
            of = size[flat]
            to = np.cumsum(width[flat], dtype=np.int32)
            u_to = u_to + to[np.cumsum(n) - 1]
            out |= {name: flat, f"{name}_ends": np.cumsum(of, dtype=np.int32), f"{name}_of": np.repeat(np.arange(len(flat), dtype=np.int32), of), f"{name}_to": to, f"u_{name}": n}
            out[f"{name}_text"] = pa.array([b"".join(map(names.__getitem__, flat.tolist()))], pa.binary())
        last = np.zeros(len(ids[0]), bool)
        last[np.cumsum(counts[0]) - 1] = True
        out |= {"u_to": u_to, "a_times": np.repeat(times, counts[0]).astype(np.int32), "a_last": last}
        return {c: out[c] if c in ("a_text", "b_text") else one_row(pa.array(out[c])) for c in (*INTS, "a_last", "a_text", "b_text")}

    def batch(self, ids: pa.Array, texts: list[str], often: Often) -> pa.RecordBatch:
        """One row: the batch's distinct units that aren't frequent, and its texts as units' numbers; a text that isn't given back has none."""
        lists = [self.units(t) if t else [] for t in texts]
        first = len(often.codes)
        while True:
            codes = _Codes(often.codes)
            edges = np.cumsum([0, *map(len, lists)]).astype(np.int32)
            flat = np.fromiter(map(codes.__getitem__, chain.from_iterable(lists)), np.int32, edges[-1])
            lost, found, counts = self.tokens(list(islice(codes, first, None)))
            if not lost:
                break
            gone = set(lost)
            lists = [[] if gone.intersection(own) else own for own in lists]
        times = np.bincount(flat, minlength=len(codes))
        often.times += times[:first]
        totals = []
        for known, own in zip(often.sizes, counts, strict=True):
            upto = np.concatenate([[0], np.cumsum(np.concatenate([known, own])[flat], dtype=np.int64)])
            totals.append(pa.array(upto[edges[1:]] - upto[edges[:-1]]))
        docs = pa.StructArray.from_arrays([ids, *totals, pa.ListArray.from_arrays(edges, flat)], ["doc_id", "n_a", "n_b", "codes"])
        return pa.record_batch({**self.columns(found, counts, times[first:]), "docs": one_row(docs), "often": one_row(often.none)})


class _Codes(dict):
    """Units' numbers, a new one's on first use."""

    def __missing__(self, unit: str) -> int:
        self[unit] = k = len(self)
        return k


class Often:
    """Frequent units' numbers, their counts of ids by either tokenizer, and how often a task has met them."""

    def __init__(self, units: list[str], sizes: list[np.ndarray]):
        self.codes, self.sizes = {u: k for k, u in enumerate(units)}, sizes
        self.times = np.zeros(len(units), np.int64)
        self.none = self._struct(np.empty(0, np.int64))

    def _struct(self, met: np.ndarray) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(met, pa.int32()), pa.array(self.times[met])], ["code", "times"])

    def met(self) -> pa.Array:
        return self._struct(np.flatnonzero(self.times))


def one_row(x: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(np.array([0, len(x)], np.int32), x)


_LOADED: dict[str, Coder] = {}


def coder(first: bytes, second: bytes) -> Coder:
    """The tokenizers of a worker process for two files' contents."""
    key = hashlib.sha256(first + second).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Coder(first, second)
    return _LOADED[key]


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _sources(docs: DataFrame, paths: tuple[str, str] | None):
    """Both files' contents, read once on the driver, as a broadcast."""
    read = []
    for path in paths or default_paths():
        with open(path, "rb") as f:
            read.append(f.read())
    return docs.sparkSession.sparkContext.broadcast(tuple(read))


def _strings(column: pa.Array) -> list[str]:
    return [str(t or b"", "utf-8", "replace") for t in column.cast(pa.binary()).to_pylist()]


def frequent(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """Rows of units that stand twice or more in about SAMPLE_ROWS texts, the MEMORY most frequent and none longer than SHORT: units and the columns of UNITS, with
    a unit's number in place of times."""
    shared = _sources(docs, paths)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(*shared.value)
        for batch in batches:
            for piece in sliced(batch):
                n = Counter(chain.from_iterable(own.units(t) for t in _strings(piece["text"]) if t))
                some = [(u, k) for u, k in n.items() if len(u) <= SHORT]
                yield pa.record_batch({"unit": pa.array([u for u, _ in some], pa.string()), "n": pa.array([k for _, k in some], pa.int64())})

    def learnt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(*shared.value)
        start = 0
        for batch in batches:
            units = batch["unit"].to_pylist()
            lost, found, counts = own.tokens(units)
            gone = set(lost)
            units = [u for u in units if u not in gone]
            yield pa.record_batch({**own.columns(found, counts, np.arange(start, start + len(units))), "units": one_row(pa.array(units, pa.string()))})
            start += len(units)
        trim()

    share = min(1.0, SAMPLE_ROWS / max(docs.count(), 1))
    some = doc_view(docs, "text").sample(share, 1).filter(F.length("text") <= SAMPLE_CHARS)
    n = some.mapInArrow(counted, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n")).filter("n > 1")
    return n.orderBy(F.desc("n"), "unit").limit(MEMORY).mapInArrow(learnt, UNITS + ", units array<string>")


def tokenised(docs: DataFrame, often: tuple[list[str], list[np.ndarray]], paths: tuple[str, str] | None = None) -> DataFrame:
    """A row a batch. Of its distinct units that aren't frequent, one after the other: ids of both tokenizers (a, b), where their tokens end in
    bytes, which token each byte belongs to (a_of, b_of), where tokens' decimal ids end in a_text and b_text (a_to, b_to), how often each token of a stands (a_times),
    whether it is its unit's last, and where units end in both texts together (u_to); docs: doc_id, both numbers of tokens and the numbers of a text's units.
    A task's last row holds how often it has met frequent units."""
    shared, known = _sources(docs, paths), docs.sparkSession.sparkContext.broadcast(often)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, often, last = coder(*shared.value), Often(*known.value), None
        for batch in batches:
            for piece in sliced(batch, TOGETHER, 20_000):
                yield own.batch(piece["doc_id"], _strings(piece["text"]), often)
                last = piece
        if last is not None:
            row = own.batch(last["doc_id"][:0], [], often)
            yield row.set_column(row.schema.get_field_index("often"), "often", one_row(often.met()))
        trim()

    return doc_view(docs, "doc_id", "text").mapInArrow(run, BATCH.format(id=docs.schema["doc_id"].dataType.simpleString()))


def _held(value: Column | str, fn: Callable[[Column], Column]) -> Column:
    """fn of a value that is reckoned once, however often and deep in functions fn reads it. Unlike a projection of its
    own, it copies nothing into a row, and unlike a column's mention, reading it makes no object for each element."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _part(text: Column, to: Column, k: Column, end: Column) -> Column:
    """The k-th of the parts that end, with a separator each, at `to` in a text."""
    start = F.when(k > 0, F.get(to, k - 1)).otherwise(F.lit(0))
    return F.substring(text, start + 1, end - start - 1)


def _at(places: Column, values: Column | str) -> Column:
    """The values at some places."""
    return _held(values, lambda v: F.transform(places, lambda i: F.get(v, i)))


def aligned(tokens: DataFrame, *keep: str) -> DataFrame:
    """Of a row's units: links (a * 2^32 + b of each place where both tokenizations end), how often each stands (times), each unit's
    last link (u_at), all units' groups (text) and where each unit's end in it, with a separator (u_to)."""

    def groups(a_text: Column, b_text: Column, a_to: Column, b_to: Column) -> Column:
        group = lambda end, g: F.concat(_part(a_text, a_to, g, end), F.lit(b"|"), _part(b_text, b_to, g, F.get(b_to, g))).cast("string")
        return F.array_join(F.transform(a_to, group), ";").cast("binary")  # as long as both texts of ids up to the same place

    def row(a_at: Column, b_at: Column) -> Column:
        pair = lambda a, b: F.transform(a, lambda x, g: x.cast("long") * F.lit(PAIR) + F.get(b, g))
        links = _held(_at(a_at, "a"), lambda a: _held(_at(b_at, "b"), lambda b: pair(a, b)))
        ends = _held("a_last", lambda x: F.transform(a_at, lambda i, g: F.when(F.get(x, i), g)))
        last = F.filter(ends, lambda g: g.isNotNull())  # a unit's end is a cut, so each unit has a link
        to = lambda fn: _held(_at(a_at, "a_to"), lambda x: _held(_at(b_at, "b_to"), lambda y: fn(x, y)))
        text = _held("a_text", lambda a: _held("b_text", lambda b: to(lambda x, y: groups(a, b, x, y))))
        return F.struct(*keep, links.alias("links"), _at(a_at, "a_times").alias("times"), last.alias("u_at"), "u_to", text.alias("text"))

    token = lambda cuts, of: _held(of, lambda x: F.transform(cuts, lambda c: F.get(x, c - 1)))
    at = lambda cuts: _held(token(cuts, "a_of"), lambda a_at: _held(token(cuts, "b_of"), lambda b_at: row(a_at, b_at)))
    return tokens.select(F.inline(F.array(_held(F.array_intersect("a_ends", "b_ends"), at))))


def unit_groups(text: bytes, to: list[int]) -> list[bytes]:
    """Each unit's groups."""
    return [text[a : b - 1] for a, b in zip([0, *to], to)]  # noqa: B905


def pair_counts(links: DataFrame) -> DataFrame:
    """pair, n, best of links (pair, times): how many links hold each id pair (a * 2^32 + b), and whether no pair of its b has more."""
    n = links.groupBy("pair").agg(F.sum(F.col("times").cast("long")).alias("n"))
    most = F.max("n").over(Window.partitionBy(F.col("pair").bitwiseAND(PAIR - 1)))
    return n.withColumn("best", F.col("n") == most)


def with_counts(links: DataFrame, counts: DataFrame, limit: int | None = None) -> DataFrame:
    """links (with pair) and their pairs' n and best. The most frequent pairs, as many as `limit` bytes hold, are
    broadcast; the links of the rest, each of few links, are shuffled."""
    room = (BROADCAST_BYTES if limit is None else limit) // PAIR_BYTES
    size = F.floor(F.log2("n")).cast("int")
    classes = sorted(((r["size"], r["count"]) for r in counts.groupBy(size.alias("size")).count().collect()), reverse=True)  # 63 at most
    least, held = 63, 0
    for power, number in classes:
        if held + number > room:
            break
        least, held = power, held + number
    many = counts.filter(size >= least)
    met = links.join(F.broadcast(many), "pair", "left")
    if held == sum(number for _, number in classes):
        return met
    few = counts.filter(size < least)
    return met.filter("n is not null").unionByName(met.filter("n is null").drop("n", "best").join(few, "pair", "left"))


def joined(base: DataFrame, counts: DataFrame, limit: int | None) -> DataFrame:
    """base with n, best (of each link of a row's units, in order) for links, however many counts there are; a row's links come together by its number."""
    links = base.select("row", F.posexplode("links").alias("pos", "pair"))
    met = with_counts(links, counts, limit).repartition("row")
    each = met.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "n", F.col("best").cast("long").alias("best")))).alias("v"))
    names = [c for c in base.columns if c not in ("links", "times")]
    return base.select(*names).join(each, "row", "left").select(*names, F.col("v.n").alias("n"), F.col("v.best").alias("best"))


class Counts:
    """All pairs' counts in order of the pairs: n and best of links by binary search; zeros for a pair that no text has."""

    def __init__(self, pair: np.ndarray, n: np.ndarray, best: np.ndarray):
        order = np.argsort(pair)
        self.pair, self.n, self.best = pair[order], n[order], best[order].astype(np.int64)

    def of(self, links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.pair):
            return (np.zeros(len(links), np.int64),) * 2
        some, back = np.unique(links, return_inverse=True)
        at = np.minimum(np.searchsorted(self.pair, some), len(self.pair) - 1)
        there = self.pair[at] == some
        return (self.n[at] * there)[back], (self.best[at] * there)[back]


def unit_sums(row: pa.RecordBatch, counts: Counts | None) -> list[np.ndarray]:
    """Of one row's units: links, links of the highest count, and the sum of their links' counts."""
    own = lambda c: row[c].flatten().fill_null(0).to_numpy(zero_copy_only=False)
    n, best = counts.of(own("links")) if counts else (own("n"), own("best"))
    to = own("u_at") + 1
    upto = lambda x: np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[to]
    return [np.diff(x, prepend=0) for x in (to.astype(np.int64), upto(best), upto(n))]


def digests(flat: np.ndarray, edges: np.ndarray, groups: list[bytes]) -> list[str]:
    """SHA-256 of each text's groups; flat: units' numbers of one text after the other, edges: where texts begin and end."""
    codes, at = flat.tolist(), edges.tolist()
    own = (codes[a:b] for a, b in zip(at[:-1], at[1:], strict=True))
    return [hashlib.sha256(b";".join(map(groups.__getitem__, c))).hexdigest() if c else "" for c in own]


def summed(base: DataFrame, often: DataFrame, groups: list[bytes], counts: DataFrame, limit: int | None, id_type: str) -> DataFrame:
    """A row a document: its units' sums and the digest of their groups; groups: frequent units'. Where all counts fit a broadcast, links find them in it; else rows bring them."""
    context = base.sparkSession.sparkContext
    table, rows, known = None, joined(base, counts, limit), joined(often, counts, limit)
    if counts.count() * PAIR_BYTES <= (BROADCAST_BYTES if limit is None else limit):
        found = counts.toArrow()
        table = context.broadcast([found[c].to_numpy() for c in ("pair", "n", "best")])
        rows, known = base, often

    def held() -> Counts | None:
        return Counts(*table.value) if table else None

    def of_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held()
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                yield pa.record_batch({"row": row["row"], "sums": one_row(pa.array(np.concatenate(unit_sums(row, own))))})

    units = sorted(known.mapInArrow(of_units, "row long, sums array<long>").collect())  # MEMORY units at most
    first = [np.concatenate([np.empty(0, np.int64), *(np.split(np.array(r["sums"], np.int64), 3)[k] for r in units)]) for k in range(3)]
    shared = context.broadcast((first, groups))

    def of_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held()
        sums, texts = shared.value
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                doc_id, n_a, n_b, codes = row["docs"].flatten().flatten()
                flat = codes.flatten().to_numpy()
                edges = np.cumsum(np.concatenate([[0], codes.value_lengths().to_numpy(zero_copy_only=False)])).astype(np.int64)
                out = []
                for x, y in zip(sums, unit_sums(row, own), strict=True):
                    upto = np.concatenate([[0], np.cumsum(np.concatenate([x, y])[flat])])
                    out.append(pa.array(upto[edges[1:]] - upto[edges[:-1]]))
                digest = digests(flat, edges, texts + unit_groups(row["text"][0].as_py(), row["u_to"].flatten().to_pylist()))
                names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
                yield pa.record_batch([doc_id, n_a, n_b, out[0], *out, pa.array(digest, pa.string())], names)
        trim()

    out = rows.mapInArrow(of_docs, f"doc_id {id_type}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return stored(out, "alignments", heavy=True)


def alignments(docs: DataFrame, paths: tuple[str, str] | None = None, limit: int | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of docs."""
    row = F.monotonically_increasing_id().alias("row")
    often = stored(aligned(frequent(docs, paths), "units", "u_a", "u_b").select(row, "*"), "often", "zstd", heavy=True)
    known = sorted(often.select("row", "units", "u_a", "u_b", "text", "u_to").collect())  # MEMORY units at most
    sizes = [np.concatenate([np.empty(0, np.int32), *(r[c] for r in known)]).astype(np.int32) for c in ("u_a", "u_b")]
    batches = tokenised(docs, ([u for r in known for u in r["units"]], sizes), paths)
    base = stored(aligned(batches, "docs", "often").select(row, "*"), "aligned", "zstd", heavy=True)
    met = base.select(F.inline("often")).groupBy("code").agg(F.sum("times").alias("times"))
    pairs = lambda rows, of: rows.select(F.inline(F.arrays_zip(F.col("links").alias("pair"), F.col("times").alias(of))))
    links = pairs(base, "times").select("pair", F.col("times").cast("long")).unionByName(pairs(often, "code").join(met, "code").select("pair", "times"))
    counts = stored(pair_counts(links), "pairs")
    groups = [g for r in known for g in unit_groups(bytes(r["text"]), r["u_to"])]
    names = ("row", "links", "times", "u_at")
    return summed(base.select(*names, "docs", "text", "u_to"), often.select(*names), groups, counts, limit, docs.schema["doc_id"].dataType.simpleString())
