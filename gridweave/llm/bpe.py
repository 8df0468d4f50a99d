"""BPE encoding and decoding as a bounded-lookahead streaming transducer.

Greedy merging by rank has a local description: a token sequence is the encoding of its bytes
exactly if every token is what its own bytes encode to and every neighbouring pair is what the
pair's bytes encode to. So an encoding, cut at any token boundary, is the encoding of the bytes
before the cut. A token that spans position n starts less than `lookahead` bytes before it,
with `lookahead` the longest token the merge list can make; whatever the encodings of all
prefixes that end in those last bytes have in common can change no more and is emitted.
What is held back is thus a window of that length plus the part its prefixes differ on.

A text is pushed in pieces of PIECE bytes. Pre-tokens are found as far as the next piece can't change them,
and every one goes through the transducer: a long one as it comes, another as one arc from the transducer's
start to its finish, which is remembered, as a word's arc is the same wherever it stands. Texts of a batch are cut
into units at spaces after other characters, where pre-tokens end whatever follows, and each distinct unit of a batch is pushed once.

Whether a token may follow another is asked of the merges that made the two, undone from the last one back: a merge
across their border that ranks before the one undone would have come first.

Decoding is a state machine from token bytes to text that holds only an unfinished character.

Nulls and odd inputs: a null text is an empty text with no tokens. A null doc_id is passed
through, repeated rows are each encoded, other columns are ignored. Ill-formed UTF-8 in a text
is replaced by U+FFFD before encoding.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import struct
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import doc_view, sliced, trim

#: Entries of a worker's memory of token pairs, emptied when full, and of each half of its memory of arcs: when the newer half
#: is full it becomes the older one, from which arcs met again come back. Arcs are also forgotten after each task. Neither changes a result.
MEMORY, ARCS = 700_000, 80_000

#: Bytes of texts that are encoded together.
TOGETHER = 1 << 20

#: Bytes that the transducer takes in before it looks for what is stable.
FLUSH = 2048

#: Bytes of a text pushed at a time; characters that the pattern may look ahead; most characters of a pre-token held whole.
PIECE, MARGIN, HELD = 1 << 16, 3, 256

#: White space by Unicode's property, and the byte-level pre-tokenizer's pattern over classes of letters and numbers.
SPACE = "\t-\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+"

#: Planes of Unicode that hold letters or numbers; the others are unassigned or private.
PLANES = (0, 1, 2, 3, 14)

#: The classes by the regex module's tables.
USUAL = (r"\p{L}", r"\p{N}")

_CLASSES: dict[str, tuple[str, str, str]] = {}


def char_classes(source: bytes) -> tuple[str, str, str]:
    """(letters, numbers) as ranges of a regular expression's class, as the library itself cuts texts, and the
    characters that USUAL takes otherwise: the two modules' Unicode tables are of different ages. About two seconds for a file, once a process."""
    key = hashlib.sha256(source).hexdigest()
    if key not in _CLASSES:
        from tokenizers import Tokenizer

        cut = Tokenizer.from_str(source.decode()).pre_tokenizer.pre_tokenize_str
        points = [c for plane in PLANES for c in range(plane << 16, (plane + 1) << 16) if not 0xD800 <= c < 0xE000]
        out, odd = [], set()
        for near, usual in zip("a1", USUAL, strict=True):  # a letter between letters, and a number between numbers, is one pre-token with them
            ranges: list[list[int]] = []
            mine = regex.compile(usual)
            for at in range(0, len(points), 1 << 14):
                some = points[at : at + (1 << 14)]
                whole = {b for _, (b, e) in cut("".join(f"{near}{chr(c)}{near}\n" for c in some)) if e - b == 3}
                for k, c in enumerate(some):
                    if (4 * k in whole) != (mine.match(chr(c)) is not None):
                        odd.add(chr(c))
                    if 4 * k in whole:
                        if ranges and ranges[-1][1] == c - 1:
                            ranges[-1][1] = c
                        else:
                            ranges.append([c, c])
            out.append("".join(rf"\U{a:08x}-\U{b:08x}" for a, b in ranges))
        _CLASSES[key] = (out[0], out[1], "".join(sorted(odd)))
        del cut, points
        trim()  # on the driver the library's model would stay for all later stages
    return _CLASSES[key]


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in for each byte in a byte-level vocabulary: bytes that print stand for
    themselves, the others take the characters from U+0100 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class MergeList:
    """A vocabulary with ranked merges, and the compatibility of neighbouring tokens."""

    def __init__(self, source: bytes, classes: tuple[str, str, str] | None = None):
        self.classes = classes or char_classes(source)
        spec = json.loads(source)
        alphabet = byte_alphabet()
        model = spec["model"]
        as_bytes = lambda token: bytes(alphabet[c] for c in token)
        self.ids = {as_bytes(t): i for t, i in model["vocab"].items()}
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        size = max([*self.ids.values(), *self.specials.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for t, i in self.ids.items():
            self.bytes[i] = t
        for t, i in self.specials.items():
            self.bytes[i] = t.encode()
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = (as_bytes(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            self.merges.setdefault((self.ids[a], self.ids[b]), (rank, self.ids[a + b]))
        made = [i for _, i in self.merges.values()]
        base = {i for t, i in self.ids.items() if len(t) == 1}
        #: The two tokens that a token is merged from, if ids ascend with ranks, as they do in the file of the contract; else None.
        self.split = {i: pair for pair, (_, i) in self.merges.items()} if made == sorted(set(made)) and max(base, default=0) < min(made, default=0) else None
        self.lookahead = max(map(len, self.ids))
        self.size = list(map(len, self.bytes))
        self.special_bytes = [t.encode() for t in self.specials]
        automaton = ahocorasick.Automaton()
        for t, i in self.ids.items():
            automaton.add_word(t.decode("latin-1"), i)
        automaton.make_automaton()
        self.automaton = automaton
        self._single: dict[int, bool] = {}
        self.pairs: dict[int, bool] = {}

    def merge(self, data: bytes) -> list[int]:
        """The encoding by its definition: merge the leftmost pair of least rank until none is left."""
        out = [self.ids[data[k : k + 1]] for k in range(len(data))]
        while len(out) > 1:
            found = [(m[0], k) for k in range(len(out) - 1) if (m := self.merges.get((out[k], out[k + 1])))]
            if not found:
                break
            _, k = min(found)
            out[k : k + 2] = [self.merges[out[k], out[k + 1]][1]]
        return out

    def holds_special(self, data: bytes) -> bool:
        for x in self.special_bytes:
            if x in data:
                return True
        return False

    def alone(self, token: int) -> bool:
        got = self._single.get(token)
        if got is None:
            got = self._single[token] = self.merge(self.bytes[token]) == [token]
        return got

    def fits(self, before: int, token: int) -> bool:
        """True if `token` may follow `before` (-1: the start)."""
        key = before << 24 | token
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) > MEMORY:
                self.pairs.clear()
            if before < 0:
                got = self.alone(token)
            elif self.split is None:
                got = self.merge(self.bytes[before] + self.bytes[token]) == [before, token]
            else:
                got = self.alone(before) and self.alone(token) and self._apart(before, token)
            self.pairs[key] = got
        return got

    def _apart(self, a: int, b: int) -> bool:
        """True if no merge across the border of two tokens, each alone, comes before those that made them."""
        merges, split, limit = self.merges, self.split, len(self.bytes)
        while True:
            found = merges.get((a, b))
            if found is not None and found[1] < limit:
                return False
            if a > b and a in split:
                limit, a = a, split[a][1]
            elif b in split:
                limit, b = b + 1, split[b][0]  # of two equal merges the left one comes first
            elif a in split:
                limit, a = a, split[a][1]
            else:
                return True


class Transducer:
    """Encodes one pre-token, pushed in pieces of bytes.

    For each prefix of the bytes held it knows the last token of the prefix's encoding: the one
    token ending there that fits the prefix before it. An automaton over the vocabulary gives the
    tokens that end at a byte; it goes on from where the piece before it stopped.
    """

    def __init__(self, merges: MergeList):
        self.m = merges
        self.seen = 0  # bytes taken in so far
        self.ending = merges.automaton.iter("")
        self.start()

    def start(self) -> None:
        self.buffer = b""
        self.last: list[int] = [-1]  # last token of the encoding of each prefix of the buffer
        self.before = -1  # token emitted last
        self.gone = 0  # bytes of the pre-token emitted

    def push(self, data: bytes) -> list[int]:
        """Tokens that became stable."""
        out: list[int] = []
        for at in range(0, len(data), FLUSH):
            self._extend(data[at : at + FLUSH])
            if len(self.buffer) >= 2 * self.m.lookahead:
                out += self._flush(self._stable())
        return out

    def whole(self, data: bytes) -> list[int]:
        """Tokens of a pre-token that is held whole, from start to finish."""
        size, fits, pairs, last, found = self.m.size, self.m.fits, self.m.pairs, [-1], 0
        self.seen += len(data)
        for end, token in self.m.automaton.iter(data.decode("latin-1")):
            if end < found:
                continue
            before = last[end + 1 - size[token]]
            good = pairs.get(before << 24 | token)
            if good is None:
                good = fits(before, token)
            if good:
                last.append(token)
                found = end + 1
        if found != len(data):
            raise ValueError("the vocabulary lacks a byte")
        out = []
        while found:
            out.append(last[found])
            found -= size[last[found]]
        out.reverse()
        return out

    def finish(self) -> list[int]:
        out = self._flush(len(self.buffer))
        self.start()
        return out

    def _extend(self, data: bytes) -> None:
        last, size, fits, pairs = self.last, self.m.size, self.m.fits, self.m.pairs
        ending, found = self.ending, len(self.buffer)
        ending.set(data.decode("latin-1"), not found)  # goes on in its state, unless it starts
        self.buffer += data
        self.seen += len(data)
        ahead = 1 - self.gone
        for end, token in ending:
            end += ahead
            if end == found:
                continue
            at = end - size[token]
            if at > 0:
                key = last[at] << 24 | token
                good = pairs.get(key)
                if good is None:
                    good = fits(last[at], token)
            else:
                good = at == 0 and fits(self.before, token)
            if good:
                last.append(token)
                found = end
        if len(last) != len(self.buffer) + 1:
            raise ValueError("the vocabulary lacks a byte")

    def _stable(self) -> int:
        """The largest boundary that the encodings of all prefixes ending in the lookahead share."""
        size, last = self.m.size, self.last
        low = n = len(self.buffer)
        for end in range(n - 1, max(0, n - self.m.lookahead), -1):  # a prefix's boundaries are a path to 0; where paths meet they are one
            while low != end:
                if low > end:
                    low -= size[last[low]]
                else:
                    end -= size[last[end]]
        return low

    def _flush(self, end: int) -> list[int]:
        out = []
        at, size, last = end, self.m.size, self.last
        while at:
            out.append(last[at])
            at -= size[last[at]]
        out.reverse()
        if out:
            self.before = out[-1]
            self.gone += end
            self.buffer = self.buffer[end:]
            self.last = [-1, *last[end + 1 :]]
        return out


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _patterns(letters: str, numbers: str) -> tuple[regex.Pattern, list[regex.Pattern]]:
    """The pre-tokens' pattern and those of their runs, over classes of letters and numbers."""
    runs = (f"[{letters}]*", f"[{numbers}]*", f"[{SPACE}]*", f"[^{SPACE}{letters}{numbers}]*")
    return regex.compile(PATTERN.format(letters=letters, numbers=numbers, space=SPACE)), [regex.compile(x) for x in runs]


class Stream:
    """A text pushed in pieces to ids: finds pre-tokens and sends each through the transducer.

    Between pieces it holds the characters whose pre-token the next ones may change: MARGIN of them, or a
    pre-token's begin of at most HELD; of a longer one the part before goes to the transducer as it comes. So
    what is held depends on no text's length. The way of a whole pre-token through the
    transducer, from its start to its finish, is one arc; arcs are remembered once taken.
    """

    def __init__(self, merges: MergeList):
        self.m = merges
        self.transducer = Transducer(merges)
        *exact, odd = merges.classes
        self.odd = frozenset(odd)
        self.patterns = [_patterns(*USUAL), _patterns(*exact)]
        self.special = regex.compile("|".join(map(regex.escape, sorted(merges.specials, key=len, reverse=True)))) if merges.specials else None
        self.arcs: dict[str, bytes] = _Arcs(self.transducer)
        self.start()

    def start(self) -> None:
        self.held = self.tail = ""
        self.run = -1  # class of the pre-token that the transducer is in

    def push(self, text: str, final: bool = False) -> bytes:
        """Ids that became certain. final: nothing follows; the stream starts anew."""
        out = []
        if self.special is not None:
            text, self.tail = self.tail + text, ""
            done = 0
            for m in self.special.finditer(text):
                if m.end() == len(text) and not final and any(x.startswith(m[0]) for x in self.m.specials if x != m[0]):
                    break
                out.append(self._plain(text[done : m.start()], True))
                out.append(packed([self.m.specials[m[0]]]))
                done = m.end()
            keep = 0 if final else max((k for x in self.m.specials for k in range(1, len(x)) if text.endswith(x[:k], done)), default=0)
            if not final and (m := self.special.search(text, done)):
                keep = max(keep, len(text) - m.start())
            self.tail = text[len(text) - keep :] if keep else ""
            text = text[done : len(text) - keep] if done or keep else text
        out.append(self._plain(text, final))
        return b"".join(out)

    def _plain(self, text: str, final: bool) -> bytes:
        out = []
        text, self.held = self.held + text, ""
        pattern, runs = self._patterns_for(text)
        if self.run >= 0:
            end = runs[self.run].match(text).end()
            if end == len(text) and not final:
                self.held = text[-1:]  # the last of white space may belong to what follows
                return self._into(text[:-1])
            if self.run == 2 and end < len(text):
                end -= 1
            out.append(self._into(text[:end]) + packed(self.transducer.finish()))
            text, self.run = text[end:], -1
        found = pattern.findall(text)
        if not final:
            cut = n = len(text)
            while found and cut > n - MARGIN:
                cut -= len(found.pop())
            self.held = text[cut:]
        out += map(self.arcs.__getitem__, found)
        if len(self.held) > HELD:
            self.run = next(k for k, x in enumerate(runs) if x.match(self.held, 1).end() > 1)
            text, self.held = self.held[:-MARGIN], self.held[-MARGIN:]
            out.append(self._into(text))
        return b"".join(out)

    def _patterns_for(self, text: str) -> tuple[regex.Pattern, list[regex.Pattern]]:
        """The exact classes have hundreds of ranges and are slow: they are used where a character asks for them."""
        return self.patterns[not text.isascii() and not self.odd.isdisjoint(text)]

    def whole(self, text: str) -> tuple[list[str], list[bytes]]:
        """Pre-tokens of a text without special tokens, and the ids of each."""
        found = self._patterns_for(text)[0].findall(text)
        return found, list(map(self.arcs.__getitem__, found))

    def _into(self, text: str) -> bytes:
        return packed(self.transducer.push(text.encode()))


class _Arcs(dict):
    """Ids of a whole pre-token; made by the transducer on first use."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer = transducer
        self.older: dict[str, bytes] = {}

    def __missing__(self, text: str) -> bytes:
        got = self.older.get(text)
        if got is None:
            data = text.encode()
            if len(data) > HELD:
                return packed(self.transducer.push(data) + self.transducer.finish())
            got = packed(self.transducer.whole(data))
        if len(self) >= ARCS:
            self.older = dict(self)
            super().clear()
        self[text] = got
        return got

    def clear(self) -> None:
        super().clear()
        self.older = {}


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets from 0, bytes) of an array of strings or bytes; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return offsets - offsets[0], data


class Encoder:
    """Whole texts to ids through one stream, a piece at a time."""

    def __init__(self, merges: MergeList):
        self.m = merges
        self.stream = Stream(merges)

    def encode_all(self, texts: pa.Array) -> pa.Array:
        """Ids of each text; null counts as empty. Together the texts take 1 GB at most, and one of more than TOGETHER bytes goes alone."""
        offsets, data = _flat(texts)
        if len(texts) == 1 and len(data) > TOGETHER:
            return pa.array([self.encode(data)], pa.binary())
        first, units = self._units(offsets, data)
        coded = units.dictionary_encode()
        ids = self._once(coded.dictionary.to_pylist())
        ends, blob = _flat(ids.take(coded.indices))
        return pa.BinaryArray.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(ends[first].astype(np.int32)), pa.py_buffer(blob)])

    def _once(self, units: list[bytes]) -> pa.Array:
        """Ids of each unit. Short ones that begin with a space and end in what is no white space are one text to the pattern."""
        chained = [u[0] == 0x20 and (0x20 < u[-1] < 0x7F or u[-1] >= 0x80 and 0xC3 <= u[-2] < 0xE0) and len(u) <= HELD for u in units]
        texts = [str(u, "utf-8", "replace") for u, c in zip(units, chained, strict=True) if c]
        whole = "".join(texts)
        if self.m.holds_special(whole.encode()):
            return pa.array([self.encode(u) for u in units], pa.binary())
        found, got = self.stream.whole(whole)
        ends = np.cumsum([0, *map(len, got)])
        last = np.searchsorted(np.cumsum([0, *map(len, found)]), np.cumsum([0, *map(len, texts)]))
        edges, blob = ends[last], b"".join(got)
        one = pa.BinaryArray.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(blob)])
        others = pa.array([self.encode(u) for u, c in zip(units, chained, strict=True) if not c], pa.binary())
        place = np.array(chained, bool)
        return pa.concat_arrays([one, others]).take(pa.array(np.where(place, np.cumsum(place) - 1, len(texts) + np.cumsum(~place) - 1)))

    def _units(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        """(each text's first unit, and the number of units; units): cut at a space after a character that isn't white space, where ASCII or a
        two-byte character from U+00C0 on shows that by its bytes. A text with a special token in it is one unit."""
        at = np.flatnonzero(data == 0x20)
        at = at[at > 1]
        one, two = data[at - 1], data[at - 2]
        at = at[(one > 0x20) & (one < 0x7F) | (one >= 0x80) & (two >= 0xC3) & (two < 0xE0)]
        if self.m.holds_special(data.tobytes()):
            special = np.array([self.m.holds_special(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], bool)
            at = at[~special[np.searchsorted(offsets, at, "right") - 1]]
        starts = np.unique(np.concatenate([offsets, at]))
        units = pa.BinaryArray.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(data)])
        return np.searchsorted(starts, offsets), units

    def encode(self, data: bytes | memoryview) -> bytes:
        """Ids of a text in UTF-8, as little-endian 32-bit integers."""
        if len(data) <= PIECE:
            return self.stream_out([str(data, "utf-8", "replace")])
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        view = memoryview(data)
        return self.stream_out(machine.decode(view[k : k + PIECE], k + PIECE >= len(view)) for k in range(0, len(view), PIECE))

    def stream_out(self, pieces: Iterable[str]) -> bytes:
        """Ids of a text given in pieces."""
        out, last = bytearray(), ""
        for piece in pieces:
            if last:
                out += self.stream.push(last)
            last = piece
        out += self.stream.push(last, True)
        self.stream.start()
        return bytes(out)


class Decoder:
    """Ids to text, a block at a time; an unfinished character is the only state."""

    def __init__(self, merges: MergeList):
        self.table, self.pieces = merges.bytes, pa.array(merges.bytes, pa.binary())
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int], final: bool = False) -> str:
        return self.machine.decode(b"".join(map(self.table.__getitem__, ids)), final)

    def text(self, ids: np.ndarray, block: int = 1 << 16) -> str:
        out = [self.machine.decode(_flat(self.pieces.take(pa.array(ids[k : k + block])))[1].tobytes()) for k in range(0, len(ids), block)]
        out.append(self.feed((), True))
        self.machine.reset()
        return "".join(out)


_LOADED: dict[str, tuple[Encoder, Decoder]] = {}


def coders(source: bytes, classes: tuple[str, str, str] | None = None) -> tuple[Encoder, Decoder]:
    """The coders of a worker process for a tokenizer file's content."""
    key = hashlib.sha256(source).hexdigest()
    if key not in _LOADED:
        merges = MergeList(source, classes)
        _LOADED[key] = (Encoder(merges), Decoder(merges))
        trim()  # what was read to make them
    return _LOADED[key]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian 32-bit integers), decoded for every row of docs.

    path: a byte-level BPE file of the tokenizers library, read once on the driver.
    """
    with open(path or default_path(), "rb") as f:
        source = f.read()
    shared = docs.sparkSession.sparkContext.broadcast((source, char_classes(source)))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder, decoder = coders(*shared.value)
        ids = encoder.encode_all(batch["text"])
        ends, blob = _flat(ids)
        decoded = [decoder.text(blob[a:b].view("<u4")) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return pa.record_batch(
            {
                "doc_id": batch["doc_id"],
                "n_tokens": pa.array(np.diff(ends) // 4, pa.int64()),
                "ids": ids,
                "decoded": pa.array(decoded, pa.string()),
            }
        )

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in sliced(batch, TOGETHER):
                yield run(piece)
            trim()
        coders(*shared.value)[0].stream.arcs.clear()  # the worker goes on to other stages
        trim()

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return doc_view(docs, "doc_id", "text").mapInArrow(every, f"doc_id {id_type}, n_tokens long, ids binary, decoded string")

