"""Static range asymmetric numeral system: interleaved lanes in numpy, blocks that decode alone.

One table of 2**SCALE slots, shared by all blocks, gives each symbol a share near its frequency.
A block's symbols are dealt to lanes step by step; each lane is a 64-bit state that sheds and
takes up 32-bit words. The final states, a checkpoint of states and word position every
CHECKPOINT steps, and a CRC of the symbols are stored with the words, so any span between
checkpoints can be decoded without the rest.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

SCALE = 20
LOW = np.uint64(1 << 31)
CHECKPOINT = 128
MAX_LANES = 1024

MAGIC = b"GWR1"
HEAD = struct.Struct("<4sIIIII")  # magic, symbols, lanes, words, checkpoints, crc32 of the symbols as 32-bit integers


class Table:
    """Slots by symbol; `counts` covers every symbol that occurs."""

    def __init__(self, counts: np.ndarray):
        counts = np.asarray(counts, np.int64)
        used = counts > 0
        if int(used.sum()) > 1 << SCALE:
            raise ValueError("more symbols than slots")
        freq = np.zeros(len(counts), np.int64)
        if used.any():
            share = counts[used] / counts[used].sum()
            got = np.maximum(1, np.floor(share * ((1 << SCALE) - used.sum())).astype(np.int64))
            left = (1 << SCALE) - int(got.sum())
            order = np.argsort(-share, kind="stable")
            if left > 0:
                got[order[0]] += left
            for k in order:  # took too many: the most frequent symbols give some back
                if left >= 0:
                    break
                give = min(-left, int(got[k]) - 1)
                got[k] -= give
                left += give
            freq[used] = got
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self._symbol: np.ndarray | None = None

    @property
    def symbol(self) -> np.ndarray:
        """The symbol of each slot; made when something is decoded."""
        if self._symbol is None:
            self._symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._symbol


def lanes_for(n: int) -> int:
    """A lane costs 8 bytes of state: one for 64 symbols at most."""
    return int(min(MAX_LANES, max(1, 1 << max(0, (n // 64).bit_length() - 1))))


def crc_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4", copy=False).tobytes())


def encode_block(ids: np.ndarray, table: Table) -> bytes:
    n, lanes = len(ids), lanes_for(len(ids))
    steps = -(-n // lanes)
    x = np.full(lanes, LOW, np.uint64)
    freq, start = table.freq[ids], table.start[ids]
    if n and not freq.all():
        raise ValueError("a symbol is missing from the table")
    shed: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray, int]] = []
    total = 0
    for step in range(steps - 1, -1, -1):
        at = step * lanes
        f = freq[at : at + lanes]
        now = x[: len(f)]
        over = now >= f << np.uint64(63 - SCALE)
        if over.any():
            out = now[over].astype(np.uint32)  # the low half
            shed.append(out)
            total += len(out)
            now = np.where(over, now >> np.uint64(32), now)
        q = now // f
        x[: len(f)] = (q << np.uint64(SCALE)) + (now - q * f) + start[at : at + lanes]
        if step % CHECKPOINT == 0 and step:
            marks.append((step, x.copy(), total))
    words = np.concatenate(shed[::-1]) if shed else np.empty(0, np.uint32)
    out = [HEAD.pack(MAGIC, n, lanes, total, len(marks), crc_of(ids)), x.astype("<u8").tobytes()]
    for step, state, emitted in marks[::-1]:
        out += [struct.pack("<II", step, total - emitted), state.astype("<u8").tobytes()]
    out.append(words.astype("<u4").tobytes())
    return b"".join(out)


def spans(block: bytes) -> list[tuple[int, int]]:
    """Ranges of steps that can be decoded on their own."""
    (_, n, lanes, *_), marks = _head(block), _marks(block)
    steps = -(-n // lanes)
    edges = [0, *(m[0] for m in marks), steps]
    return list(zip(edges[:-1], edges[1:], strict=True)) if steps else []


def _head(block: bytes) -> tuple:
    head = HEAD.unpack_from(block)
    if head[0] != MAGIC:
        raise ValueError("not a block")
    return head


def _marks(block: bytes) -> list[tuple[int, int, int]]:
    """(step, word position, offset of the states) of each checkpoint."""
    _, _, lanes, _, count, _ = _head(block)
    at = HEAD.size + 8 * lanes
    out = []
    for _ in range(count):
        out.append((*struct.unpack_from("<II", block, at), at + 8))
        at += 8 + 8 * lanes
    return out


def decode_block(block: bytes, table: Table, span: tuple[int, int] | None = None) -> np.ndarray:
    """The symbols of a block, or of one of its spans(); a whole block is held against its checksum."""
    _, n, lanes, total, count, crc = _head(block)
    steps = -(-n // lanes)
    first, last = span or (0, steps)
    position, offset = 0, HEAD.size
    for step, pos, at in _marks(block):
        if step == first:
            position, offset = pos, at
    x = np.frombuffer(block, "<u8", lanes, offset).astype(np.uint64)
    words = np.frombuffer(block, "<u4", total, HEAD.size + 8 * lanes + count * (8 + 8 * lanes))
    mask = np.uint64((1 << SCALE) - 1)
    symbol, freq, start = table.symbol, table.freq, table.start
    out = np.empty(min(n, last * lanes) - first * lanes, np.uint32) if steps else np.empty(0, np.uint32)
    for step in range(first, last):
        width = min(lanes, n - step * lanes)
        now = x[:width]
        slot = now & mask
        s = symbol[slot.astype(np.int64)]
        now = freq[s] * (now >> np.uint64(SCALE)) + slot - start[s]
        under = np.flatnonzero(now < LOW)
        if len(under):
            now[under] = (now[under] << np.uint64(32)) | words[position : position + len(under)]
            position += len(under)
        x[:width] = now
        at = (step - first) * lanes
        out[at : at + width] = s
    if span is None and (crc_of(out) != crc or position != total or (x != LOW).any()):  # the encoder began at LOW
        raise ValueError("a block fails its checksum")
    return out
