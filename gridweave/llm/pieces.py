"""Texts cut into pieces by Arrow, each distinct piece of a batch looked at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def distinct_pieces(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(piece offsets of each text, codes, distinct pieces): cut at runs of ASCII white
    space; empty pieces may stand at the ends. A null text has one empty piece."""
    texts = pc.fill_null(texts.cast(pa.binary()), b"").cast(pa.string(), safe=False)
    lists = pc.ascii_split_whitespace(texts)
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    offsets = np.asarray(lists.offsets, np.int64)
    coded = lists.flatten().dictionary_encode()
    return offsets - offsets[0], np.asarray(coded.indices, np.int64), coded.dictionary.to_pylist()


def joined(offsets: np.ndarray, codes: np.ndarray, values: list[bytes], dtype: np.dtype) -> list[bytes]:
    """For each text, the values of its pieces one after the other."""
    flat = np.frombuffer(b"".join(values), dtype)
    sizes = np.fromiter(map(len, values), np.int64, len(values)) // dtype.itemsize
    starts = np.cumsum(sizes) - sizes
    length = sizes[codes]
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    at = np.repeat(starts[codes] - (ends - length), length) + np.arange(total)
    blob = flat[at].tobytes()
    edges = (np.concatenate([[0], ends])[offsets] * dtype.itemsize).tolist()
    return [blob[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
