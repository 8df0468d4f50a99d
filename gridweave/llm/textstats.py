"""Statistics of whole texts that the quality operators share.

Words are runs of bytes other than ASCII white space (space, tab to carriage return).
A null text counts as empty; every statistic of an empty text is 0.
"""

from __future__ import annotations

import re

import numpy as np

#: Order of the columns of `features`.
NAMES = (
    "log_words",
    "symbols_per_word",
    "bang_per_word",
    "pipe_word_share",
    "upper_share",
    "dup_line_share",
    "repeat_word_share",
    "adjacent_same_share",
    "distinct_word_share",
    "mean_word_chars",
    "digit_share",
    "stop_per_word",
)

SYMBOLS = b"#*$%&|<>"
_UPPER = re.compile(r"[^\W\d_a-zß-öø-ÿ]")
_UPPER_ASCII = bytes(range(65, 91))
_DIGITS = b"0123456789"


def repeated_words(words: list[bytes], size: int = 5) -> tuple[int, int, int]:
    """Words in `size`-word windows found twice or more in the list (first ones included),
    adjacent equal words, distinct words."""
    n = len(words)
    if n < 2:
        return 0, 0, n
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, n)
    same = int((ids[1:] == ids[:-1]).sum())
    if n <= size:
        return 0, same, len(names)
    base = len(names)
    if base**size < 2**63:
        key = ids[: n - size + 1].copy()
        for k in range(1, size):
            key = key * base + ids[k : n - size + 1 + k]
    else:  # rename pairs, so that each key stays exact
        key = ids[: n - size + 1]
        for k in range(1, size):
            key = np.unique(key * base + ids[k : n - size + 1 + k], return_inverse=True)[1]
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    equal = ranked[1:] == ranked[:-1]
    if not equal.any():
        return 0, same, base
    hit = np.zeros(len(key), bool)
    hit[order[1:][equal]] = True
    hit[order[:-1][equal]] = True
    starts = np.flatnonzero(hit)
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + size, -1)
    return int((np.cumsum(cover[:n]) > 0).sum()), same, base


def measure(data: bytes) -> tuple[list[int], list[float]]:
    """([n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words], features in the order of NAMES)."""
    words = data.split()
    n = len(words)
    if not n:
        return [0, 0, len(data) - len(data.translate(None, SYMBOLS)), 0, 0], [0.0] * len(NAMES)
    text = data.decode("utf-8", "replace")
    chars = len(text) - (len(data) - len(data.translate(None, b" \t\n\x0b\x0c\r")))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    dup_lines = len(lines) - len(set(lines))
    repeat, same, distinct = repeated_words(words)
    upper = len(data) - len(data.translate(None, _UPPER_ASCII))
    if len(text) != len(data):
        upper = len(_UPPER.findall(text))
    digits = len(data) - len(data.translate(None, _DIGITS))
    return [n, chars, symbols, dup_lines, repeat], [
        float(np.log1p(n)),
        symbols / n,
        data.count(b"!") / n,
        data.count(b"|") / n,
        upper / max(chars, 1),
        dup_lines / max(len(lines), 1),
        repeat / n,
        same / n,
        distinct / n,
        chars / n,
        digits / max(chars, 1),
        (data.count(b".") + data.count(b",")) / n,
    ]
