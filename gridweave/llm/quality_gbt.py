"""Quality rules: fixed rules plus gradient-boosted trees over document statistics.

The trees are grown on histograms with monotonic constraints (more symbols, capitals, pipes or
repetition may only lower a score; a larger share of distinct words may only raise it), then
flattened into numpy node arrays and scored for a whole batch at once.

Nulls and empty texts: a null text is an empty text, has 0 words and fails the base rule.
A null doc_id is passed through, repeated rows are each judged, other columns are ignored.
With no usable labels, or labels of one class only, the method keeps what the base rules keep.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import doc_view, map_batches, texts_of
from .labelled import SAMPLE_ROWS, training_rows
from .textstats import NAMES, measure

#: Sign of the effect that each constrained statistic may have on the score.
MONOTONE = {
    "symbols_per_word": -1,
    "bang_per_word": -1,
    "pipe_word_share": -1,
    "upper_share": -1,
    "repeat_word_share": -1,
    "adjacent_same_share": -1,
    "distinct_word_share": 1,
}

#: A document is kept if its probability of quality 1 is at least this.
KEEP_AT = 0.3


@dataclass
class Trees:
    """Arrays by tree and node; a leaf has feature -1 and points at itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros((len(x), len(self.feature)), np.int64)
        tree = np.arange(len(self.feature))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            f = self.feature[tree, at]
            go_left = x[rows, np.maximum(f, 0)] <= self.threshold[tree, at]
            at = np.where(go_left, self.left[tree, at], self.right[tree, at])
        return self.base + self.value[tree, at].sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -500, 500)))


def fit(
    x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0
) -> Trees | None:
    """None unless both classes have rows."""
    if len(set(y.tolist())) < 2:
        return None
    n, p = x.shape
    sign = np.array([MONOTONE.get(k, 0) for k in NAMES])
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(p)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(p)], 1)
    cells = binned + np.arange(p) * bins
    rate0 = y.mean()
    base = float(np.log(rate0 / (1 - rate0)))
    raw = np.full(n, base)
    size = 2 ** (depth + 1) - 1
    out = Trees(
        np.full((trees, size), -1), np.zeros((trees, size)), np.tile(np.arange(size), (trees, 1)),
        np.tile(np.arange(size), (trees, 1)), np.zeros((trees, size)), base, depth,
    )
    for t in range(trees):
        q = 1 / (1 + np.exp(-raw))
        g, h = y - q, q * (1 - q)
        todo = [(0, np.arange(n), -np.inf, np.inf, 0)]
        while todo:
            node, rows, low, high, level = todo.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            out.value[t, node] = rate * np.clip(gs / (hs + ridge), low, high)
            split = _best_split(cells[rows], g[rows], h[rows], p, bins, cuts, sign, low, high, ridge) if level < depth and len(rows) > 40 else None
            if split is None:
                raw[rows] += out.value[t, node]
                continue
            j, b, vl, vr = split
            out.feature[t, node], out.threshold[t, node] = j, cuts[j][b]
            out.left[t, node], out.right[t, node] = 2 * node + 1, 2 * node + 2
            goes = binned[rows, j] <= b
            middle = (vl + vr) / 2  # children of a constrained split stay on their sides of it
            lo_l, hi_l, lo_r, hi_r = low, high, low, high
            if sign[j] > 0:
                hi_l, lo_r = middle, middle
            elif sign[j] < 0:
                lo_l, hi_r = middle, middle
            todo += [(2 * node + 1, rows[goes], lo_l, hi_l, level + 1), (2 * node + 2, rows[~goes], lo_r, hi_r, level + 1)]
    return out


def _best_split(cells, g, h, p, bins, cuts, sign, low, high, ridge):
    flat = cells.ravel()
    hist_g = np.bincount(flat, np.repeat(g, p), p * bins).reshape(p, bins).cumsum(1)
    hist_h = np.bincount(flat, np.repeat(h, p), p * bins).reshape(p, bins).cumsum(1)
    gl, hl = hist_g[:, :-1], hist_h[:, :-1]
    gr, hr = hist_g[:, -1:] - gl, hist_h[:, -1:] - hl
    vl, vr = np.clip(gl / (hl + ridge), low, high), np.clip(gr / (hr + ridge), low, high)
    gain = 2 * (gl * vl + gr * vr) - (hl + ridge) * vl**2 - (hr + ridge) * vr**2
    whole = np.clip(gain.dtype.type(hist_g[0, -1] / (hist_h[0, -1] + ridge)), low, high)
    gain -= 2 * hist_g[0, -1] * whole - (hist_h[0, -1] + ridge) * whole**2
    allowed = (hl > 1) & (hr > 1) & ((vr - vl) * sign[:, None] >= 0)
    allowed &= np.arange(bins - 1) < np.array([len(c) for c in cuts])[:, None]
    gain = np.where(allowed, gain, -np.inf)
    j, b = np.unravel_index(int(gain.argmax()), gain.shape)
    return None if gain[j, b] < 1e-6 else (int(j), int(b), vl[j, b], vr[j, b])


def quality_rules(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, the base counts, base_failed, score and kept for every row of docs."""
    model = fit(*training_rows(docs, labels, sample_rows))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        both = [measure(t) for t in texts_of(batch["text"])]
        counts = np.array([b[0] for b in both], np.int64).reshape(-1, 5)
        x = np.array([b[1] for b in both], float).reshape(-1, len(NAMES))
        failed = (counts[:, 0] < 10) | (100 * counts[:, 4] > 20 * counts[:, 0])
        score = model.score(x) if model else np.ones(len(x))
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        return pa.record_batch(
            {"doc_id": batch["doc_id"]}
            | {k: pa.array(counts[:, i]) for i, k in enumerate(names)}
            | {"base_failed": pa.array(failed), "score": pa.array(score), "kept": pa.array(~failed & (score >= KEEP_AT))}
        )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(
        doc_view(docs, "doc_id", "text"), run,
        f"doc_id {id_type}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, score double, kept boolean",
    )
