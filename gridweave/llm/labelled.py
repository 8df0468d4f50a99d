"""A bounded sample of labelled documents with their statistics, for fitting the quality models."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_view, map_batches, texts_of
from .textstats import NAMES, measure

#: Labelled rows that a model is fitted on, at most about (rows are chosen by a hash of their id).
SAMPLE_ROWS = 8000


def held_out(doc_id):
    """True where crc32 of the id as text leaves no remainder by 5; those labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def features_of(batch: pa.RecordBatch) -> np.ndarray:
    return np.array([measure(t)[1] for t in texts_of(batch["text"])], float).reshape(-1, len(NAMES))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(features, labels) of up to about `rows` labelled documents outside the held-out fold.

    The sample is bounded, so its ids may be broadcast and its statistics collected.
    Labels other than 0 and 1, null labels and null ids are left out.
    """
    usable = labels.select(labels["doc_id"], labels["quality"]).filter(
        F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))
    )
    total = usable.count()
    if not total:
        return np.empty((0, len(NAMES))), np.empty(0, int)
    cut = min(1.0, rows / total)
    usable = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(int(cut * (1 << 20)) + 1))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = features_of(batch)
        return pa.record_batch({"quality": batch["quality"], "x": pa.array(list(x), pa.list_(pa.float64()))})

    picked = doc_view(docs, "doc_id", "text").join(F.broadcast(usable), "doc_id").select("text", "quality")
    got = map_batches(picked, run, "quality int, x array<double>").toPandas()
    x = np.array(got["x"].tolist(), float).reshape(-1, len(NAMES))
    y = got["quality"].to_numpy(int)
    order = np.lexsort((*x.T, y))  # the order of arrival differs between runs; sums must not
    return x[order], y[order]
