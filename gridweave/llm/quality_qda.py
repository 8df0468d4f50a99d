"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

Each class has a mean and a covariance shrunk toward its diagonal and the pooled one; a
document's score is the logistic of the (calibrated) difference of the two log densities,
taken from Mahalanobis distances by cached inverse Cholesky factors.

Nulls and empty texts: a null text is an empty text; its statistics are all 0 and it is scored
like any other. A null doc_id is passed through. Repeated rows are each scored. With no usable
labels, or labels of one class only, every score is 0.5. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_view, map_batches, sliced
from .labelled import SAMPLE_ROWS, features_of, held_out, training_rows
from .textstats import NAMES

#: Documents scored at least this are predicted to be of quality 1.
KEEP_AT = 0.3


@dataclass
class Qda:
    mean: np.ndarray  # class, feature
    whiten: np.ndarray  # class, feature, feature: inverse Cholesky factors
    logdet: np.ndarray  # class
    prior: np.ndarray  # class
    scale: float
    shift: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = transform(x)
        dens = []
        for c in (0, 1):
            d = (z - self.mean[c]) @ self.whiten[c].T
            dens.append(self.prior[c] - 0.5 * ((d * d).sum(1) + self.logdet[c]))
        return dens[1] - dens[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.margin(x) + self.shift, -500, 500)))


def transform(x: np.ndarray) -> np.ndarray:
    """Square roots of rates and shares; the two that are near normal already stay."""
    z = np.sqrt(np.maximum(x, 0))
    for name in ("log_words", "distinct_word_share"):
        z[:, NAMES.index(name)] = x[:, NAMES.index(name)]
    return z


def fit(x: np.ndarray, y: np.ndarray, shrink: float = 0.2, floor: float = 1e-3) -> Qda | None:
    """None unless both classes have rows."""
    if len(set(y.tolist())) < 2:
        return None
    z = transform(x)
    p = z.shape[1]
    means = np.stack([z[y == c].mean(0) for c in (0, 1)])
    resid = z - means[y]
    pooled = resid.T @ resid / len(z)
    mean, whiten, logdet = means, [], []
    for c in (0, 1):
        r = resid[y == c]
        own = r.T @ r / len(r)
        cov = (1 - shrink) * own + shrink * (0.5 * np.diag(np.diag(own)) + 0.5 * pooled) + floor * np.eye(p)
        chol = np.linalg.cholesky(cov)
        whiten.append(np.linalg.solve(chol, np.eye(p)))
        logdet.append(2 * np.log(np.diag(chol)).sum())
    prior = np.log(np.array([(y == 0).mean(), (y == 1).mean()]))
    model = Qda(mean, np.stack(whiten), np.array(logdet), prior, 1.0, 0.0)
    # logistic calibration of the margin on the same rows: Newton steps with a small ridge
    m = model.margin(x)
    s = np.clip(m / (np.abs(m).mean() + 1e-9), -20, 20)
    unit, a, b = np.abs(m).mean() + 1e-9, 1.0, 0.0
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(a * s + b, -35, 35)))
        w = q * (1 - q) + 1e-9
        g = np.array([((q - y) * s).sum() + 0.1 * (a - 1), (q - y).sum() + 0.1 * b])
        h = np.array([[(w * s * s).sum() + 0.1, (w * s).sum()], [(w * s).sum(), w.sum() + 0.1]])
        a, b = np.array([a, b]) - np.clip(np.linalg.solve(h, g), -2, 2)
    model.scale, model.shift = float(max(a, 1e-3) / unit), float(b)
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs; see the module for odd inputs."""
    model = fit(*training_rows(docs, labels, sample_rows))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = model.score(features_of(batch)) if model else np.full(batch.num_rows, 0.5)
        return pa.record_batch(
            {"doc_id": batch["doc_id"], "score": pa.array(score, pa.float64())}
        )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    out = map_batches(doc_view(docs, "doc_id", "text"), run, f"doc_id {id_type}, score double")
    return out.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= KEEP_AT).cast("int").alias("predicted"),
    )


def keep_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs that the classifier accepts, with all their columns; text is read once, in place."""
    model = fit(*training_rows(docs, labels, sample_rows))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if model is None or not batch.num_rows:
            return batch
        keep = model.score(features_of(batch)) >= KEEP_AT
        return batch.filter(pa.array(keep))

    def every(batches):
        for batch in batches:
            for piece in sliced(batch):
                yield run(piece)

    return docs.mapInArrow(every, docs.schema)
