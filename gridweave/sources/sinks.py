"""Sinks: plot-ready tables, run metrics, and frame sequences to video where an encoder is installed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def save_view(view: DataFrame, path: str, partition_by=()) -> str:
    """A plot-ready table as Parquet; returns its path."""
    view.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return path


def observed(df: DataFrame, field: str, name: str = "run") -> tuple[DataFrame, Observation]:
    """df whose next action also gives n, low, high and the finite count of a field, in the same pass."""
    seen = Observation(name)
    ok = F.col(field).isNotNull() & ~F.isnan(field)
    return df.observe(seen, F.count("*").alias("n"), F.min(F.when(ok, F.col(field))).alias("low"), F.max(F.when(ok, F.col(field))).alias("high"), F.count_if(ok).alias("finite")), seen


def save_video(frames: DataFrame, path: str, fps: int = 24) -> int:
    """Frames (path, content) in order as a video by OpenCV; those that can't be read are skipped. The frames
    are streamed to the driver one by one. ValueError without any frame."""
    try:
        import cv2
    except ImportError as e:
        raise ImportError("videos need cv2") from e
    import numpy as np

    out, count = None, 0
    for row in frames.toLocalIterator():
        image = cv2.imdecode(np.frombuffer(row["content"], np.uint8), cv2.IMREAD_COLOR)
        if image is None:
            continue
        if out is None:
            out = cv2.VideoWriter(path, cv2.VideoWriter_fourcc(*"mp4v"), fps, image.shape[1::-1])
        out.write(image)
        count += 1
    if out is None:
        raise ValueError("no frame to write")
    out.release()
    return count
