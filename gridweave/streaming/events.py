"""Streaming forms of the time-series operators (an extension): windowed sampling and restart detection."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_sampling(events: DataFrame, ts: str, value: str, keys, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """keys, start, n, mean, low, high by tumbling windows; rows later than the watermark are dropped."""
    out = events.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), *keys)
    return out.agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high")).select(*keys, F.col("w.start").alias("start"), "n", "mean", "low", "high")


def restarts(series: DataFrame, key: str, t: str, drop: float = 0.01) -> DataFrame:
    """key, n_before, t_before, t_after of each backward jump of time by more than `drop`, in order of arrival.
    The state of a key is its row count and last time."""

    def step(name: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, last = state.get if state.exists else (0, None)
        out = []
        for frame in frames:
            for now in frame[t]:
                if last is not None and last - now > drop:
                    out.append((name[0], n, last, now))
                n, last = n + 1, float(now)
        state.update((n, last))
        yield pd.DataFrame(out, columns=[key, "n_before", "t_before", "t_after"])

    kind = dict(series.dtypes)[key]
    return series.select(key, t).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n_before long, t_before double, t_after double", "n long, last double", "append", "NoTimeout")
