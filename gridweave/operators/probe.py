"""Probe time series: rows (case_id, probe_id, seq, t, …), one series a (case_id, probe_id)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.gas import temperature

SERIES = ("case_id", "probe_id")

# Reference pressure, temperature, length and speed of the ratios and the non-dimensional time.
P_REF, T_REF, LENGTH, SPEED = 760.0, 125.0, 0.1, 1726.0


def _window(keys=SERIES):
    return Window.partitionBy(*keys).orderBy("seq")


def derived(probe: DataFrame) -> DataFrame:
    """Temperature, ratios of pressure and temperature, and non-dimensional time; not named T, which would replace t."""
    t = temperature("p", "rho")
    return probe.withColumns({"Temperature": t,"p_ratio": F.col("p") / P_REF, "T_ratio": t / T_REF, "tau": F.col("t") / (LENGTH / SPEED)})


def head_fraction(probe: DataFrame, fraction: float, keys=SERIES) -> DataFrame:
    """The first max(1, int(n * fraction)) rows of each series, 0 < fraction <= 1."""
    if not 0 < fraction <= 1:
        raise ValueError("a fraction is in (0, 1]")
    n = F.count("*").over(Window.partitionBy(*keys))
    keep = F.greatest(F.lit(1), F.floor(n * F.lit(float(fraction))))
    return probe.withColumns({"_r": F.row_number().over(_window(keys)), "_k": keep}).filter("_r <= _k").drop("_r", "_k")


def reset_trim(probe: DataFrame, drop: float = 0.01, skip: int | None = None, keys=SERIES) -> DataFrame:
    """Rows after the first backward jump of time by more than `drop`; all where time never jumps.
    Only the first jump counts. With skip, the first `skip` rows go instead."""
    w = _window(keys)
    if skip is not None:
        return probe.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") > skip).drop("_r")
    jump = F.when(F.col("t") - F.lead("t").over(w) > drop, F.col("seq"))
    cut = F.min("_j").over(Window.partitionBy(*keys))
    return probe.withColumn("_j", jump).withColumn("_c", cut).filter("_c is null or seq > _c").drop("_j", "_c")


def sampling(probe: DataFrame, keys=SERIES) -> DataFrame:
    """keys, n, duration, dt (mean step) and rate of each series; dt and rate are null for one row."""
    stepped = probe.withColumn("_d", F.col("t") - F.lag("t").over(_window(keys)))
    out = stepped.groupBy(*keys).agg(F.count("*").alias("n"), (F.max("t") - F.min("t")).alias("duration"), F.avg("_d").alias("dt"))
    return out.withColumn("rate", F.try_divide(F.lit(1.0), F.col("dt")))


def detrend(probe: DataFrame, column: str, out: str, keys=SERIES) -> DataFrame:
    return probe.withColumn(out, F.col(column) - F.avg(column).over(Window.partitionBy(*keys)))


def spectrum(probe: DataFrame, column: str, keys=SERIES) -> DataFrame:
    """keys, k, frequency, amplitude: 2 |X_k| / N of the detrended series at frequencies above 0 (for even N
    the Nyquist line is left out). Sampling is taken as uniform; a series of one row has no lines."""
    types = {f.name: f.dataType.simpleString() for f in probe.schema}
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "k int", "frequency double", "amplitude double"])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("seq")
        v, t = np.asarray(table["v"], float), np.asarray(table["t"], float)
        n = len(v)
        lines = np.arange(1, (n + 1) // 2)
        x = np.fft.fft(v - v.mean())[lines]
        dt = np.diff(t).mean() if n > 1 else np.nan
        first = table.slice(0, 1)
        cols = {k: pa.array([first[k][0].as_py()] * len(lines), table.schema.field(k).type) for k in keys}
        with np.errstate(divide="ignore", invalid="ignore"):
            freq = lines / (n * dt)
        return pa.table(cols | {"k": pa.array(lines, pa.int32()), "frequency": pa.array(freq, pa.float64()), "amplitude": pa.array(2 * np.abs(x) / n, pa.float64())})

    return probe.select(*keys, "seq", "t", F.col(column).alias("v")).groupBy(*keys).applyInArrow(run, schema)


def union_of(*probes: DataFrame) -> DataFrame:
    """Series of several cases under one another; columns that a case lacks are null."""
    out = probes[0]
    for p in probes[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
