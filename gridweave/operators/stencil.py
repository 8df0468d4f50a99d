"""Ordered operators on lines and profiles: gradients, integrals, fits, gaps, neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import fdiv, num
from .scan import held, parts, with_neighbours, with_previous, with_running_sum


def gradient_uniform(f, w, spacing) -> Column:
    """Central differences inside, one-sided at the ends, of a line with one spacing; null on a line of one."""
    f, h = num(f), num(spacing)
    before, after = F.lag(f).over(w), F.lead(f).over(w)
    return (
        F.when(before.isNull(), (after - f) / h)
        .when(after.isNull(), (f - before) / h)
        .otherwise((after - before) / (2.0 * h))
    )


def gradient(f, x, w) -> Column:
    """Second-order gradient on uneven coordinates, one-sided at the ends."""
    f, x = num(f), num(x)
    f0, f1, x0, x1 = F.lag(f).over(w), F.lead(f).over(w), F.lag(x).over(w), F.lead(x).over(w)
    hs, hd = x - x0, x1 - x
    inner = (hs * hs * f1 + (hd * hd - hs * hs) * f - hd * hd * f0) / (hs * hd * (hs + hd))
    return F.when(x0.isNull(), (f1 - f) / (x1 - x)).when(x1.isNull(), (f - f0) / (x - x0)).otherwise(inner)


def difference(x, w) -> Column:
    return num(x) - F.lag(num(x)).over(w)


def running(w):
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def with_arc_length(df: DataFrame, x: str, y: str, keys, order: str, out: str = "s", long: bool = False) -> DataFrame:
    """Running length of the polyline, 0 at its first point. long: lines may be longer than a task should hold,
    and go through range partitions."""
    if long:
        cut = with_previous(parts(df, keys, order), keys, order, [x, y], "_p")
        step = F.sqrt(F.pow(F.col(x) - F.col(f"_p.{x}"), F.lit(2.0)) + F.pow(F.col(y) - F.col(f"_p.{y}"), F.lit(2.0)))
        return with_running_sum(cut, keys, order, step, out).select(*df.columns, out)
    w = Window.partitionBy(*keys).orderBy(order)
    dx, dy = difference(x, w), difference(y, w)
    return df.withColumn("_ds", F.coalesce(F.sqrt(dx * dx + dy * dy), F.lit(0.0))).withColumn(out, F.sum("_ds").over(running(w))).drop("_ds")


def trapezoid_steps(f, s, w) -> Column:
    f, s = num(f), num(s)
    return (F.lag(f).over(w) + f) / 2.0 * (s - F.lag(s).over(w))


def _long_steps(df: DataFrame, f, s, keys, order: str) -> DataFrame:
    """Parts of df with _step, each row's term of the trapezoid rule, null on a key's first row."""
    cut = parts(df.withColumns({"_f": num(f), "_s": num(s)}), keys, order)
    return with_previous(cut, keys, order, ["_f", "_s"], "_p").withColumn("_step", (F.col("_p._f") + F.col("_f")) / 2.0 * (F.col("_s") - F.col("_p._s")))


def with_running_trapezoid(df: DataFrame, f, s, keys, order: str, out: str, long: bool = False) -> DataFrame:
    if long:
        return with_running_sum(_long_steps(df, f, s, keys, order), keys, order, F.col("_step"), out).select(*df.columns, out)
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_step", F.coalesce(trapezoid_steps(f, s, w), F.lit(0.0))).withColumn(out, F.sum("_step").over(running(w))).drop("_step")


def trapezoid(df: DataFrame, f, s, keys, order: str, out: str, long: bool = False) -> DataFrame:
    """keys and the integral of f over s; 0 for one point. long: as in with_arc_length."""
    if long:
        return _long_steps(df, f, s, keys, order).groupBy(*keys).agg(F.coalesce(F.sum("_step"), F.lit(0.0)).alias(out))
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_step", trapezoid_steps(f, s, w)).groupBy(*keys).agg(F.coalesce(F.sum("_step"), F.lit(0.0)).alias(out))


def head_slope(df: DataFrame, y: str, x: str, keys, order: str, n: int, out: str = "slope") -> DataFrame:
    """Slope of the least-squares line through the first n points of each group."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).groupBy(*keys).agg(F.regr_slope(y, x).alias(out))


def origin_fit(df: DataFrame, u: str, s: str, keys, min_points: int = 2) -> DataFrame:
    """keys, a, b, n: least squares of u = a s + b s**2. One distinct s gives the least-norm solution;
    fewer than min_points rows with both values give null."""
    ok = df.filter(F.col(u).isNotNull() & F.col(s).isNotNull() & ~F.isnan(u) & ~F.isnan(s))
    c, v = F.col(s), F.col(u)
    sums = ok.groupBy(*keys).agg(
        F.sum(c * c).alias("s2"), F.sum(c * c * c).alias("s3"), F.sum(c * c * c * c).alias("s4"), F.sum(c * v).alias("t1"), F.sum(c * c * v).alias("t2"),
        F.count("*").alias("n"), F.min(s).alias("lo"), F.max(s).alias("hi"), F.avg(u).alias("mean"),
    )
    det = F.col("s2") * F.col("s4") - F.col("s3") * F.col("s3")
    flat = F.col("lo") == F.col("hi")  # one distinct s
    norm = F.col("lo") * F.col("lo") + F.pow("lo", F.lit(4))
    a = F.when(flat, fdiv(F.col("mean") * F.col("lo"), norm)).otherwise(fdiv(F.col("t1") * F.col("s4") - F.col("t2") * F.col("s3"), det))
    b = F.when(flat, fdiv(F.col("mean") * F.col("lo") * F.col("lo"), norm)).otherwise(fdiv(F.col("s2") * F.col("t2") - F.col("s3") * F.col("t1"), det))
    enough = F.col("n") >= min_points
    return sums.select(*keys, F.when(enough, a).alias("a"), F.when(enough, b).alias("b"), "n")


def fill_gaps(df: DataFrame, f: str, keys, order: str, out: str) -> DataFrame:
    """Missing (null or NaN) values by linear interpolation over the order column; ends take the nearest value."""
    w = Window.partitionBy(*keys).orderBy(order)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    ok = F.col(f).isNotNull() & ~F.isnan(f)
    at = F.when(ok, F.struct(F.col(order).cast("double").alias("o"), F.col(f).alias("v")))
    a, b = F.last(at, ignorenulls=True).over(back), F.first(at, ignorenulls=True).over(ahead)
    middle = a["v"] + (b["v"] - a["v"]) * (F.col(order) - a["o"]) / (b["o"] - a["o"])
    return df.withColumn(out, F.when(ok, F.col(f)).when(a.isNull(), b["v"]).when(b.isNull(), a["v"]).otherwise(middle))


def _successors(rows: DataFrame, keys) -> DataFrame:
    """rows (keys, _run, _x, _tol) with _next: the first station of the run that is _tol or more beyond _x, if there is one. The place to
    look at is rounded, so the station before it and the two after it are held against the rule itself."""
    by = [*keys, "_run"]
    stations = rows.select(*by, F.col("_x").alias("_q"), F.struct("_x").alias("_at"), F.lit(None).cast("double").alias("_from"), "_tol")
    asked = rows.select(*by, (F.col("_x") + F.col("_tol")).alias("_q"), F.lit(None).cast("struct<_x:double>").alias("_at"), F.col("_x").alias("_from"), "_tol")
    cut = with_neighbours(parts(stations.unionByName(asked), by, "_q"), by, "_q", "_at")
    near = cut.filter("_from is not null").select(*by, F.col("_from").alias("_x"), "_tol", F.col("_before._x").alias("_b"), F.col("_after._x").alias("_a"))
    following = with_previous(parts(rows.select(*by, "_x"), by, "_x"), by, "_x", ["_x"], "_p").select(*by, F.col("_p._x").alias("_a"), F.col("_x").alias("_c")).filter("_a is not null")
    near = near.join(following, [*by, "_a"], "left")
    far = lambda c: F.when(F.col(c) - F.col("_x") >= F.col("_tol"), F.col(c))
    return near.select(*by, "_x", F.coalesce(far("_b"), far("_a"), far("_c")).alias("_next"))


def anchored_bins(df: DataFrame, x: str, keys, tolerance: Column | float | None = None, values=()) -> DataFrame:
    """keys, bin, x and the min and max of each value: a bin ends when x is `tolerance` or more from its FIRST x.

    The rule isn't a chain of gaps. But a station that far from the one before it begins a bin whatever came before, so runs
    between such gaps are apart, and a run shorter than the tolerance is one bin. In other runs each station knows its successor, the
    next bin's first x if it were one itself; the first x's are those reached from the run's first station, found by doubling
    the jumps. Stations lie in range partitions throughout, so a body of any number of them needs no task to hold it.
    The tolerance, or the range / 1e6 if none is given, is a group's own. Null x's are left out.
    """
    keys = list(keys)
    stations = df.filter(F.col(x).isNotNull()).groupBy(*keys, F.col(x).cast("double").alias("_x")).agg(*(f(v).alias(f"{n}_{v}") for v in values for n, f in (("min", F.min), ("max", F.max))))
    cut = parts(stations, keys, "_x")
    by = keys or ["_all"]
    tol = num(tolerance) if tolerance is not None else (F.max("_x") - F.min("_x")) / 1e6
    cut = cut.join(F.broadcast(cut.groupBy(*by).agg(tol.alias("_tol") if tolerance is None else F.first(tol).alias("_tol"))), by)  # a row a group
    cut = with_previous(cut, keys, "_x", ["_x"], "_p")
    opens = F.col("_p").isNull() | (F.col("_x") - F.col("_p._x") >= F.col("_tol"))
    cut = held(with_running_sum(cut.withColumn("_open", opens), keys, "_x", opens.cast("double"), "_run").drop("_p"))
    runs = cut.groupBy(*by, "_run").agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.first("_tol").alias("_t"))
    wide = runs.filter(F.col("_hi") - F.col("_lo") >= F.col("_t")).select(*by, "_run", "_lo")
    marks = wide.select(*by, "_run", F.col("_lo").alias("_x"))
    if wide.head(1):
        dense = cut.select(*by, "_run", "_x", "_tol").join(wide.select(*by, "_run"), [*by, "_run"])
        jumps = held(_successors(dense, by).filter("_next is not null"))
        marks, count = held(marks), 0
        while (n := marks.count()) != count:
            count, at = n, [*by, "_run", "_x"]
            moved = marks.join(jumps, at).select(*by, "_run", F.col("_next").alias("_x"))
            marks = held(marks.union(moved).distinct())
            twice = jumps.select(*by, "_run", F.col("_x").alias("_next"), F.col("_next").alias("_then"))
            jumps = held(jumps.join(twice, [*by, "_run", "_next"]).select(*by, "_run", "_x", F.col("_then").alias("_next")))
    first = marks.select(*(F.col(k).alias(k) for k in by), F.col("_x").alias("_x"), F.lit(True).alias("_mark"))
    cut = cut.join(first, [*by, "_x"], "left")
    anchor = F.when(F.col("_open") | F.coalesce("_mark", F.lit(False)), F.struct("_x"))
    cut = with_neighbours(cut.withColumn("_at", anchor), keys, "_x", "_at")
    cut = with_running_sum(cut, keys, "_x", F.col("_at").isNotNull().cast("double"), "_bin")
    done = cut.groupBy(*keys, (F.col("_bin") - 1).cast("int").alias("bin"), F.col("_before._x").alias(x))
    return done.agg(*(f(f"{n}_{v}").alias(f"{n}_{v}") for v in values for n, f in (("min", F.min), ("max", F.max))) or [F.count("*").alias("_n")]).drop("_n")


def natural_key(path) -> Column:
    """Orders digit runs by number and the rest in lower case."""
    parts = F.regexp_extract_all(F.lower(num(path)), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.transform(parts, lambda t: F.when(t.rlike(r"^\d"), F.lpad(t, 20, "0")).otherwise(t))


def linspace(spark, start: float, stop: float, n: int) -> DataFrame:
    """ord, value: n evenly spaced values, both ends included; n = 1 gives the start."""
    step = (stop - start) / (n - 1) if n > 1 else 0.0
    ids = spark.range(n).select(F.col("id").cast("int").alias("ord"))
    last = F.lit(float(stop)) if n > 1 else F.lit(float(start))
    return ids.withColumn("value", F.when(F.col("ord") == n - 1, last).otherwise(start + F.col("ord") * step))
