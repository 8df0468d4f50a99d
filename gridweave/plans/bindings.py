"""How the driver's tables stand in for simulation output, and the same bindings in SQL.

grid: lineitem by quantity (x, 50 stations) and discount (y, 11 stations). Fields come from exact integer
sums, so both engines start from the same doubles. grid3 adds the line number (z). probe: events by user.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fields(df: DataFrame) -> DataFrame:
    n = F.col("n").cast("double")
    price, tax, lines = (F.col(c).cast("double") / n for c in ("cents", "tax", "lines"))
    out = df.withColumns({"rho": 1.0 + price / 1e7, "u": 100.0 + lines * 50.0, "v": tax * 3.0 - 12.0, "p": 100000.0 + price / 100.0, "c": 340.0 + tax})
    marker = F.least(F.greatest(0.5 + F.col("i").cast("double") / 10.0 - F.col("j").cast("double"), F.lit(0.0)), F.lit(1.0))
    return out.withColumns({"ib_markers": marker, "vel_mag": F.when(marker > 0.3, F.lit(0.0)).otherwise(F.lit(50.0)), "Temperature": F.col("p") / (F.col("rho") * 287.05), "w": F.col("c") - 340.0})


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    i, j = (F.col("l_quantity").cast("int") - 1), F.round(F.col("l_discount") * 100).cast("int")
    cells = li.groupBy(i.alias("i"), j.alias("j")).agg(
        F.count("*").alias("n"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"),
        F.sum(F.round(F.col("l_tax") * 100).cast("long")).alias("tax"), F.sum("l_linenumber").alias("lines"),
    )
    axes = cells.withColumns({"x": F.col("i").cast("double") + 1.0, "y": F.col("j").cast("double") / 100.0, "case_id": F.lit("a"), "snapshot": F.lit(0).cast("long")})
    return _fields(axes).drop("n", "cents", "tax", "lines")


def grid3(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    i, j, k = (F.col("l_quantity").cast("int") - 1), F.round(F.col("l_discount") * 100).cast("int"), F.col("l_linenumber") - 1
    cells = li.groupBy(i.alias("i"), j.alias("j"), k.alias("k")).agg(
        F.count("*").alias("n"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"),
        F.sum(F.round(F.col("l_tax") * 100).cast("long")).alias("tax"), F.sum("l_linenumber").alias("lines"),
    )
    axes = cells.withColumns({"x": F.col("i").cast("double") + 1.0, "y": F.col("j").cast("double") / 100.0, "z": F.col("k").cast("double"), "case_id": F.lit("a"), "snapshot": F.lit(0).cast("long")})
    return _fields(axes).drop("n", "cents", "tax", "lines")


def probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id, probe_id, seq (time order), t (seconds since the first event), rho, u, p, value."""
    from pyspark.sql import Window

    ev = table(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").alias("probe_id"), F.col("value").cast("double").alias("value"))
    w = Window.partitionBy("probe_id")
    clock = F.hour("ts") * 3600 + F.minute("ts") * 60
    seconds = F.datediff("ts", F.lit("1970-01-01")).cast("long") * 86400 + clock  # of a time without a zone
    micros = seconds * 1000000 + (F.extract(F.lit("SECOND"), F.col("ts")) * 1000000).cast("long")
    out = ev.withColumns({"t": (micros - F.min(micros).over(w)).cast("double") / 1e6, "seq": F.row_number().over(w.orderBy("ts", "event_id")).cast("long"), "case_id": F.lit("a")})
    return out.select("case_id", "probe_id", "seq", "t", (1.0 + F.col("value") / 1000.0).alias("rho"), (F.col("value") * 2.0).alias("u"), (1000.0 + F.col("value")).alias("p"), "value")


def knots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x (part size), y (mean price from exact cents)."""
    part = table(spark, sf_dir, "part")
    cents = F.sum(F.round(F.col("p_retailprice") * 100).cast("long")).cast("double")
    return part.groupBy(F.col("p_size").cast("double").alias("x")).agg((cents / F.count("*").cast("double") / 100.0).alias("y"))


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A body surface: side, idx, i, x, y from the lowest and highest marked cell of each grid column."""
    g = grid(spark, sf_dir).filter("ib_markers > 0.1")
    ends = g.groupBy("i", "x").agg(F.min("y").alias("lower"), F.max("y").alias("upper"))
    sides = ends.select("i", "x", F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(s).alias("y")) for s in ("lower", "upper")))).alias("s"))
    return sides.select("i", "x", "s.side", "s.y").withColumn("idx", F.col("i"))


def angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part_id, theta (radians, some not positive), m, re, t, x."""
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey").cast("double")
    return part.select(
        F.col("p_partkey").alias("part_id"), ((k % 41.0) - 4.0).alias("deg"), (((k % 41.0) - 4.0) * 0.017453292519943295).alias("theta"), (1.0 + (k % 13.0) / 2.0).alias("m"),
        ((k % 97.0) * 12345.0).alias("re"), (150.0 + (k % 211.0) * 2.0).alias("t"), ((k % 601.0) / 1000.0).alias("x"),
    )


def points3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tri_id, v: triangles of the first nine components of each embedding."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    vertex = lambda k: F.struct(e[3 * k].alias("x"), e[3 * k + 1].alias("y"), e[3 * k + 2].alias("z"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("tri_id"), F.array(*map(vertex, range(3))).alias("v"))


# --- the same in DuckDB -----------------------------------------------------------------------------

_AGG = """count(*) AS n, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) AS cents,
 CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE) AS tax, CAST(sum(l_linenumber) AS DOUBLE) AS lines"""
_FIELDS = """CAST(1 AS DOUBLE) + cents / n / CAST(1e7 AS DOUBLE) AS rho, CAST(100 AS DOUBLE) + lines / n * 50 AS u, tax / n * 3 - 12 AS v,
 CAST(100000 AS DOUBLE) + cents / n / 100 AS p, CAST(340 AS DOUBLE) + tax / n AS c,
 least(greatest(CAST(0.5 AS DOUBLE) + CAST(i AS DOUBLE) / 10 - CAST(j AS DOUBLE), 0), 1) AS ib_markers"""
_MORE = """CASE WHEN ib_markers > 0.3 THEN CAST(0 AS DOUBLE) ELSE CAST(50 AS DOUBLE) END AS vel_mag, p / (rho * CAST(287.05 AS DOUBLE)) AS Temperature, c - 340 AS w"""


def _grid_sql(name: str, third: str, key: str, axis: str) -> str:
    return f"""{name}0 AS (SELECT CAST(l_quantity AS INT) - 1 AS i, CAST(round(l_discount * 100) AS INT) AS j{third}, {_AGG} FROM lineitem GROUP BY 1, 2{key}),
{name}1 AS (SELECT *, CAST(i AS DOUBLE) + 1 AS x, CAST(j AS DOUBLE) / 100 AS y{axis}, 'a' AS case_id, CAST(0 AS BIGINT) AS snapshot, {_FIELDS} FROM (SELECT * REPLACE (CAST(n AS DOUBLE) AS n) FROM {name}0)),
{name} AS (SELECT * EXCLUDE (n, cents, tax, lines), {_MORE} FROM {name}1)"""


GRID = _grid_sql("grid", "", "", "")
GRID3 = _grid_sql("grid3", ", l_linenumber - 1 AS k", ", 3", ", CAST(k AS DOUBLE) AS z")
PROBE = """probe0 AS (SELECT event_id, ts, user_id AS probe_id, CAST(value AS DOUBLE) AS value, epoch_us(ts) AS us FROM events),
probe AS (SELECT 'a' AS case_id, probe_id, row_number() OVER (PARTITION BY probe_id ORDER BY ts, event_id) AS seq,
 CAST(us - min(us) OVER (PARTITION BY probe_id) AS DOUBLE) / 1000000 AS t, CAST(1 AS DOUBLE) + value / 1000 AS rho, value * 2 AS u, value + 1000 AS p, value FROM probe0)"""
KNOTS = """knots AS (SELECT CAST(p_size AS DOUBLE) AS x, CAST(sum(CAST(round(p_retailprice * 100) AS BIGINT)) AS DOUBLE) / CAST(count(*) AS DOUBLE) / 100 AS y FROM part GROUP BY 1)"""
STATIONS = f"""{GRID}, ends AS (SELECT i, x, min(y) AS lo, max(y) AS hi FROM grid WHERE ib_markers > 0.1 GROUP BY 1, 2),
stations AS (SELECT i, x, 'lower' AS side, lo AS y, i AS idx FROM ends UNION ALL SELECT i, x, 'upper', hi, i FROM ends)"""
ANGLES = """angles AS (SELECT p_partkey AS part_id, (CAST(p_partkey AS DOUBLE) % 41) - 4 AS deg, ((CAST(p_partkey AS DOUBLE) % 41) - 4) * CAST(0.017453292519943295 AS DOUBLE) AS theta,
 CAST(1 AS DOUBLE) + (CAST(p_partkey AS DOUBLE) % 13) / 2 AS m, (CAST(p_partkey AS DOUBLE) % 97) * 12345 AS re, CAST(150 AS DOUBLE) + (CAST(p_partkey AS DOUBLE) % 211) * 2 AS t,
 (CAST(p_partkey AS DOUBLE) % 601) / 1000 AS x FROM part)"""
POINTS = """tri AS (SELECT vec_id AS tri_id, [CAST(embedding[3*k+1] AS DOUBLE) FOR k IN range(3)] AS xs, [CAST(embedding[3*k+2] AS DOUBLE) FOR k IN range(3)] AS ys,
 [CAST(embedding[3*k+3] AS DOUBLE) FOR k IN range(3)] AS zs FROM embeddings)"""
