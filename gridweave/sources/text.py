"""Text sources: white-space tables, curves, ASCII triangles, probe files, frame folders."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stencil import natural_key


def _column(spec, header: dict[str, int], role: str) -> int:
    if isinstance(spec, int):
        return spec
    if spec not in header:
        raise ValueError(f"no column {spec!r} for {role}; there are {sorted(header)}")
    return header[spec]


def header_of(spark: SparkSession, path: str, comment: str = "#") -> dict[str, int]:
    """Column names by place if the first line of a file that isn't blank starts with the comment sign, else none."""
    line = spark.read.text(path).filter(F.trim(F.regexp_replace("value", r"\s+", " ")) != "").head()
    first = (line[0] if line else "").strip()
    return {n: k for k, n in enumerate(first[len(comment) :].split())} if first.startswith(comment) else {}


def table(spark: SparkSession, path, columns: dict[str, object], comment: str = "#", header: dict[str, int] | None = None) -> DataFrame:
    """path, seq and the named columns (by name or place) of white-space tables, as doubles; comments and
    blank lines are skipped. seq orders the rows of a file."""
    header = header or {}
    places = {n: _column(c, header, n) for n, c in columns.items()}
    text = F.trim(F.regexp_replace(F.split("value", comment)[0], r"[\t\r]", " "))
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("seq"), text.alias("line"))
    parts = F.split("line", r"\s+")
    return rows.filter("line <> ''").select("path", "seq", *(parts[k].cast("double").alias(n) for n, k in places.items()))


def probes(spark: SparkSession, paths, case_id: str = "case", pattern: str = r"probe(\d+)") -> DataFrame:
    """case_id, probe_id, seq, t, rho, u, p of probe files, one series a file."""
    got = table(spark, paths, {"t": 0, "rho": 1, "u": 2, "p": 3})
    return got.select(F.lit(case_id).alias("case_id"), F.regexp_extract("path", pattern, 1).try_cast("int").alias("probe_id"), "seq", "t", "rho", "u", "p")


# What the second solver's pressure and temperature are divided by.
SECOND_P, SECOND_T = 7600.0, 125.0


def second_probes(spark: SparkSession, paths, case_id: str = "case") -> DataFrame:
    """case_id, seq, t, p_ratio, T_ratio of the second solver's probe tables (columns 0, 3 and 4)."""
    got = table(spark, paths, {"t": 0, "p": 3, "Temperature": 4})
    return got.select(F.lit(case_id).alias("case_id"), "seq", "t", (F.col("p") / SECOND_P).alias("p_ratio"), (F.col("Temperature") / SECOND_T).alias("T_ratio"))


def curve(spark: SparkSession, path) -> DataFrame:
    """tau, ratio of a two-column CSV without a header."""
    return spark.read.schema("tau double, ratio double").csv(path, ignoreLeadingWhiteSpace=True)


def scaled_profile(profile: DataFrame, y: str = "y", value: str = "value", transform: str = "identity", x: float | None = None, unit_reynolds: float | None = None, y_scale: float = 1.0, value_scale: float = 1.0) -> DataFrame:
    """y and value of a profile from elsewhere: y scaled by sqrt(x / unit_reynolds) for `boundary_layer_nondim`."""
    factor = 1.0
    if transform == "boundary_layer_nondim":
        if x is None or unit_reynolds is None:
            raise ValueError("boundary_layer_nondim needs x and unit_reynolds")
        factor = (x / unit_reynolds) ** 0.5
    elif transform != "identity":
        raise ValueError(f"no transform {transform!r}")
    return profile.withColumns({y: F.col(y) * factor * y_scale, value: F.col(value) * value_scale})


def triangles(spark: SparkSession, path) -> DataFrame:
    """tri_id, v (three points), n of ASCII triangle files; facets without exactly three vertices are dropped.
    ValueError without any facet left: it is looked for at once."""
    number = r"[-+0-9.eEinfaN]+"
    rows = spark.read.text(path, lineSep="endfacet").select(F.monotonically_increasing_id().alias("tri_id"), "value")
    point = lambda t: F.transform(F.regexp_extract_all(t, F.lit(f"({number})"), F.lit(1)), lambda n: n.cast("double"))
    vertices = F.regexp_extract_all("value", F.lit(rf"vertex\s+({number}\s+{number}\s+{number})"), F.lit(1))
    xyz = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"), p[2].alias("z"))
    normal = F.regexp_extract("value", rf"facet\s+normal\s+({number}\s+{number}\s+{number})", 1)
    found = rows.withColumns({"v": vertices, "n": normal}).filter(F.col("n") != "")
    whole = found.filter(F.size("v") == 3)
    if whole.isEmpty():
        raise ValueError(f"no facets in {path}")
    return whole.select("tri_id", F.transform("v", lambda t: xyz(point(t))).alias("v"), xyz(point(F.col("n"))).alias("n"))


def frames(spark: SparkSession, folder: str, extension: str = "png") -> DataFrame:
    """path and content of a folder's frames in lexicographic order of their paths; ValueError without one."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{extension}").load(folder)
    if found.select("path").isEmpty():
        raise ValueError(f"no {extension} frames in {folder}")
    return found.select("path", "content").orderBy("path")


def series_files(paths: DataFrame, prefix: str = "plt", column: str = "path", old: bool = False) -> DataFrame:
    """path, name, key of the snapshot folders among path strings, by prefix; .old. ones are left out unless they
    are asked for. The key gives their natural order."""
    name = F.element_at(F.split(F.rtrim(F.col(column), F.lit("/")), "/"), -1)
    kept = paths.select(F.col(column).alias("path"), name.alias("name")).filter(F.col("name").startswith(prefix))
    if not old:
        kept = kept.filter(~F.col("name").contains(".old."))
    return kept.withColumn("key", natural_key("name"))


def option_bool(value: object, name: str = "option") -> bool:
    """A bool from a bool, 0 or 1, or a word, whatever its case and blanks."""
    if isinstance(value, bool):
        return value
    word = str(value).strip().lower()
    if word in ("true", "1", "yes", "y", "on"):
        return True
    if word in ("false", "0", "no", "n", "off"):
        return False
    raise ValueError(f"{name} isn't a bool: {value!r}")


def resolved(path, base_dir=None) -> str:
    """A path as it is if it is absolute or a URI, else under the base folder, if there is one."""
    path = os.fspath(path)
    return path if base_dir is None or os.path.isabs(path) or "://" in path else os.path.join(os.fspath(base_dir), path)


def case_list(cases, name: str = "cases", base_dir=None) -> list[dict]:
    """A path, a mapping, or a list of either as mappings with `source`; relative paths are under base_dir."""
    if cases is None:
        return []
    many = cases if isinstance(cases, (list, tuple)) else [cases]
    out = []
    for one in many:
        got = {"source": one} if isinstance(one, str) or hasattr(one, "__fspath__") else one
        if not hasattr(got, "items"):
            raise TypeError(f"{name}: a case is a path or a mapping, not {type(one).__name__}")
        got = dict(got)
        got["source"] = got.get("source") or got.pop("path", None)
        if not got["source"]:
            raise ValueError(f"{name}: a case needs a source or a path")
        if base_dir is not None and (isinstance(got["source"], str) or hasattr(got["source"], "__fspath__")):
            got["source"] = resolved(got["source"], base_dir)
        out.append(got)
    return out


def pick(files: DataFrame, index: int = -1) -> DataFrame:
    """The row of a file index at a place in natural order, chosen before anything is read; places below 0
    count from the end. IndexError out of range."""
    skip, order = (index, F.asc("key")) if index >= 0 else (-index - 1, F.desc("key"))
    found = files.orderBy(order).offset(skip).limit(1)
    if found.isEmpty():
        raise IndexError(f"no file at place {index}")
    return found


def snapshot_range(spark: SparkSession, start: int, stop: int, step: int, present: DataFrame | None = None) -> DataFrame:
    """snapshot of a range, those without a file left out."""
    out = spark.range(start, stop, step).withColumnRenamed("id", "snapshot")
    return out if present is None else out.join(present, "snapshot", "left_semi")
