"""Structured snapshots (HDF5) and refined plotfiles as Python data sources.

HDF5 snapshots need h5py, plotfiles yt; without them the readers name what is missing.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import NumericType

from ..functions.numeric import finite, num
from ..operators.grid import ALIASES, with_units
from .text import series_files

# The fields of a snapshot file in the order of their datasets.
FIELDS_2D_SPECIES = ("alpha_rho1", "rho", "rho_u", "rho_v", "u", "v", "Y_O2", "Y_N2", "E", "p", "alpha", "c", "schlieren")
FIELDS_2D = ("alpha_rho", "rho", "rho_u", "rho_v", "u", "v", "E", "p", "alpha", "c", "ib_markers")
FIELDS_3D = ("alpha_rho", "rho", "rho_u", "rho_v", "rho_w", "u", "v", "w", "E", "p", "alpha", "c", "ib_markers")
DEFAULT_AMR = ("Temp", "pressure", "density", "x_velocity", "y_velocity")


def dataset_name(ordinal: int) -> str:
    return f"/.silo/#0000{ordinal:02d}"


def data_file(path: str) -> str:
    """The file that holds a snapshot's data: of a master collection_N, the one rank file p*/N beside it."""
    folder, name = os.path.split(path)
    m = re.fullmatch(r"collection_(.+)", name)
    if not m:
        return path
    found = [os.path.join(folder, d, m[1]) for d in sorted(os.listdir(folder)) if re.fullmatch(r"p\d+", d) and os.path.exists(os.path.join(folder, d, m[1]))]
    if len(found) > 1:
        raise ValueError(f"several rank files for {path}: {found}")
    return found[0] if found else path


def _open(path: str):
    try:
        import h5py
    except ImportError as e:
        raise ImportError("HDF5 snapshots need h5py") from e
    return h5py.File(data_file(path), "r")


def read_block(db, names: tuple[str, ...], first: int, axes: list[np.ndarray], wanted: set[str]) -> dict[str, np.ndarray]:
    """Flat fields of an open snapshot with i, j, k and centre coordinates; x runs fastest."""
    centre = [(a[1:] + a[:-1]) / 2 for a in axes]
    sizes = [len(c) for c in centre]
    pos = np.arange(int(np.prod(sizes)))
    out = {"i": pos % sizes[0], "j": pos // sizes[0] % sizes[1]}
    out |= {"x": centre[0][out["i"]], "y": centre[1][out["j"]]}
    if len(sizes) == 3:
        out["k"] = pos // (sizes[0] * sizes[1])
        out["z"] = centre[2][out["k"]]
    for k, n in enumerate(names):
        if n in wanted:
            out[n] = np.asarray(db[dataset_name(first + k)]).reshape(-1)
    return out


class SnapshotSource(DataSource):
    """format("gridweave_snapshot"): option paths (comma-joined), fields, dims (2 or 3), species."""

    @classmethod
    def name(cls) -> str:
        return "gridweave_snapshot"

    def _names(self) -> tuple[str, ...]:
        if self.options.get("dims", "2") == "3":
            return FIELDS_3D
        return FIELDS_2D_SPECIES if self.options.get("species", "true") == "true" else FIELDS_2D

    def _wanted(self) -> list[str]:
        asked = self.options.get("fields")
        return [n for n in self._names() if asked is None or n in asked.split(",")]

    def schema(self) -> str:
        three = ", k int, z double" if self.options.get("dims", "2") == "3" else ""
        return "path string, i int, j int, x double, y double" + three + "".join(f", {n} double" for n in self._wanted())

    def reader(self, schema) -> DataSourceReader:
        return SnapshotReader(self.options["paths"].split(","), self._names(), self._wanted(), self.options.get("dims", "2") == "3")


class SnapshotReader(DataSourceReader):
    def __init__(self, paths, names, wanted, three):
        self.paths, self.names, self.wanted, self.three = paths, names, wanted, three

    def partitions(self):
        return [InputPartition(p) for p in self.paths]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        with _open(partition.value) as db:
            axes = [np.asarray(db[dataset_name(k)]) for k in range(1, 4 if self.three else 3)]
            got = read_block(db, self.names, len(axes) + 1, axes, set(self.wanted))
        order = ["i", "j", "x", "y", *(["k", "z"] if self.three else []), *self.wanted]
        n = len(got["i"])
        for at in range(0, n, 1 << 16):
            some = {c: pa.array(got[c][at : at + (1 << 16)], pa.int32() if c in "ijk" else pa.float64()) for c in order}
            yield pa.record_batch({"path": pa.array([partition.value] * len(some["i"]))} | some)


def snapshots(spark: SparkSession, paths: list[str], fields=None, three: bool = False, species: bool = True) -> DataFrame:
    """path, snapshot and the cells of snapshot files, a partition a file."""
    spark.dataSource.register(SnapshotSource)
    reader = spark.read.format("gridweave_snapshot").option("paths", ",".join(paths)).option("dims", "3" if three else "2").option("species", str(species).lower())
    if fields is not None:
        reader = reader.option("fields", ",".join(fields))
    return reader.load().withColumn("snapshot", F.regexp_extract("path", r"(\d+)[^/\d]*$", 1).try_cast("long"))


def contents(cells: DataFrame) -> DataFrame:
    """field, n, low, high of every numeric column: how many values aren't null, and the range of the finite ones, in one pass."""
    names = [f.name for f in cells.schema if isinstance(f.dataType, NumericType)]
    ok = lambda n: F.when(finite(F.col(n).cast("double")), F.col(n).cast("double"))
    one = cells.agg(*(F.struct(F.lit(n).alias("field"), F.count(n).alias("n"), F.min(ok(n)).alias("low"), F.max(ok(n)).alias("high")).alias(f"c{k}") for k, n in enumerate(names)))
    return one.select(F.inline(F.array(*(f"c{k}" for k in range(len(names))))))


def flattened(levels: DataFrame, refine, top, fields, keys=("case_id", "plot_id")) -> DataFrame:
    """Cells of a refined hierarchy (level, i, j, fields) on the finest level's uniform grid: each cell covers its
    refine**(top - level) squared children and the finest cover of a child stays; refine and top are numbers or
    columns. Filter coarse cells to the wanted strip first: the children of all are as many as the finest grid's cells."""
    factor = F.pow(num(refine), num(top) - F.col("level")).cast("int")
    span = F.sequence(F.lit(0), factor - 1)
    children = levels.withColumn("_f", factor).withColumn("_a", F.explode(span)).withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_f") - 1)))
    placed = children.withColumns({"i": (F.col("i") * F.col("_f") + F.col("_a")).cast("long"), "j": (F.col("j") * F.col("_f") + F.col("_b")).cast("long")})
    return placed.groupBy(*keys, "i", "j").agg(*(F.max_by(f, "level").alias(f) for f in fields))


def plotfile_series(spark: SparkSession, source, prefix: str = "plt") -> DataFrame:
    """path, name, key of plotfiles: a folder with a Header is one itself; of another folder, its children that are folders
    with a Header, named by the prefix and without .old., in natural order of key; or the paths given.
    FileNotFoundError without the source."""
    if not isinstance(source, str) and not hasattr(source, "__fspath__"):
        return _series(spark, [os.fspath(p) for p in source])
    path = spark._jvm.org.apache.hadoop.fs.Path
    root = path(os.fspath(source))
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        raise FileNotFoundError(f"no plotfiles at {source}")
    if fs.exists(path(root, "Header")):
        return _series(spark, [os.fspath(source)])
    found = [s.getPath() for s in fs.listStatus(root) if s.isDirectory()]
    return series_files(spark.createDataFrame([(p.toString(),) for p in found if fs.exists(path(p, "Header"))], "path string"), prefix)


def _series(spark: SparkSession, paths: list[str]) -> DataFrame:
    return series_files(spark.createDataFrame([(p,) for p in paths], "path string"), prefix="", old=True)


_META = ("time", "top", "refine", "lo_x", "lo_y", "dx0", "dy0")


def plotfile_batches(path: str, fields=DEFAULT_AMR) -> Iterator[pa.RecordBatch]:
    """The cells of one plotfile with its metadata, grid by grid, by yt. KeyError if a field is missing."""
    try:
        import yt
    except ImportError as e:
        raise ImportError("plotfiles need yt") from e

    ds = yt.load(path)
    have = {n for _, n in ds.field_list}
    missing = [f for f in fields if f not in have]
    if missing:
        raise KeyError(f"no fields {missing} in {path}; there are {sorted(have)}")
    low, high, size = (np.asarray(x, float) for x in (ds.domain_left_edge, ds.domain_right_edge, ds.domain_dimensions))
    step = (high - low) / size
    meta = dict(zip(_META, (float(ds.current_time), int(ds.index.max_level), int(ds.refine_by), low[0], low[1], step[0], step[1]), strict=True))
    for g in ds.index.grids:
        begin = g.get_global_startindex()
        ii, jj = np.meshgrid(*(np.arange(g.ActiveDimensions[a]) + begin[a] for a in (0, 1)), indexing="ij")
        n = ii.size
        same = {k: pa.array(np.full(n, v), pa.int32() if k in ("top", "refine") else pa.float64()) for k, v in meta.items()}
        place = {"level": pa.array(np.full(n, g.Level), pa.int32()), "i": pa.array(ii.ravel(), pa.int64()), "j": pa.array(jj.ravel(), pa.int64())}
        yield pa.record_batch({"path": pa.array([path] * n)} | same | place | {f: pa.array(np.asarray(g[f], float)[:, :, 0].ravel()) for f in fields})


class PlotfileSource(DataSource):
    """format("gridweave_plotfile"): options paths and fields (comma-joined)."""

    @classmethod
    def name(cls) -> str:
        return "gridweave_plotfile"

    def _fields(self) -> tuple[str, ...]:
        asked = self.options.get("fields")
        return tuple(asked.split(",")) if asked else DEFAULT_AMR

    def schema(self) -> str:
        meta = ", ".join(f"{k} {'int' if k in ('top', 'refine') else 'double'}" for k in _META)
        return f"path string, {meta}, level int, i long, j long" + "".join(f", `{f}` double" for f in self._fields())

    def reader(self, schema) -> DataSourceReader:
        return PlotfileReader(self.options["paths"].split(","), self._fields())


class PlotfileReader(DataSourceReader):
    """A partition a plotfile; grids are read one by one."""

    def __init__(self, paths, fields):
        self.paths, self.fields = paths, fields

    def partitions(self):
        return [InputPartition(p) for p in self.paths]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        yield from plotfile_batches(partition.value, self.fields)


def plotfile_levels(spark: SparkSession, paths: list[str], fields=DEFAULT_AMR) -> DataFrame:
    """path, time, the hierarchy's shape, level, i, j and raw fields of plotfiles."""
    spark.dataSource.register(PlotfileSource)
    return spark.read.format("gridweave_plotfile").option("paths", ",".join(paths)).option("fields", ",".join(fields)).load()


def plotfile_cells(levels: DataFrame, fields=DEFAULT_AMR, si: bool = True) -> DataFrame:
    """path, time, i, j, x, y and the fields by their canonical names, on each plotfile's finest grid, in SI units
    unless they are to stay as they are."""
    flat = flattened(levels, F.col("refine").cast("double"), F.col("top").cast("double"), fields, ("path", *_META))
    fine = F.pow(F.col("refine").cast("double"), F.col("top").cast("double"))
    out = flat.withColumns({a: F.col(f"lo_{a}") + (F.col(k) + 0.5) * F.col(f"d{a}0") / fine for a, k in (("x", "i"), ("y", "j"))})
    out = with_units(out, fields) if si else out
    return out.select("path", "time", "i", "j", "x", "y", *(F.col(f).alias(ALIASES.get(f, f)) for f in fields))
