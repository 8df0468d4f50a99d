"""High-level queries over several cases: wall-normal profiles, streamline fields, snapshot views.

Each takes case mappings and a loader from a source to a cells DataFrame, and returns lazy DataFrames;
nothing is read until one is written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import boundary_layer as bl
from ..operators import fields as fo
from ..operators import grid as g
from ..operators import views
from ..sources.text import case_list

Loader = Callable[[dict], DataFrame]


def _named(cells: DataFrame, field: str) -> str:
    """The column of a field or of one of its aliases."""
    return g.resolve_fields(cells.columns, [field])[field]


def line_extraction(cases, load: Loader, field: str, x: float, surface_y: float = 0.0, y_max: float | None = None, side: str = "positive") -> DataFrame:
    """label, ord, x_requested, x_sampled, y, distance, value: the profiles of all cases at one station."""
    found = case_list(cases)
    if not found:
        raise ValueError("at least one case")
    out = None
    for k, case in enumerate(found):
        cells = load(case)
        own = g.wall_normal_profile(cells, _named(cells, field), x, case.get("surface_y", surface_y), y_max, side)
        own = own.select(F.lit(case.get("label", f"case {k}")).alias("label"), "ord", "x_requested", "x_sampled", "y", "distance", "value")
        out = own if out is None else out.unionByName(own)
    return out


def streamlines(spark: SparkSession, cases, load: Loader, u: str = "u", v: str = "v", color: str | None = None, mask_key: str | None = None, threshold: float | None = None, mode: str = "below", seeds: list[dict] | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(fields of all cases under their labels, seeds); a case may override every key."""
    found = case_list(cases)
    if not found:
        raise ValueError("at least one case")
    out = None
    for k, case in enumerate(found):
        key = lambda name, default, case=case: case.get(name, default)
        cells = load(case)
        names = {n: _named(cells, f) for n, f in (("u", key("u_key", u)), ("v", key("v_key", v)))}
        own = g.streamline_field(cells, names["u"], names["v"], key("color_key", color), key("mask_key", mask_key), key("mask_threshold", threshold), key("mask_mode", mode))
        own = own.withColumn("label", F.lit(case.get("label", f"case {k}")))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out, views.seed_lines(spark, seeds) if seeds else None


def snapshot_views(cells: DataFrame, field: str, stations=(), y_range: tuple[float, float] | None = None, zoom: str = "Base", stream: bl.FreeStream | None = None) -> dict[str, DataFrame]:
    """Plot-ready tables of one snapshot: the masked field, its zoom window and limits, lines at stations and,
    with a free stream, the boundary layer of each line."""
    marked = "ib_markers" in cells.columns
    shown = fo.solid_masked(field) if marked else F.col(field)
    out = {"field": cells.select("i", "j", "x", "y", shown.alias("value")), "window": fo.zoom_window(cells, zoom), "limits": fo.colour_limits(cells, field)}
    if stations and y_range:
        lines = None
        for x in stations:
            near = g.at_station(cells, "x", "i", x).filter(F.col("y").between(*y_range))
            own = near.select(F.lit(float(x)).alias("station"), F.col("j").alias("ord"), "y", "u", F.col("Temperature").alias("T"), F.col(field).alias("value"))
            lines = own if lines is None else lines.unionByName(own)
        out["lines"] = lines
        if stream is not None:
            out["layers"] = bl.line_analysis(lines, stream, ["station"])
    return out
