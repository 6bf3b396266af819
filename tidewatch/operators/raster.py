"""Radar rasters: lattices, tie points, display, masks of cells, and the way from blobs to detections.

What works on whole rasters is in ``tiles``; here a raster is (scene_id, row, col, value) with optional valid,
and cells are (scene_id, block_row, block_col, flag).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from .graph import components
from .land import on_land
from .nearby import linked_cells, placed
from .radar import Config, from_db, to_db
from .ranks import quantiles
from .tiles import dilate_cells


def orbital_speed(velocities: DataFrame, *by: str) -> DataFrame:
    """Mean norm of velocity vectors (x, y, z)."""
    return velocities.groupBy(*by).agg(F.avg(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))).alias("speed_ms"))


def interpolate_lattice(points: DataFrame, lattice: np.ndarray, lines: np.ndarray, pixels: np.ndarray, out: str, clamp_pixels: bool = True) -> DataFrame:
    """Bilinear values of a small lattice (lines x pixels) at (row, col).

    Beyond the last line the slope goes on; beyond the last pixel the value stays (``clamp_pixels``)
    or the slope goes on too. The lattice is a product's own, of a few thousand values.
    """

    @F.pandas_udf("double")
    def at(row: pd.Series, col: pd.Series) -> pd.Series:
        r, c = row.to_numpy(float), col.to_numpy(float)
        i = np.clip(np.searchsorted(lines, r, side="right") - 1, 0, len(lines) - 2)
        j = np.clip(np.searchsorted(pixels, c, side="right") - 1, 0, len(pixels) - 2)
        u = (r - lines[i]) / (lines[i + 1] - lines[i])
        v = (c - pixels[j]) / (pixels[j + 1] - pixels[j])
        v = np.clip(v, 0, 1) if clamp_pixels else v
        near = lattice[i, j] * (1 - v) + lattice[i, j + 1] * v
        far = lattice[i + 1, j] * (1 - v) + lattice[i + 1, j + 1] * v
        return pd.Series(near * (1 - u) + far * u)

    return points.withColumn(out, at("row", "col"))


# -- statistics ---------------------------------------------------------------------------------

def _blocked(pixels: DataFrame, block: int) -> DataFrame:
    return pixels.withColumns({"block_row": F.floor(F.col("row") / block), "block_col": F.floor(F.col("col") / block)})


_BLOCK = ["scene_id", "block_row", "block_col"]


def _valid(pixels: DataFrame) -> Column:
    return F.coalesce(F.col("valid"), F.lit(False)) if "valid" in pixels.columns else F.lit(True)


def block_mean(pixels: DataFrame, block: int) -> DataFrame:
    """Mean over valid pixels of each block, 0 without any, and their share of the whole block."""
    ok = _valid(pixels) & F.col("value").isNotNull()
    n = F.count_if(ok)
    return _blocked(pixels, block).groupBy(*_BLOCK).agg(F.coalesce(F.sum(F.when(ok, F.col("value"))) / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("mean"), (n / float(block * block)).alias("fill"))


def medians(df: DataFrame, value: str, *by: str) -> DataFrame:
    return quantiles(df, value, list(by), {"median": 0.5}).drop("n")


def stretch(pixels: DataFrame, *by: str) -> DataFrame:
    """Percentiles of finite values for display."""
    v = F.col("value").cast("double")
    finite = pixels.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return quantiles(finite, "value", list(by), {f"p{str(p).replace('.', '_')}": p / 100 for p in (2.0, 99.5, 99.9)}).drop("n")


# -- masks --------------------------------------------------------------------------------------

def dilate(cells: DataFrame, radius: int, flag: str = "mask", invert: bool = False) -> DataFrame:
    """``radius`` rounds of growth to the four neighbours, within the cells that are there: (scene_id, block_row, block_col, flag)."""
    if radius <= 0:
        return cells
    grown = dilate_cells(cells, radius, flag, invert)
    return grown if sorted(cells.columns) == sorted([*_BLOCK, flag]) else cells.drop(flag).join(grown, _BLOCK)


def erode(cells: DataFrame, radius: int, flag: str = "mask") -> DataFrame:
    """The complement of its complement's growth; cells that aren't there count as set."""
    return dilate(cells, radius, flag, invert=True)


def land_mask(pixels: DataFrame, config: Config = Config()) -> DataFrame:
    """Blocks that are land or fill: bright means, opened so that ships don't count, grown along the coast."""
    means = block_mean(pixels, config.land_block)
    cells = means.select(*_BLOCK, (F.col("mean") > from_db(config.land_sigma0_db)).alias("mask"), (F.col("fill") < 1.0 - config.max_fill_fraction).alias("fill_mask"))
    opened = dilate(erode(cells, config.land_open_blocks), config.land_open_blocks + config.land_dilate_blocks)
    return opened.select(*_BLOCK, (F.col("mask") | F.col("fill_mask")).alias("masked"))


# -- detections ---------------------------------------------------------------------------------

def length_bands(blobs: DataFrame, config: Config = Config()) -> DataFrame:
    """Counters of lengths (length_m) that are too small, too large and kept, by scene."""
    small, large = F.col("length_m") < config.min_length_m, F.col("length_m") > config.max_length_m
    return blobs.groupBy("scene_id").agg(F.count(F.lit(1)).alias("candidates"), F.count_if(small).alias("rejected_small"), F.count_if(large).alias("rejected_large"), F.count_if(~small & ~large).alias("kept"))


def merge_fragments(points: DataFrame, radius_m: float = 200.0) -> DataFrame:
    """Of each single-link group within ``radius_m`` the point with the largest margin (the smallest id among equals), with ``fragments``.

    ``points`` has scene_id, id, lon, lat, margin. Points in one cell whose diagonal is the radius are
    linked as they are; whether places of different cells are linked is found in trees, without their pairs, and what
    is linked are cells. A cell is aggregated first, then the groups of cells. A point without scene or position is a group of its own.
    """
    if radius_m <= 0:
        return points.withColumn("fragments", F.lit(1).cast("long"))
    known = placed("lon", "lat") & F.col("scene_id").isNotNull()
    alone = points.where(~known).withColumn("fragments", F.lit(1).cast("long"))
    boxed = points.where(known).withColumn("_box", F.struct("scene_id", geo.tight_cell(F.col("lon"), F.col("lat"), radius_m).alias("cell")))
    edges = linked_cells(boxed.select("scene_id", "lon", "lat").distinct(), radius_m, "scene_id")
    best = F.min(F.struct((-F.col("margin")).alias("_m"), F.col("id").alias("_i"), F.struct(*points.columns).alias("_row")))
    boxes = boxed.groupBy("_box").agg(best.alias("_best"), F.count(F.lit(1)).alias("_n"))
    group = boxes.join(components(edges), F.col("_box") == F.col("node"), "left").withColumn("_group", F.coalesce("label", "_box"))
    merged = group.groupBy("_group").agg(F.min("_best").alias("_best"), F.sum("_n").alias("fragments")).select("_best._row.*", "fragments")
    return merged.union(alone.select(*merged.columns))


def finalise(blobs: DataFrame, spacing_m: float, box: tuple[float, float, float, float] | None = None, land: DataFrame | None = None, buffer_m: float = 1000.0, config: Config = Config()) -> DataFrame:
    """Detections from measured and located blobs (scene_id, row, col, length_px, width_px, dx, dy, margin, lon, lat, tip_lon, tip_lat).

    Length band, box, land, merging, then ids scene:det_00000 in image order. A heading, known but
    for 180 degrees, only for blobs that are long enough for their axis to mean something.
    """
    rows = blobs.withColumns({"length_m": F.col("length_px") * spacing_m, "width_m": F.col("width_px") * spacing_m}).where(F.col("length_m").between(config.min_length_m, config.max_length_m))
    rows = rows.withColumn("id", F.struct("scene_id", "row", "col"))
    if box is not None:
        rows = rows.where(geo.in_box(F.col("lon"), F.col("lat"), box))
    if land is not None:
        rows = rows.join(on_land(rows.select("id", "lon", "lat"), land, buffer_m).select("id"), "id", "left_anti")
    rows = merge_fragments(rows, config.merge_radius_m)
    long = (F.col("length_m") / spacing_m >= config.min_heading_px) & (F.col("length_m") / F.greatest("width_m", F.lit(spacing_m)) >= config.min_heading_aspect)
    heading = F.pmod(geo.bearing_deg(F.col("lon"), F.col("lat"), F.col("tip_lon"), F.col("tip_lat")), F.lit(180.0))
    number = F.row_number().over(Window.partitionBy("scene_id").orderBy("row", "col")) - 1
    return rows.select(
        F.format_string("%s:det_%05d", "scene_id", number).alias("id"), "scene_id", "lon", "lat", F.bround("length_m", 1).alias("length_m"), F.bround("width_m", 1).alias("width_m"),
        F.when(long, F.bround(heading, 1)).alias("heading_deg"), F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.0), to_db(F.col("margin")) / 10)), 3).alias("confidence"),
        F.col("row").alias("px_row"), F.col("col").alias("px_col"), F.bround(to_db(F.col("margin")), 2).alias("cfar_margin_db"), "fragments",
    )
