"""Image and map: thin-plate splines through a scene's tie points, windows of an area in the image, and the detector from tiles to ids.

A scene's tie points (some hundred) are one small group; its spline is a row of a few thousand numbers, which meets
the scene's points by a join. So one plan serves all scenes.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import catalog, tiles
from .radar import Config
from .raster import finalise

#: Pixels by which a window is wider than the area's corners, and along a blob's axis to the point that its heading is taken to.
PAD, SPAN = 512, 40.0
_SPLINE = "mean array<double>, scale double, nodes array<double>, weights array<double>"


def solve(at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """(mean, scale, nodes, weights) of the thin plates through ``values`` (n, 2) at the places ``at`` (n, 2)."""
    mean, scale = at.mean(axis=0), max(float(at.std()), 1e-9)
    z = (at - mean) / scale
    n = len(z)
    flat = np.column_stack([np.ones(n), z])
    system = np.block([[_kernel(z, z), flat], [flat.T, np.zeros((3, 3))]])
    return mean, scale, z, np.linalg.lstsq(system, np.vstack([values, np.zeros((3, 2))]), rcond=None)[0]


def _kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d2 = ((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2)
    return np.where(d2 > 0, d2 * np.log(np.where(d2 > 0, d2, 1)), 0.0) / 2


def evaluate(spline: tuple, at: np.ndarray) -> np.ndarray:
    mean, scale, z, weights = spline
    a = (at - mean) / scale
    return np.hstack([_kernel(a, z), np.ones((len(a), 1)), a]) @ weights


def splines(ties: DataFrame, inverse: bool = False) -> DataFrame:
    """(scene_id, mean, scale, nodes, weights) from ties (scene_id, row, col, lon, lat): from (row, col) to (lon, lat), or back."""
    shape = f"scene_id {ties.schema['scene_id'].dataType.simpleString()}, {_SPLINE}"

    def one(f: pd.DataFrame) -> pd.DataFrame:
        image, ground = f[["row", "col"]].to_numpy(float), f[["lon", "lat"]].to_numpy(float)
        mean, scale, z, w = solve(ground, image) if inverse else solve(image, ground)
        return pd.DataFrame([(f["scene_id"].iloc[0], mean.tolist(), scale, z.ravel().tolist(), w.ravel().tolist())], columns=["scene_id", "mean", "scale", "nodes", "weights"])

    return ties.select("scene_id", "row", "col", "lon", "lat").groupBy("scene_id").applyInPandas(one, shape)


def located(points: DataFrame, known: DataFrame, row: str = "row", col: str = "col", lon: str = "lon", lat: str = "lat") -> DataFrame:
    """``points`` with (lon, lat) of (row, col) by their scene's spline; null without one."""

    @F.pandas_udf("struct<lon:double,lat:double>")
    def at(scene: pd.Series, r: pd.Series, c: pd.Series, mean: pd.Series, scale: pd.Series, nodes: pd.Series, weights: pd.Series) -> pd.DataFrame:
        out = np.full((len(r), 2), np.nan)
        for _, rows in pd.Series(range(len(scene))).groupby(scene.to_numpy(), sort=False):
            k = rows.to_numpy()
            if mean.iloc[k[0]] is not None:
                spline = np.array(mean.iloc[k[0]]), scale.iloc[k[0]], np.array(nodes.iloc[k[0]]).reshape(-1, 2), np.array(weights.iloc[k[0]]).reshape(-1, 2)
                out[k] = evaluate(spline, np.column_stack([r.to_numpy(float)[k], c.to_numpy(float)[k]]))
        return pd.DataFrame({"lon": out[:, 0], "lat": out[:, 1]})

    met = points.join(known, "scene_id", "left")
    return met.withColumn("at_", at("scene_id", row, col, "mean", "scale", "nodes", "weights")).select(*points.columns, F.nanvl("at_.lon", F.lit(None).cast("double")).alias(lon), F.nanvl("at_.lat", F.lit(None).cast("double")).alias(lat))


def windows(ties: DataFrame, sizes: DataFrame, box: tuple[float, float, float, float], pad: int = PAD) -> DataFrame:
    """(scene_id, row0, row1, col0, col1), the ends not in it: where an area lies in each image of ``sizes`` (scene_id, height, width).

    The area's corners in the image, ``pad`` pixels wider on all sides and cut at the image's edges. Only a bound
    for what has to be read: the area and the image aren't parallel.
    """
    corners = np.array([(x, y) for x in (box[0], box[2]) for y in (box[1], box[3])])

    @F.pandas_udf("array<double>")
    def ends(mean: pd.Series, scale: pd.Series, nodes: pd.Series, weights: pd.Series) -> pd.Series:
        def one(m, s, n, w):
            found = evaluate((np.array(m), s, np.array(n).reshape(-1, 2), np.array(w).reshape(-1, 2)), corners)
            return [math.floor(found[:, 0].min()) - pad, math.ceil(found[:, 0].max()) + pad, math.floor(found[:, 1].min()) - pad, math.ceil(found[:, 1].max()) + pad]

        return pd.Series([one(*x) for x in zip(mean, scale, nodes, weights, strict=True)])

    found = splines(ties, inverse=True).select("scene_id", ends("mean", "scale", "nodes", "weights").alias("e")).join(sizes, "scene_id")
    low = lambda k: F.greatest(F.lit(0), F.col("e")[k].cast("long"))
    high = lambda k, c: F.least(F.col(c).cast("long"), F.col("e")[k].cast("long"))
    return found.select("scene_id", low(0).alias("row0"), high(1, "height").alias("row1"), low(2).alias("col0"), high(3, "width").alias("col1"))


def within(source: DataFrame, spans: DataFrame, side: int = tiles.SIDE) -> DataFrame:
    """The tiles that a scene's window touches."""
    first, last = (lambda c: F.floor(F.col(c) / side)), (lambda c: F.floor((F.col(c) - 1) / side))
    touched = F.col("tile_row").between(first("row0"), last("row1")) & F.col("tile_col").between(first("col0"), last("col1"))
    return source.join(spans, "scene_id").where(touched).select(*source.columns)


def detect_vessels(
    source: DataFrame, ties: DataFrame, sizes: DataFrame, box: tuple[float, float, float, float], spacing_m: float, nesz: float | None = None, land: DataFrame | None = None,
    config: Config = Config(), pad: int = PAD, side: int = tiles.SIDE, runs: DataFrame | None = None, stored: DataFrame | None = None,
) -> DataFrame:
    """Detections with ids of all scenes in the area, from tiles to ``finalise``'s rows, in one plan.

    With ``runs`` (id, scene_id, detector, started_at, parameters: map of numbers) and ``stored`` (run_id and the columns of the
    result), scenes that have a run with this configuration aren't detected again: the newest such run's detections of at least
    ``min_length_m`` are taken as they are. Which ones that are is decided by a join.
    """
    spans = windows(ties, sizes, box, pad)
    reused = None
    if runs is not None and stored is not None:
        reused = catalog.reusable_runs(runs, catalog.parameters(config))
        spans = spans.join(reused.select("scene_id"), "scene_id", "left_anti")
    blobs = tiles.detect(within(source, spans, side), nesz, config, side)
    blobs = blobs.withColumns({"tip_row": F.col("row") + SPAN * F.col("dy"), "tip_col": F.col("col") + SPAN * F.col("dx")})
    known = splines(ties)
    placed = located(located(blobs, known), known, "tip_row", "tip_col", "tip_lon", "tip_lat")
    fresh = finalise(placed, spacing_m, box, land, config=config)
    if reused is None:
        return fresh
    old = catalog.long_enough(stored.join(reused.select(F.col("id").alias("run_id")), "run_id", "left_semi"), config.min_length_m)
    return fresh.unionByName(old.select(*fresh.columns))
