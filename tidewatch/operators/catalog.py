"""Scene catalogue: search, ranking, upsert, runs and their reuse."""

from __future__ import annotations

import math
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from . import match
from .ranks import numbered

Box = tuple[float, float, float, float]


def search(scenes: DataFrame, box: Box, start: str, end: str) -> DataFrame:
    """Scenes whose box touches ``box`` (touching counts) in the closed window, by time."""
    hit = geo.boxes_touch(F.col("min_lon"), F.col("min_lat"), F.col("max_lon"), F.col("max_lat"), box)
    when = F.col("acquisition_time").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))
    return scenes.where(when & hit).orderBy("acquisition_time", "scene_id")


def overlap_area(box: Box) -> Column:
    """Square degrees that a scene's box shares with ``box``."""
    w = F.least("max_lon", F.lit(box[2])) - F.greatest("min_lon", F.lit(box[0]))
    h = F.least("max_lat", F.lit(box[3])) - F.greatest("min_lat", F.lit(box[1]))
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def footprint_area(ring: Column, box: Box) -> Column:
    """Square degrees of a convex footprint in ``box``."""
    return geo.ring_area(geo.clip_ring(ring, box))


def ranked(scenes: DataFrame, box: Box, area: Column | None = None) -> DataFrame:
    """Largest coverage of the box first, the newest of equal ones, then by id; ``rank`` from 1."""
    covered = scenes.withColumn("coverage", overlap_area(box) if area is None else area)
    return numbered(covered, [F.desc("coverage"), F.desc("acquisition_time"), F.asc("scene_id")]).withColumn("rank", F.col("rank").cast("int"))


def upsert_scenes(old: DataFrame, new: DataFrame) -> DataFrame:
    """New scenes are added; of known ones only item, granule_path and ingested_at change. The last of new rows with one id counts."""
    latest = new.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc_nulls_last("ingested_at"), F.desc("granule_path")))).where("_n = 1").drop("_n")
    fresh = latest.select("id", *(F.col(c).alias(f"_{c}") for c in ("item", "granule_path", "ingested_at")), F.lit(True).alias("_new"))
    kept = old.join(fresh, "id", "left").withColumns({c: F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)) for c in ("item", "granule_path", "ingested_at")})
    return kept.select(*old.columns).unionByName(latest.join(old.select("id"), "id", "left_anti").select(*old.columns))


def latest_runs(runs: DataFrame, *by: str) -> DataFrame:
    """The newest run of each key, the greater id among equals."""
    order = Window.partitionBy(*by).orderBy(F.desc("started_at"), F.desc("id"))
    return runs.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def same_parameters(stored: dict, wanted: dict) -> bool:
    """All keys equal, numbers within 1e-9; a stored min_length_m may be lower, as its run can be filtered."""
    if stored.keys() != wanted.keys():
        return False
    for key, value in wanted.items():
        own = stored[key]
        if key == "min_length_m" and own is not None and value is not None:
            if float(own) > float(value) + 1e-9:
                return False
        elif isinstance(value, float) or isinstance(own, float):
            if value is None or own is None or not math.isclose(float(own), float(value), rel_tol=0, abs_tol=1e-9):
                return False
        elif own != value:
            return False
    return True


def parameters(config) -> dict[str, float]:
    """A detector's configuration as the numbers that a run keeps."""
    return {k: float(v) for k, v in asdict(config).items()}


def reusable_runs(runs: DataFrame, wanted: dict[str, float]) -> DataFrame:
    """The newest run of each scene that was made with these parameters (``parameters``: map of numbers), by ``same_parameters``' rules."""
    asked = F.create_map(*(x for k, v in wanted.items() for x in (F.lit(k), F.lit(float(v)))))
    near = lambda k, v: F.when(k == "min_length_m", v <= asked[k] + 1e-9).otherwise(F.abs(v - asked[k]) <= 1e-9)
    same = F.forall(F.map_entries("parameters"), lambda e: F.coalesce(near(e["key"], e["value"]), F.lit(False)))
    return latest_runs(runs.where(F.col("parameters").isNotNull() & (F.size("parameters") == len(wanted)) & same), "scene_id")


def replace_run(detections: DataFrame, runs: DataFrame, new_run: DataFrame, new_detections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs and detections with all earlier runs of the same scene, detector and polarization replaced."""
    key = ["scene_id", "detector", "polarization"]
    gone = runs.join(new_run.select(*key), key, "left_semi").select(F.col("id").alias("run_id"))
    kept = detections.join(gone, "run_id", "left_anti")
    return runs.join(new_run.select(*key), key, "left_anti").unionByName(new_run), kept.unionByName(new_detections)


def long_enough(detections: DataFrame, min_length_m: float) -> DataFrame:
    """Detections of a length of at least that; those without a length go."""
    return detections.where(F.col("length_m") >= min_length_m)


def counts(**tables: DataFrame) -> DataFrame:
    parts = [t.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("name"), "rows") for n, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def correlate(positions: DataFrame, scenes: DataFrame, detections: DataFrame, box: Box, start: str, end: str, min_length_m: float = 15.0, radius_m: float = 500.0, window_min: float = 11.0, scene_id=None) -> DataFrame:
    """The best scene of a box and window (or the one named): its detections in the box, matched.

    Without any feed in the scene's window there are no rows: nothing can be said of it. Raises
    ValueError when no scene covers the box.
    """
    found = search(scenes, box, start, end)
    best = (found.where(F.col("scene_id") == scene_id) if scene_id is not None else found.orderBy(F.desc(overlap_area(box)), F.desc("acquisition_time"), "scene_id")).limit(1)
    row = best.select("scene_id").first()
    if row is None:
        raise ValueError("no scene there and then")
    one = scenes.where(F.col("scene_id") == row.scene_id)
    inside = long_enough(detections.where(F.col("scene_id") == row.scene_id), min_length_m).where(geo.in_box(F.col("lon"), F.col("lat"), box))
    feeds = match.feed_in_window(positions, one, int(window_min) * 60)
    return match.match(positions, one, match.scenes_with_feed(inside, feeds), int(window_min) * 60, radius_m)


def preview(ids: DataFrame, id_col: str, most: int = 10) -> DataFrame:
    """The first ids and whether there are more: rows of (id, partial)."""
    some = ids.select(id_col).orderBy(id_col).limit(most + 1)
    partial = some.agg((F.count(F.lit(1)) > most).alias("partial"))
    return some.orderBy(id_col).limit(most).crossJoin(partial)  # one row


def in_callers_order(rows: DataFrame, id_col: str, ids: list) -> DataFrame:
    """Rows of the ids, each once, in the order in which they were asked for."""
    spark = rows.sparkSession
    order = spark.createDataFrame([(x, k) for k, x in enumerate(dict.fromkeys(ids))], f"_id {rows.schema[id_col].dataType.simpleString()}, _k int")
    return rows.join(F.broadcast(order), F.col(id_col) == F.col("_id")).orderBy("_k").drop("_id", "_k")  # as long as the caller's own list


def spread(rows: DataFrame, order: list, n: int, place: str = "place") -> DataFrame:
    """``n`` rows that lie evenly over an order, the first and the last among them, with their number in it from 1; all where there are no more.

    For sheets of examples: the best ones alone say nothing of the marginal ones.
    """
    ranked = numbered(rows, order, place)
    count = F.lit(rows.count())
    picked = F.array(*(F.bround(F.lit(k) * (count - 1) / F.lit(float(max(n - 1, 1)))).cast("long") + 1 for k in range(n)))
    return ranked.where((count <= n) | F.array_contains(picked, F.col(place)))
