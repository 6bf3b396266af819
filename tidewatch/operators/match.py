"""The space-time match: which detection belongs to which reporting vessel.

bracket: reports around each scene's instant, each with its successor on the track.
truth: the position at the instant, interpolated between the two reports that straddle it.
match: truth shifted to where the radar draws it, nearest within a radius; every detection stays.

Ties that the definition leaves open are settled by (ts, lat, lon) on a track and by (distance,
mmsi) among candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, spheroid

RADIUS_M, PREFILTER_M = 500.0, 2000.0


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def time_range_join(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, window_s: float) -> DataFrame:
    """Pairs with |left_ts - right_ts| <= window, by equality of time bins as long as the window."""
    width = max(1, int(window_s * 1_000_000))
    a = left.withColumn("_bin", F.floor(_micros(F.col(left_ts)) / width))
    own = F.floor(_micros(F.col(right_ts)) / width)
    b = right.withColumn("_bin2", F.explode(F.array(own - 1, own, own + 1)))
    near = F.abs(_micros(a[left_ts]) - _micros(b[right_ts])) <= window_s * 1_000_000
    return a.join(b, (F.col("_bin") == F.col("_bin2")) & near).drop("_bin", "_bin2")


def bracket(positions: DataFrame, scenes: DataFrame, window_s: float) -> DataFrame:
    """Reports within the closed window around each scene's acquisition_time, with dt and the next report's values.

    ``scenes`` has scene_id and acquisition_time and whatever else is to be carried. A null time
    is in no window. A report at the instant itself counts once as the earlier one.
    """
    inside = time_range_join(positions.withColumnRenamed("ts", "report_ts"), scenes, "report_ts", "acquisition_time", window_s)
    track = Window.partitionBy("scene_id", "mmsi").orderBy("report_ts", "lat", "lon")
    dt = (_micros(F.col("report_ts")) - _micros(F.col("acquisition_time"))) / 1e6
    out = inside.withColumn("dt", dt)
    for name in ("lat", "lon", "sog_ms", "cog_deg", "dt"):
        out = out.withColumn(f"next_{name}", F.lead(name).over(track))
    return out


def truth(bracketed: DataFrame) -> DataFrame:
    """One row per scene and vessel with reports on both sides: where it was at the instant. Never extrapolated."""
    straddles = (F.col("dt") <= 0) & (F.col("next_dt") >= 0)
    f = (0 - F.col("dt")) / F.nullif(F.col("next_dt") - F.col("dt"), F.lit(0.0))
    out = bracketed.where(straddles).withColumns(
        {
            "f": f,
            "true_lat": F.col("lat") + f * (F.col("next_lat") - F.col("lat")),
            "true_lon": F.col("lon") + f * (F.col("next_lon") - F.col("lon")),
            "true_sog": F.coalesce("sog_ms", "next_sog_ms", F.lit(0.0)),
            "true_cog": F.coalesce("cog_deg", "next_cog_deg"),
            "report_gap_s": F.least(F.abs("dt"), F.abs("next_dt")),
        }
    )
    # a report at the very instant straddles with both neighbours; the first of the rows stays
    first = Window.partitionBy("scene_id", "mmsi").orderBy("report_ts", "lat", "lon")
    out = out.where(F.col("true_lat").isNotNull()).withColumn("_n", F.row_number().over(first)).where("_n = 1")
    dropped = ["lat", "lon", "sog_ms", "cog_deg", "dt", "report_ts", "_n", *(f"next_{n}" for n in ("lat", "lon", "sog_ms", "cog_deg", "dt"))]
    return out.drop(*dropped).withColumnsRenamed({"true_lat": "lat", "true_lon": "lon", "true_sog": "sog_ms", "true_cog": "cog_deg"})


#: distance, destination, and how much wider cells have to be than on the sphere they are laid out on.
METRICS = {"sphere": (geo.haversine_m, geo.destination, 1.0), "ellipsoid": (spheroid.distance_m, spheroid.destination, 1.006)}


def spatial_range_join(left: DataFrame, right: DataFrame, reach_m: float, keys: list[str], metric: str = "sphere") -> DataFrame:
    """Pairs of equal keys with at most ``reach_m`` between (lon, lat) of ``left`` and (t_lon, t_lat) of ``right``.

    By equality of grid cells: a point of ``right`` is sent to the cells around it, one of ``left``
    to its own, so that a pair meets once; then the exact distance. The side that was sent around has nine rows
    for one, of which the size that a join is planned by knows nothing: it is sorted, never broadcast.
    """
    measure, _, wider = METRICS[metric]
    a = left.withColumn("_cell", geo.cell(F.col("lon"), F.col("lat"), reach_m * wider))
    b = right.withColumn("_cell", F.explode(geo.cells_around(F.col("t_lon"), F.col("t_lat"), reach_m * wider)))
    ends = F.col("lon"), F.col("lat"), F.col("t_lon"), F.col("t_lat")
    near = measure(*ends) <= reach_m
    # the cheap distance first, where the other one is dear
    return a.join(b.hint("merge"), [*keys, "_cell"]).where(near if metric == "sphere" else (geo.haversine_m(*ends) <= reach_m * wider) & near).drop("_cell")


def candidates(detections: DataFrame, vessels: DataFrame, radius_m: float = RADIUS_M, correct: bool = True, prefilter_m: float = PREFILTER_M, metric: str = "sphere") -> DataFrame:
    """All pairs within the radius after the shift, with both distances, on the sphere or the ellipsoid.

    The true position must lie within radius + prefilter, which limits the shift that can be
    recovered. The shift takes the detection's own incidence_deg and r_over_v_s.
    """
    there = vessels.withColumnsRenamed({"lat": "t_lat", "lon": "t_lon"})
    measure, project, _ = METRICS[metric]
    pairs = spatial_range_join(detections, there, radius_m + prefilter_m, ["scene_id"], metric)
    shift = geo.azimuth_shift_m(F.col("sog_ms"), F.col("cog_deg"), F.col("range_bearing_deg"), F.col("incidence_deg"), F.col("r_over_v_s")) if correct else F.lit(0.0)
    pairs = pairs.withColumn("azimuth_shift_m", shift)
    a_lon, a_lat = project(F.col("t_lon"), F.col("t_lat"), F.col("azimuth_shift_m"), F.col("azimuth_bearing_deg"))
    pairs = pairs.withColumns({"apparent_lon": a_lon, "apparent_lat": a_lat})
    pairs = pairs.withColumn("distance_m", measure(F.col("lon"), F.col("lat"), F.col("apparent_lon"), F.col("apparent_lat")))
    return pairs.where(F.col("distance_m") <= radius_m).withColumn("distance_uncorrected_m", measure(F.col("lon"), F.col("lat"), F.col("t_lon"), F.col("t_lat")))


def nearest(pairs: DataFrame, k: int = 1) -> DataFrame:
    """The k nearest candidates of each detection, ``rank`` from 1."""
    by = Window.partitionBy("detection_id").orderBy("distance_m", "mmsi")
    return pairs.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def match(positions: DataFrame, scenes: DataFrame, detections: DataFrame, window_s: float, radius_m: float = RADIUS_M, correct: bool = True, metric: str = "sphere") -> DataFrame:
    """Every detection once, with its vessel or as ``dark``. A vessel may match several detections."""
    vessels = truth(bracket(positions, scenes, window_s))
    picked = ["mmsi", "distance_m", "distance_uncorrected_m", "azimuth_shift_m", "sog_ms", F.col("report_gap_s").alias("time_delta_s"), "is_ground_truth"]
    best = nearest(candidates(detections, vessels, radius_m, correct, metric=metric)).select("detection_id", *picked)
    out = detections.join(best, "detection_id", "left")
    return out.withColumn("source_is_ground_truth", F.coalesce("is_ground_truth", F.lit(False))).withColumn("status", F.when(F.col("mmsi").isNull(), "dark").otherwise("matched")).drop("is_ground_truth")


def in_order(matches: DataFrame) -> DataFrame:
    """Matched before dark, nearest first, then by id."""
    return matches.orderBy(F.desc("status"), F.asc_nulls_last("distance_m"), "detection_id")


def summary(matches: DataFrame, *by: str) -> DataFrame:
    """Counts by status, the unmatched share as text, how many the correction brought nearer, whether the rate may be quoted."""
    dark = F.count_if(F.col("status") == "dark")
    total = F.count(F.lit(1))
    grouped = matches.groupBy(*by) if by else matches.groupBy()
    return grouped.agg(
        total.alias("detections"),
        F.count_if(F.col("status") == "matched").alias("matched"),
        dark.alias("dark"),
        F.when(total > 0, F.format_string("%.1f%%", F.round(100.0 * dark / F.nullif(total, F.lit(0)), 1))).otherwise("n/a").alias("unmatched_fraction"),
        F.count_if(F.col("distance_m") < F.col("distance_uncorrected_m") - 0.001).alias("improved"),  # by over a millimetre
        F.coalesce(F.bool_and(F.when(F.col("status") == "matched", F.col("source_is_ground_truth"))), F.lit(False)).alias("quotable"),
    )


def feed_in_window(positions: DataFrame, scenes: DataFrame, window_s: float) -> DataFrame:
    """Per scene and source: reports in its window and whether all are ground truth. A scene without reports has no row, and no match may be made for it."""
    inside = time_range_join(positions, scenes.select("scene_id", "acquisition_time"), "ts", "acquisition_time", window_s)
    return inside.groupBy("scene_id", "source").agg(F.count(F.lit(1)).alias("positions"), F.bool_and("is_ground_truth").alias("ground_truth"))


def feed_combined(feeds: DataFrame) -> DataFrame:
    """Per scene: names joined, reports summed, ground truth only if all of it is."""
    return feeds.groupBy("scene_id").agg(
        F.array_join(F.array_sort(F.collect_set("source")), ", ").alias("sources"), F.sum("positions").alias("positions"), F.bool_and("ground_truth").alias("ground_truth")
    )


def scenes_with_feed(detections: DataFrame, feeds: DataFrame) -> DataFrame:
    """Detections of scenes that have a feed; of the others nothing is said, dark least of all."""
    return detections.join(feeds.select("scene_id").distinct(), "scene_id", "left_semi")
