"""Domain tables made from the generic test tables by fixed expressions, in Spark and in SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RANGE_BEARING, AZIMUTH_BEARING, INCIDENCE, R_OVER_V = 286.842, 196.842, 38.7, 115.0
WINDOW_S = 43_200


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("mmsi"),
        F.col("ts").cast("timestamp").alias("ts"),
        (55.5 + F.floor(F.col("user_id") / 50) * 0.3 + F.col("value") / 1e5).alias("lat"),
        (10.5 + (F.col("user_id") % 50) * 0.04 + F.col("value") / 1e5).alias("lon"),
        F.when(F.col("event_type") != "error", F.col("value") / 50).alias("sog_ms"),
        F.when(F.col("event_type") != "signup", (F.col("event_id") % 360).cast("double")).alias("cog_deg"),
        F.when(F.col("user_id") % 10 == 0, "live").otherwise("archive").alias("source"),
        (F.col("user_id") % 10 != 0).alias("is_ground_truth"),
    )


def scenes(spark: SparkSession) -> DataFrame:
    day = F.timestamp_seconds(F.lit(1_704_110_400) + F.col("id") * 86_400)  # 2024-01-01 12:00 UTC and on
    return spark.range(30).select(
        F.col("id").alias("scene_id"), day.alias("acquisition_time"), F.lit(RANGE_BEARING).alias("range_bearing_deg"), F.lit(AZIMUTH_BEARING).alias("azimuth_bearing_deg")
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    home, off = F.col("o_custkey") % 150, F.col("o_totalprice") / 1e8
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("detection_id"),
        (F.col("o_orderkey") % 30).alias("scene_id"),
        (55.5 + F.floor(home / 50) * 0.3 + off).alias("lat"),
        (10.5 + (home % 50) * 0.04 + off).alias("lon"),
        F.lit(INCIDENCE).alias("incidence_deg"),
        F.lit(R_OVER_V).alias("r_over_v_s"),
        (10 + F.col("o_totalprice") / 1000).alias("length_m"),
    )


def footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangular scene footprints from customers."""
    k = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(
        k.alias("scene_id"),
        (9.0 + (k % 40) * 0.1).alias("min_lon"), (54.0 + (k % 25) * 0.1).alias("min_lat"),
        (9.0 + (k % 40) * 0.1 + 0.5 + (k % 7) * 0.2).alias("max_lon"), (54.0 + (k % 25) * 0.1 + 0.4 + (k % 5) * 0.2).alias("max_lat"),
        F.timestamp_seconds(F.lit(1_704_067_200) + (k % 300) * 3600).alias("acquisition_time"),
    )


SQL_POSITIONS = """
positions AS (
  SELECT CAST(user_id AS VARCHAR) AS mmsi, ts, CAST(epoch_us(ts) AS BIGINT) AS us,
    55.5 + floor(user_id / 50) * 0.3 + value / 1e5 AS lat, 10.5 + (user_id % 50) * 0.04 + value / 1e5 AS lon,
    CASE WHEN event_type <> 'error' THEN value / 50 END AS sog_ms,
    CASE WHEN event_type <> 'signup' THEN CAST(event_id % 360 AS DOUBLE) END AS cog_deg,
    CASE WHEN user_id % 10 = 0 THEN 'live' ELSE 'archive' END AS source, user_id % 10 <> 0 AS is_ground_truth
  FROM events)"""
SQL_SCENES = """
scenes AS (
  SELECT CAST(id AS BIGINT) AS scene_id, 1704110400000000 + id * 86400000000 AS at_us,
    286.842::DOUBLE AS range_bearing_deg, 196.842::DOUBLE AS azimuth_bearing_deg
  FROM range(30) r(id))"""
SQL_DETECTIONS = """
detections AS (
  SELECT o_orderkey AS detection_id, o_orderkey % 30 AS scene_id,
    55.5 + floor((o_custkey % 150) / 50) * 0.3 + o_totalprice / 1e8 AS lat,
    10.5 + ((o_custkey % 150) % 50) * 0.04 + o_totalprice / 1e8 AS lon,
    38.7::DOUBLE AS incidence_deg, 115.0::DOUBLE AS r_over_v_s, 10 + o_totalprice / 1000 AS length_m
  FROM orders)"""
SQL_FOOTPRINTS = """
footprints AS (
  SELECT c_custkey AS scene_id, 9.0::DOUBLE + (c_custkey % 40) * 0.1::DOUBLE AS min_lon, 54.0::DOUBLE + (c_custkey % 25) * 0.1::DOUBLE AS min_lat,
    9.0::DOUBLE + (c_custkey % 40) * 0.1::DOUBLE + 0.5::DOUBLE + (c_custkey % 7) * 0.2::DOUBLE AS max_lon,
    54.0::DOUBLE + (c_custkey % 25) * 0.1::DOUBLE + 0.4::DOUBLE + (c_custkey % 5) * 0.2::DOUBLE AS max_lat,
    1704067200 + (c_custkey % 300) * 3600 AS at_s
  FROM customer)"""


def sql_haversine(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    a = f"pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)"
    return f"(asin(sqrt(least(1.0, greatest(0.0, {a})))) * 12742017.6)"


SQL_TRUTH = f"""
{SQL_POSITIONS.strip()},
{SQL_SCENES.strip()},
bracket AS (
  SELECT s.scene_id, p.mmsi, p.us, p.lat, p.lon, p.sog_ms, p.cog_deg, p.is_ground_truth, s.range_bearing_deg, s.azimuth_bearing_deg,
    (p.us - s.at_us) / 1e6 AS dt, lead(p.lat) OVER w AS next_lat, lead(p.lon) OVER w AS next_lon,
    lead(p.sog_ms) OVER w AS next_sog, lead(p.cog_deg) OVER w AS next_cog, (lead(p.us) OVER w - s.at_us) / 1e6 AS next_dt
  FROM positions p JOIN scenes s ON abs(p.us - s.at_us) <= {WINDOW_S}000000
  WINDOW w AS (PARTITION BY s.scene_id, p.mmsi ORDER BY p.us, p.lat, p.lon)),
straddling AS (
  SELECT *, (0 - dt) / nullif(next_dt - dt, 0) AS f FROM bracket WHERE dt <= 0 AND next_dt >= 0),
truth AS (
  SELECT scene_id, mmsi, is_ground_truth, range_bearing_deg, azimuth_bearing_deg, f, lat + f * (next_lat - lat) AS lat, lon + f * (next_lon - lon) AS lon,
    coalesce(sog_ms, next_sog, 0) AS sog_ms, coalesce(cog_deg, next_cog) AS cog_deg, least(abs(dt), abs(next_dt)) AS report_gap_s
  FROM straddling WHERE f IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY scene_id, mmsi ORDER BY us, lat, lon) = 1)"""


def sql_pairs(correct: bool = True, radius: float = 500.0) -> str:
    """CTEs ``shifted`` and ``pairs`` (within the radius) on top of the above, by comparing all of a scene."""
    shift = "CASE WHEN t.cog_deg IS NOT NULL THEN -d.r_over_v_s * t.sog_ms * cos(radians(t.cog_deg - t.range_bearing_deg)) * sin(radians(d.incidence_deg)) ELSE 0.0 END" if correct else "0.0::DOUBLE"
    near = sql_haversine("d.lon", "d.lat", "t.lon", "t.lat")
    p2 = "asin(least(1.0, greatest(-1.0, sin(radians(t_lat)) * cos(shift / 6371008.8) + cos(radians(t_lat)) * sin(shift / 6371008.8) * cos(radians(ab)))))"
    return f"""
{SQL_DETECTIONS.strip()},
shifted AS (
  SELECT d.detection_id, d.scene_id, d.lon, d.lat, t.mmsi, t.lon AS t_lon, t.lat AS t_lat, t.is_ground_truth, t.report_gap_s, t.sog_ms,
    t.azimuth_bearing_deg AS ab, {shift} AS shift, {near} AS d0
  FROM detections d JOIN truth t USING (scene_id) WHERE {near} <= {radius + 2000}),
moved AS (
  SELECT *, degrees({p2}) AS a_lat, ((degrees(radians(t_lon) + atan2(sin(radians(ab)) * sin(shift / 6371008.8) * cos(radians(t_lat)),
    cos(shift / 6371008.8) - sin(radians(t_lat)) * sin({p2}))) + 540.0) % 360.0) - 180.0 AS a_lon FROM shifted),
pairs AS (
  SELECT * FROM (SELECT *, {sql_haversine("lon", "lat", "a_lon", "a_lat")} AS d1 FROM moved) WHERE d1 <= {radius}),
best AS (
  SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY detection_id ORDER BY d1, mmsi) = 1)"""


_A, _F = "6378137.0::DOUBLE", "(1 / 298.257223563::DOUBLE)"
_B = f"({_A} * (1 - {_F}))"
_E2 = f"(({_A} * {_A} - {_B} * {_B}) / ({_B} * {_B}))"


def _sql_series(cos2: str) -> tuple[str, str]:
    u = f"({cos2} * {_E2})"
    return f"(1 + {u} / 16384 * (4096 + {u} * (-768 + {u} * (320 - 175 * {u}))))", f"({u} / 1024 * (256 + {u} * (-128 + {u} * (74 - 47 * {u}))))"


def _sql_correction(b: str, sin_s: str, cos_s: str, mid: str) -> str:
    return f"({b} * {sin_s} * ({mid} + {b} / 4 * ({cos_s} * (-1 + 2 * {mid} * {mid}) - {b} / 6 * {mid} * (-3 + 4 * {sin_s} * {sin_s}) * (-3 + 4 * {mid} * {mid}))))"


def sql_geodesic(source: str, out: str, column: str, lon1: str, lat1: str, lon2: str, lat2: str, times: int = 10) -> str:
    """CTEs that add ``column``, the length of the geodesic, to the rows of ``source``, as the CTE ``out``; one CTE for each iteration."""
    arc = """sqrt(pow(_c2 * sin(_l), 2) + pow(_c1 * _s2 - _s1 * _c2 * cos(_l), 2)) AS _ss, _s1 * _s2 + _c1 * _c2 * cos(_l) AS _cs, atan2(_ss, _cs) AS _sg, coalesce(_c1 * _c2 * sin(_l) / nullif(_ss, 0), 0) AS _sa, 1 - _sa * _sa AS _k, coalesce(_cs - 2 * _s1 * _s2 / nullif(_k, 0), 0) AS _m"""
    c = f"({_F} / 16 * _k * (4 + {_F} * (4 - 3 * _k)))"
    own = "_u1, _u2, _s1, _c1, _s2, _c2, _ll, _l, _moved"
    ctes = [f"{out}_0 AS (SELECT *, atan((1 - {_F}) * tan(radians({lat1}))) AS _u1, atan((1 - {_F}) * tan(radians({lat2}))) AS _u2, sin(_u1) AS _s1, cos(_u1) AS _c1, sin(_u2) AS _s2, cos(_u2) AS _c2, radians((({lon2}) - ({lon1}) + 900) % 360 - 180) AS _ll, _ll AS _l, 1.0::DOUBLE AS _moved FROM {source})"]
    for k in range(times):
        ctes.append(f"{out}_{k + 1} AS (SELECT * EXCLUDE (_l, _moved, _n, _ss, _cs, _sg, _sa, _k, _m), _n AS _l, abs(_n - _l) AS _moved FROM (SELECT *, {arc}, _ll + (1 - {c}) * {_F} * _sa * (_sg + {c} * _ss * (_m + {c} * _cs * (-1 + 2 * _m * _m))) AS _n FROM {out}_{k}))")
    big, small = _sql_series("_k")
    ctes.append(f"{out} AS (SELECT * EXCLUDE ({own}, _ss, _cs, _sg, _sa, _k, _m), CASE WHEN _moved <= 1e-11 AND abs(_l) <= pi() THEN {_B} * {big} * (_sg - {_sql_correction(small, '_ss', '_cs', '_m')}) ELSE {sql_haversine(lon1, lat1, lon2, lat2)} END AS {column} FROM (SELECT *, {arc} FROM {out}_{times}))")
    return ", ".join(ctes)


def sql_destination(source: str, out: str, lon: str, lat: str, metres: str, bearing: str, out_lon: str, out_lat: str, times: int = 10) -> str:
    """CTEs that add the end of a geodesic to the rows of ``source``, as the CTE ``out``."""
    big, small = _sql_series("_k")
    ctes = [f"{out}_0 AS (SELECT *, (1 - {_F}) * tan(radians({lat})) AS _t, 1 / sqrt(1 + _t * _t) AS _cu, _t * _cu AS _su, radians({bearing}) AS _az, atan2(_t, cos(_az)) AS _s1, _cu * sin(_az) AS _sa, 1 - _sa * _sa AS _k, ({metres}) / ({_B} * {big}) AS _w, {small} AS _b, _w AS _s FROM {source})"]
    for k in range(times):
        ctes.append(f"{out}_{k + 1} AS (SELECT * REPLACE (_w + {_sql_correction('_b', 'sin(_s)', 'cos(_s)', 'cos(2 * _s1 + _s)')} AS _s) FROM {out}_{k})")
    c = f"({_F} / 16 * _k * (4 + {_F} * (4 - 3 * _k)))"
    lam = "atan2(sin(_s) * sin(_az), _cu * cos(_s) - _su * sin(_s) * cos(_az))"
    mid = "cos(2 * _s1 + _s)"
    ctes.append(f"""{out} AS (SELECT * EXCLUDE (_t, _cu, _su, _az, _s1, _sa, _k, _w, _b, _s), (({lon}) + degrees({lam} - (1 - {c}) * {_F} * _sa * (_s + {c} * sin(_s) * ({mid} + {c} * cos(_s) * (-1 + 2 * {mid} * {mid})))) + 900) % 360 - 180 AS {out_lon},
      degrees(atan2(_su * cos(_s) + _cu * sin(_s) * cos(_az), (1 - {_F}) * sqrt(_sa * _sa + pow(_su * sin(_s) - _cu * cos(_s) * cos(_az), 2)))) AS {out_lat} FROM {out}_{times})""")
    return ", ".join(ctes)


def sql_pairs_ellipsoid(radius: float = 500.0) -> str:
    """As ``sql_pairs``, with distances and ends on the ellipsoid."""
    shift = "CASE WHEN t.cog_deg IS NOT NULL THEN -d.r_over_v_s * t.sog_ms * cos(radians(t.cog_deg - t.range_bearing_deg)) * sin(radians(d.incidence_deg)) ELSE 0.0 END"
    near = sql_haversine("d.lon", "d.lat", "t.lon", "t.lat")
    return f"""
{SQL_DETECTIONS.strip()},
close AS MATERIALIZED (
  SELECT d.detection_id, d.scene_id, d.lon, d.lat, t.mmsi, t.lon AS t_lon, t.lat AS t_lat, t.is_ground_truth, t.report_gap_s, t.sog_ms, t.azimuth_bearing_deg AS ab, {shift} AS shift
  FROM detections d JOIN truth t USING (scene_id) WHERE {near} <= {1.006 * (radius + 2000)}),
{sql_geodesic("close", "g", "d0", "lon", "lat", "t_lon", "t_lat")},
shifted AS MATERIALIZED (SELECT * FROM g WHERE d0 <= {radius + 2000}),
{sql_destination("shifted", "moved", "t_lon", "t_lat", "shift", "ab", "a_lon", "a_lat")},
{sql_geodesic("moved", "h", "d1", "lon", "lat", "a_lon", "a_lat")},
best AS (
  SELECT * FROM h WHERE d1 <= {radius} QUALIFY row_number() OVER (PARTITION BY detection_id ORDER BY d1, mmsi) = 1)"""
