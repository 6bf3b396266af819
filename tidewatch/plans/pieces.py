"""Queries that run single operators of calibration, masks, catalogue and reports, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog, evaluate, radar, raster, report
from ..sources import ais
from . import derived as d
from .derived import SQL_DETECTIONS, SQL_FOOTPRINTS, SQL_POSITIONS, read, sql_haversine
from .rasters import _BOX, _NO_TIE, _PX, _pixels

#: A lattice of 3 lines and 4 pixels, as a product's annotation has them.
_LINES, _COLS = (0.0, 100.0, 250.0), (0.0, 120.0, 260.0, 400.0)


def _lattice(i: int, j: int) -> float:
    return 17.0 * i + 3.0 * j * j + i * j


def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backscatter, its decibels and the slant range of every line item; no gain, no backscatter."""
    value = radar.sigma0(F.col("l_quantity"), F.col("l_discount"), F.round(F.col("l_tax") * 100))
    range_m = radar.slant_range_m(F.col("l_extendedprice") / 1e9)
    # a null is no value: greatest() would read it as the floor
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(value, 9).alias("sigma0"), F.when(value.isNotNull(), F.round(radar.to_db(value), 6)).alias("db"), F.round(range_m, 3).alias("range_m"))


def lattice_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 300).cast("double").alias("row"), (F.col("o_custkey") % 450).cast("double").alias("col"))
    lattice = np.array([[_lattice(i, j) for j in range(len(_COLS))] for i in range(len(_LINES))])
    return raster.interpolate_lattice(points, lattice, np.array(_LINES), np.array(_COLS), "v").select("o_orderkey", F.round(F.col("v") + 1e-9, 6).alias("v"))


def land_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bright blocks opened and grown, and blocks with too little in them."""
    config = radar.Config(land_block=8, land_sigma0_db=47.6, land_open_blocks=1, land_dilate_blocks=1, max_fill_fraction=0.98)
    return raster.land_mask(_pixels(spark, sf_dir), config)


def stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = raster.stretch(_pixels(spark, sf_dir), "scene_id")
    return out.select("scene_id", *(F.round(F.col(c) + _NO_TIE, 3).alias(c) for c in ("p2_0", "p99_5", "p99_9")))


def medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.medians(d.positions(spark, sf_dir), "sog_ms", "mmsi").select("mmsi", F.round(F.col("median") + 1e-9, 6).alias("median"))


def orbital_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "supplier").select("s_nationkey", F.col("s_acctbal").alias("x"), F.col("s_suppkey").cast("double").alias("y"), F.lit(7.5).alias("z"))
    return raster.orbital_speed(rows, "s_nationkey").select("s_nationkey", F.round("speed_ms", 5).alias("speed_ms"))


def _items(spark: SparkSession, sf_dir: str, every: int, version: int) -> DataFrame:
    k = F.col("c_custkey")
    text = lambda kind: F.format_string(f"{kind}-%d-{version}", k)
    return read(spark, sf_dir, "customer").where(k % every == 0).select(k.alias("id"), text("name").alias("name"), text("item").alias("item"), text("path").alias("granule_path"), F.lit(version).alias("ingested_at"))


def scene_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second scene is known; every third comes anew, every sixth of these twice."""
    return catalog.upsert_scenes(_items(spark, sf_dir, 2, 1), _items(spark, sf_dir, 3, 2).union(_items(spark, sf_dir, 6, 3)))


def run_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections after new runs of some scenes have replaced the earlier ones."""
    runs = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("scene_id"), F.col("o_orderpriority").alias("detector"), F.col("o_orderstatus").alias("polarization"))
    found = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").cast("long").alias("n"))
    newer = read(spark, sf_dir, "customer").where("c_custkey % 7 = 0").select((-F.col("c_custkey")).alias("id"), F.col("c_custkey").alias("scene_id"), F.lit("1-URGENT").alias("detector"), F.lit("O").alias("polarization"))
    return catalog.replace_run(found, runs, newer, newer.select(F.col("id").alias("run_id"), F.lit(1).cast("long").alias("n")))[1].select("run_id", "n")


def isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth detection of a scene is agreed on; metres to it from the others, within 2 km."""
    ours = d.detections(spark, sf_dir).select(F.col("detection_id").alias("id"), "scene_id", "lon", "lat")
    return evaluate.isolation(ours, ours.where("id div 30 % 5 = 0"), 2000.0).select("id", F.round("to_agreed_m", 3).alias("to_agreed_m"))


def isolation_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As isolation, however far, with a few agreed ones only; scenes of the last ten have none."""
    ours = d.detections(spark, sf_dir).select(F.col("detection_id").alias("id"), "scene_id", "lon", "lat")
    return evaluate.isolation(ours, ours.where("id div 30 % 40 = 3 AND scene_id < 20")).select("id", F.round("to_agreed_m", 3).alias("to_agreed_m"))


def best_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    tried = d.detections(spark, sf_dir).select("scene_id", F.expr("1 - 2 * (detection_id div 30 % 2)").alias("sign"), (F.col("length_m") * 3).alias("away"))
    return evaluate.best_variant(tried, "sign", "away", "scene_id")


def fullest_granule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.fullest(d.detections(spark, sf_dir).select(F.col("scene_id").alias("granule_id")))


def footprint_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a box cuts out of rectangular footprints."""
    corner = lambda x, y: F.struct(F.col(x).alias("lon"), F.col(y).alias("lat"))
    ring = F.array(corner("min_lon", "min_lat"), corner("max_lon", "min_lat"), corner("max_lon", "max_lat"), corner("min_lon", "max_lat"))
    return d.footprints(spark, sf_dir).select("scene_id", F.round(catalog.footprint_area(ring, _BOX), 6).alias("area"))


def search_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window for each order: by date, by a date that is none, or by hours back, some of them out of range."""
    k, now = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    on_date = F.when(k % 3 == 0, F.date_format(now, "yyyy-MM-dd")).when(k % 3 == 1, F.when(k % 2 == 0, "soon").otherwise(""))
    start, end, fault = ais.search_window(on_date, F.col("o_custkey") * 37 % 12_000 - 1_000, now)
    return read(spark, sf_dir, "orders").select("o_orderkey", F.unix_micros(start).alias("start_us"), F.unix_micros(end).alias("end_us"), fault.alias("fault"))


def long_enough(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.long_enough(d.detections(spark, sf_dir), 250.0).select("detection_id")


def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.preview(d.detections(spark, sf_dir), "detection_id")


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.expr("detection_id div 30")  # the ids of a scene have one remainder by 30
    return d.detections(spark, sf_dir).withColumns({"status": F.when(k % 3 == 0, "dark").otherwise("matched"), "mmsi": F.when(k % 3 > 0, (k % 40).cast("string"))})


def top_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.leads(_judged(spark, sf_dir)).select("detection_id")


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.findings(_judged(spark, sf_dir), "scene_id")


def rate_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a rate may be quoted, from all positions as matches; the reasons are counted."""
    rows = d.positions(spark, sf_dir).withColumnRenamed("is_ground_truth", "source_is_ground_truth")
    return report.rate_verdict(rows).select("quotable", F.size("reasons").alias("reasons"), F.get("reasons", F.lit(0)).contains("archive, live").alias("names_feeds"))


QUERIES = {f.__name__: f for f in (calibration, lattice_values, land_blocks, stretch, medians, orbital_speed, scene_upsert, run_replacement, isolation, isolation_any, best_variant, fullest_granule, footprint_cut, search_windows, long_enough, preview, top_leads, findings, rate_verdict)}


def _sql_lattice() -> str:
    """Bilinear interpolation cell by cell: the last line's slope goes on, the last pixel's value stays."""
    cases = []
    for i in range(len(_LINES) - 1):
        for j in range(len(_COLS) - 1):
            within = ([f"r < {_LINES[i + 1]}"] if i < len(_LINES) - 2 else []) + ([f"c < {_COLS[j + 1]}"] if j < len(_COLS) - 2 else [])
            u = f"((r - {_LINES[i]}) / {_LINES[i + 1] - _LINES[i]})"
            v = f"least((c - {_COLS[j]}) / {_COLS[j + 1] - _COLS[j]}, 1)"
            a, b, e, f = _lattice(i, j), _lattice(i, j + 1), _lattice(i + 1, j), _lattice(i + 1, j + 1)
            value = f"({a} * (1 - {v}) + {b} * {v}) * (1 - {u}) + ({e} * (1 - {v}) + {f} * {v}) * {u}"
            cases.append(f"WHEN {' AND '.join(within) or 'TRUE'} THEN {value}")
    return "CASE " + " ".join(cases) + " END"


_JUDGED = f"WITH {SQL_DETECTIONS}, j AS (SELECT *, detection_id // 30 % 3 = 0 AS dark, CASE WHEN detection_id // 30 % 3 > 0 THEN detection_id // 30 % 40 END AS mmsi FROM detections)"
SQL = {
    "calibration": """SELECT l_orderkey, l_linenumber, round(s, 9) AS sigma0, CASE WHEN s IS NOT NULL THEN round(10 * log10(greatest(s, 1e-12::DOUBLE)), 6) END AS db, round(range_m, 3) AS range_m FROM (
        SELECT *, (l_quantity * l_quantity - l_discount) / nullif(round(l_tax * 100) * round(l_tax * 100), 0) AS s, l_extendedprice / 1e9::DOUBLE * 299792458.0::DOUBLE / 2 AS range_m FROM lineitem)""",
    "lattice_values": f"SELECT o_orderkey, round({_sql_lattice()} + 1e-9::DOUBLE, 6) AS v FROM (SELECT o_orderkey, (o_orderkey % 300)::DOUBLE AS r, (o_custkey % 450)::DOUBLE AS c FROM orders)",
    "land_blocks": f"""WITH {_PX}, c AS (SELECT scene_id, CAST(row // 8 AS BIGINT) AS block_row, CAST(col // 8 AS BIGINT) AS block_col, coalesce(avg(value) FILTER (WHERE valid), 0) > pow(10, 4.76::DOUBLE) AS m,
          count(*) FILTER (WHERE valid) / 64.0::DOUBLE < 0.02 AS empty FROM px GROUP BY ALL),
        e AS (SELECT c.*, NOT EXISTS (SELECT 1 FROM c o WHERE NOT o.m AND o.scene_id = c.scene_id AND abs(o.block_row - c.block_row) + abs(o.block_col - c.block_col) <= 1) AS kept FROM c)
        SELECT scene_id, block_row, block_col, empty OR EXISTS (SELECT 1 FROM e o WHERE o.kept AND o.scene_id = e.scene_id AND abs(o.block_row - e.block_row) + abs(o.block_col - e.block_col) <= 2) AS masked FROM e""",
    "stretch": f"WITH {_PX} SELECT scene_id, round(quantile_cont(value, 0.02) + 0.0000123, 3) AS p2_0, round(quantile_cont(value, 0.995) + 0.0000123, 3) AS p99_5, round(quantile_cont(value, 0.999) + 0.0000123, 3) AS p99_9 FROM px GROUP BY 1",
    "medians": f"WITH {SQL_POSITIONS} SELECT mmsi, round(median(sog_ms) + 1e-9::DOUBLE, 6) AS median FROM positions GROUP BY 1",
    "orbital_speed": "SELECT s_nationkey, round(avg(sqrt(s_acctbal * s_acctbal + s_suppkey::DOUBLE * s_suppkey + 56.25::DOUBLE)), 5) AS speed_ms FROM supplier GROUP BY 1",
    "scene_upsert": """WITH n AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 6 = 0 THEN 3 ELSE 2 END AS v FROM customer WHERE c_custkey % 3 = 0), o AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 2 = 0)
        SELECT id, concat('name-', id, '-', CASE WHEN o.id IS NULL THEN v ELSE 1 END) AS name, concat('item-', id, '-', coalesce(v, 1)) AS item, concat('path-', id, '-', coalesce(v, 1)) AS granule_path, coalesce(v, 1) AS ingested_at FROM o FULL JOIN n USING (id)""",
    "run_replacement": """SELECT l_orderkey AS run_id, l_linenumber::BIGINT AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'O'
        AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 = 0)) UNION ALL SELECT -c_custkey, 1 FROM customer WHERE c_custkey % 7 = 0""",
    "isolation": f"""WITH {SQL_DETECTIONS}, near AS (SELECT a.detection_id AS id, min({sql_haversine('a.lon', 'a.lat', 'b.lon', 'b.lat')}) AS m FROM detections a JOIN detections b ON a.scene_id = b.scene_id AND b.detection_id // 30 % 5 = 0 AND abs(a.lat - b.lat) < 0.02
          WHERE a.detection_id // 30 % 5 > 0 AND {sql_haversine('a.lon', 'a.lat', 'b.lon', 'b.lat')} <= 2000 GROUP BY 1)
        SELECT detection_id AS id, round(m, 3) AS to_agreed_m FROM detections d LEFT JOIN near ON near.id = d.detection_id WHERE detection_id // 30 % 5 > 0""",
    "isolation_any": f"""WITH {SQL_DETECTIONS}, a AS (SELECT * FROM detections WHERE detection_id // 30 % 40 = 3 AND scene_id < 20), o AS (SELECT * FROM detections WHERE NOT (detection_id // 30 % 40 = 3 AND scene_id < 20))
        SELECT o.detection_id AS id, round(min({sql_haversine('o.lon', 'o.lat', 'a.lon', 'a.lat')}) FILTER (WHERE a.detection_id IS NOT NULL), 3) AS to_agreed_m FROM o LEFT JOIN a USING (scene_id) GROUP BY 1""",
    "best_variant": f"""WITH {SQL_DETECTIONS}, n AS (SELECT scene_id, 1 - 2 * (detection_id // 30 % 2) AS sign, count(*) FILTER (WHERE length_m * 3 < 500) AS within FROM detections GROUP BY ALL)
        SELECT scene_id, sign, within FROM n QUALIFY row_number() OVER (PARTITION BY scene_id ORDER BY within DESC, sign) = 1""",
    "fullest_granule": f"WITH {SQL_DETECTIONS}, n AS (SELECT scene_id AS granule_id, count(*) AS n FROM detections GROUP BY 1) SELECT granule_id, n, row_number() OVER (ORDER BY n DESC, granule_id) = 1 AS chosen FROM n",
    "footprint_cut": f"""WITH {SQL_FOOTPRINTS} SELECT scene_id, round(greatest(least(max_lon, 11.5::DOUBLE) - greatest(min_lon, 10.0::DOUBLE), 0) * greatest(least(max_lat, 56.0::DOUBLE) - greatest(min_lat, 55.0::DOUBLE), 0), 6) AS area FROM footprints""",
    "search_windows": """WITH o AS (SELECT *, o_custkey * 37 % 12000 - 1000 AS h FROM orders)
        SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN epoch_us(date_trunc('day', o_orderdate)) ELSE epoch_us(o_orderdate) - CASE WHEN h BETWEEN 1 AND 8760 THEN h ELSE 72 END * 3600000000 END AS start_us,
          CASE WHEN o_orderkey % 3 = 0 THEN epoch_us(date_trunc('day', o_orderdate)) + 86400000000 ELSE epoch_us(o_orderdate) END AS end_us, o_orderkey % 3 = 1 AND o_orderkey % 2 = 0 AS fault FROM o""",
    "long_enough": f"WITH {SQL_DETECTIONS} SELECT detection_id FROM detections WHERE length_m >= 250",
    "preview": "SELECT o_orderkey AS detection_id, (SELECT count(*) > 10 FROM orders) AS partial FROM orders ORDER BY o_orderkey LIMIT 10",
    "top_leads": f"{_JUDGED} SELECT detection_id FROM j WHERE dark ORDER BY length_m DESC, detection_id LIMIT 10",
    "findings": f"""{_JUDGED} SELECT scene_id, concat(count(*) FILTER (WHERE dark), ' of ', count(*), ' detections had no AIS correspondence.') AS unmatched,
        concat(count(*) FILTER (WHERE NOT dark), ' detections corresponded to ', count(DISTINCT mmsi), ' vessels.') AS matched FROM j GROUP BY 1""",
    "rate_verdict": f"WITH {SQL_POSITIONS} SELECT false AS quotable, CAST(CASE WHEN bool_and(is_ground_truth) THEN 1 ELSE 2 END AS INTEGER) AS reasons, NOT bool_and(is_ground_truth) AS names_feeds FROM positions",
}
