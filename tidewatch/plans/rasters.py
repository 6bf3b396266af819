"""Queries of the catalogue, rasters and detector comparison, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import catalog, evaluate, geolocate, land, raster, tiles
from ..operators.radar import Config
from . import derived as d
from .derived import SQL_DETECTIONS, SQL_FOOTPRINTS, read, sql_haversine

_BOX = (10.0, 55.0, 11.5, 56.0)
_NO_TIE = 0.0000123  # means of cents lie on ties of rounding; this moves them off


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid of 256 rows and 256 columns for each return flag, from line items."""
    cell = [F.col("l_returnflag").alias("scene_id"), (F.col("l_orderkey") % 256).alias("row"), ((F.col("l_partkey") * 7 + F.col("l_linenumber")) % 256).alias("col")]
    cents = F.sum(F.floor(F.col("l_extendedprice") * 100 + 0.5).cast("long"))
    return read(spark, sf_dir, "lineitem").groupBy(*cell).agg((cents / 100.0).alias("value"), (F.sum(F.floor("l_quantity").cast("long")) % 13 != 0).alias("valid"))


#: Pixels along a tile: 16 tiles a scene.
_SIDE = 64


def _tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.tile(_pixels(spark, sf_dir), _SIDE)


def block_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tiles.block_mean(_tiles(spark, sf_dir), 32, _SIDE)
    return out.select(*raster._BLOCK, F.round(F.col("mean") + _NO_TIE, 4).alias("mean"), F.round("fill", 6).alias("fill"))


def block_stats_censored(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tiles.block_stats(_tiles(spark, sf_dir), 32, 1.0, _SIDE)
    return out.select(*raster._BLOCK, F.round(F.col("mean") + _NO_TIE, 4).alias("mean"), F.round("std", 3).alias("std"), F.round("fill", 6).alias("fill"))


_CONFIG = Config(k=1.5, censor=1.0, k_grow=1.0, min_pixels=2, grow_halfwidth_px=4)
_LAND = Config(k=1.5, censor=1.0, land_sigma0_db=47.6, land_open_blocks=1, land_dilate_blocks=1, max_fill_fraction=0.2)


def _counts(tested: DataFrame) -> DataFrame:
    return tested.groupBy("scene_id").agg(*(F.sum(c).alias(c) for c in tiles.COUNTS))


def cfar_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(tiles.tested(_tiles(spark, sf_dir), None, 100.0, _CONFIG, _SIDE)).select("scene_id", "px_above_cfar", "px_above_floor", "px_hot")


def cfar_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tests over water only: the mask is left out of the statistics and of the pixels."""
    source = tiles.written(_tiles(spark, sf_dir), "source")
    return _counts(tiles.tested(source, tiles.land_mask(source, _LAND, _SIDE), 100.0, _LAND, _SIDE))


def _flagged(spark: SparkSession, sf_dir: str, level: float) -> DataFrame:
    return tiles.block_mean(_tiles(spark, sf_dir), 8, _SIDE).select(*raster._BLOCK, (F.col("mean") > level).alias("mask"))


def dilate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.dilate(_flagged(spark, sf_dir, 60000), 2)


def erode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.erode(_flagged(spark, sf_dir, 35000), 1)


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tiles.labels(tiles.tested(_tiles(spark, sf_dir), None, None, _CONFIG, _SIDE), _SIDE)
    return out.select("scene_id", "row", "col", F.col("blob.row").alias("blob_row"), F.col("blob.col").alias("blob_col"))


def detect_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tiles.measure(tiles.tested(_tiles(spark, sf_dir), None, 100.0, _CONFIG, _SIDE), _CONFIG, _SIDE)
    return out.select("scene_id", *(F.round(c, 6).alias(c) for c in ("row", "col", "length_px", "width_px", "dx", "dy", "margin")), "pixels")


#: Off the lattice of places that pixels can have.
_AREA = (10.0500371, 55.8000173, 10.2000371, 55.9500173)
_VESSELS = Config(k=1.5, censor=1.0, k_grow=1.0, min_pixels=2, grow_halfwidth_px=4, land_sigma0_db=200.0, max_fill_fraction=1.1, min_length_m=25.0, max_length_m=90.0, merge_radius_m=0.0, min_heading_aspect=1.57)


def _ties(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Tie points of an image that is turned against north, the same for each return flag, and the images' sizes."""
    scenes = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("scene_id")).distinct()
    steps = F.array(*(F.lit(float(x)) for x in (0, 64, 128, 192, 256)))
    grid = scenes.select("scene_id", F.explode(steps).alias("row")).select("*", F.explode(steps).alias("col"))
    lon, lat = 10.0 + 0.001 * F.col("col") + 0.0001 * F.col("row"), 56.0 - 0.001 * F.col("row") + 0.0002 * F.col("col")
    return grid.select("*", lon.alias("lon"), lat.alias("lat")), scenes.select("scene_id", F.lit(256).alias("height"), F.lit(256).alias("width"))


def aoi_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geolocate.windows(*_ties(spark, sf_dir), _AREA, 20)


def vessels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From pixels to detections with ids, within an area and a band of lengths."""
    ties, sizes = _ties(spark, sf_dir)
    out = geolocate.detect_vessels(_tiles(spark, sf_dir), ties, sizes, _AREA, 10.0, 100.0, config=_VESSELS, pad=32, side=_SIDE)
    return out.select("id", "scene_id", *(F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("lon", "lat")), "length_m", "width_m", "heading_deg", "confidence", "cfar_margin_db")


def chips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decimated chip around a place of each supplier."""
    k = F.col("s_suppkey")
    centres = read(spark, sf_dir, "supplier").select(k.alias("id"), F.element_at(F.array(F.lit("A"), F.lit("N"), F.lit("R")), (k % 3 + 1).cast("int")).alias("scene_id"), (k * 37 % 256).alias("row"), (k * 91 % 256).alias("col"))
    return tiles.chips(_tiles(spark, sf_dir), centres, _ties(spark, sf_dir)[1], 18, 5, _SIDE).select("id", "y", "x", F.round("db", 6).alias("db"))


def spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = d.detections(spark, sf_dir).select("detection_id", "length_m")
    return catalog.spread(rows, [F.desc("length_m"), F.col("detection_id")], 48).select("detection_id", "place")


def single_link_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = d.detections(spark, sf_dir).select("scene_id", F.col("detection_id").alias("id"), "lon", "lat", F.col("length_m").alias("margin"))
    return raster.merge_fragments(points, 200.0).select("scene_id", "id", "fragments")


def length_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.length_bands(d.detections(spark, sf_dir))


def on_land(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = d.footprints(spark, sf_dir)
    corner = lambda x, y: F.struct(F.col(x).alias("lon"), F.col(y).alias("lat"))
    polygons = f.select(F.array(corner("min_lon", "min_lat"), corner("max_lon", "min_lat"), corner("max_lon", "max_lat"), corner("min_lon", "max_lat")).alias("ring"))
    points = d.detections(spark, sf_dir).select(F.col("detection_id").alias("id"), F.round("lon", 4).alias("lon"), F.round("lat", 4).alias("lat"))
    return land.on_land(points, polygons).select("id")


def _islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A concave polygon with a hole from each customer's footprint: an arrow that points down, its hole of the same shape in the upper part."""
    f = d.footprints(spark, sf_dir)
    w, h = F.col("max_lon") - F.col("min_lon"), F.col("max_lat") - F.col("min_lat")
    at = lambda x, y: F.struct((F.col("min_lon") + w * x).alias("lon"), (F.col("min_lat") + h * y).alias("lat"))
    outer = F.array(at(0, 1), at(0.5, 0), at(1, 1), at(0.5, 0.5))
    hole = F.array(at(0.46, 0.4), at(0.5, 0.2), at(0.54, 0.4), at(0.5, 0.3))
    return f.select("scene_id", F.array(outer, hole).alias("rings"))


def shore_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points on the islands of every customer or within 1 km of their shores."""
    points = d.detections(spark, sf_dir).select(F.col("detection_id").alias("id"), F.round("lon", 4).alias("lon"), F.round("lat", 4).alias("lat"))
    return land.on_land(points, _islands(spark, sf_dir), 1000.0).select("id")


def scene_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalog.search(d.footprints(spark, sf_dir), _BOX, "2024-01-02", "2024-01-09")
    return found.select("scene_id", F.unix_micros("acquisition_time").alias("us"))


def scene_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.ranked(d.footprints(spark, sf_dir), _BOX).where("rank <= 20").select("scene_id", "rank", F.round("coverage", 6).alias("coverage"))


def footprint_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangles cut by the box."""
    corner = lambda x, y: F.struct(F.col(x).alias("lon"), F.col(y).alias("lat"))
    ring = F.array(corner("min_lon", "min_lat"), corner("max_lon", "min_lat"), corner("max_lon", "max_lat"))
    wide = (9.0, 54.0, 15.0, 58.0)
    return d.footprints(spark, sf_dir).select("scene_id", F.round(catalog.footprint_area(ring, wide), 6).alias("area"))


def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("scene_id"), F.col("o_orderpriority").alias("detector"), F.col("o_orderdate").alias("started_at"))
    return catalog.latest_runs(runs, "scene_id", "detector").select("id", "scene_id", "detector")


def scene_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.detections(spark, sf_dir).groupBy("scene_id").agg(F.count(F.lit(1)).alias("n"))


def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.counts(scenes=d.scenes(spark), detections=d.detections(spark, sf_dir), positions=d.positions(spark, sf_dir))


def partition_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = d.detections(spark, sf_dir).select("detection_id")
    return evaluate.partition_check(ids, ids.where("detection_id % 3 = 0 AND detection_id > 10"), ids.where("detection_id % 3 > 0")).select("detection_id", "side")


def _reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = d.detections(spark, sf_dir)
    return t.select(F.col("scene_id").alias("granule_id"), (F.col("lon") + (F.col("detection_id") % 9) * 0.001).alias("lon"), F.col("lat"), (F.col("detection_id") % 8 == 0).alias("matched"))


def greedy_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ours = d.detections(spark, sf_dir).select(F.col("detection_id").alias("id"), "scene_id", "lon", "lat")
    return evaluate.compare(ours, _reference(spark, sf_dir))


QUERIES = {f.__name__: f for f in (block_mean, block_stats_censored, cfar_hot, cfar_masked, dilate, erode, components, detect_blobs, aoi_windows, vessels, chips, spread, single_link_merge, length_bands, on_land, shore_buffer, scene_search, scene_rank, footprint_area, latest_run, scene_counts, table_counts, partition_check, greedy_pairing)}

_PX = """px AS (SELECT l_returnflag AS scene_id, l_orderkey % 256 AS row, (l_partkey * 7 + l_linenumber) % 256 AS col, sum(floor(l_extendedprice * 100 + 0.5)::BIGINT) / 100.0::DOUBLE AS value,
    sum(floor(l_quantity)::BIGINT) % 13 <> 0 AS valid FROM lineitem GROUP BY 1, 2, 3)"""
_STATS = """b AS (SELECT *, CAST(row // 32 AS BIGINT) AS block_row, CAST(col // 32 AS BIGINT) AS block_col FROM px WHERE valid),
  f AS (SELECT scene_id, block_row, block_col, count(*) AS n0, avg(value) AS m0, sqrt(greatest(sum(value * value) / count(*) - pow(sum(value) / count(*), 2), 0)) AS s0 FROM b GROUP BY ALL),
  g AS (SELECT scene_id, block_row, block_col, count(*) AS n1, avg(value) AS m1, sqrt(greatest(sum(value * value) / count(*) - pow(sum(value) / count(*), 2), 0)) AS s1 FROM b JOIN f USING (scene_id, block_row, block_col) WHERE value <= m0 + 1.0 * s0 GROUP BY ALL),
  st AS (SELECT scene_id, block_row, block_col, CASE WHEN coalesce(n1, 0) < 128 THEN m0 ELSE m1 END AS mean, CASE WHEN coalesce(n1, 0) < 128 THEN s0 ELSE s1 END AS std, n0 / 1024.0::DOUBLE AS fill FROM f LEFT JOIN g USING (scene_id, block_row, block_col))"""
_CELLS = "c AS (SELECT scene_id, CAST(row // 8 AS BIGINT) AS block_row, CAST(col // 8 AS BIGINT) AS block_col, coalesce(avg(value) FILTER (WHERE valid), 0) > %s AS m FROM px GROUP BY ALL)"
_WALK = """walk AS (SELECT scene_id, row, col, row AS lr, col AS lc FROM hot
    UNION SELECT n.scene_id, n.row, n.col, w.lr, w.lc FROM walk w JOIN hot n ON n.scene_id = w.scene_id AND n.row BETWEEN w.row - 1 AND w.row + 1 AND n.col BETWEEN w.col - 1 AND w.col + 1),
  comp AS MATERIALIZED (SELECT scene_id, row, col, (l).r AS lr, (l).c AS lc FROM (SELECT scene_id, row, col, min(struct_pack(r := lr, c := lc)) AS l FROM walk GROUP BY 1, 2, 3))"""
# growth within the window of each blob, then the smallest rectangle over all directions between lattice points of its box
_BLOBS = f"""WITH RECURSIVE {_PX}, {_STATS}, v AS MATERIALIZED (SELECT scene_id, row, col, value, mean + 1.5 * std AS thr FROM b JOIN st USING (scene_id, block_row, block_col)),
        hot AS MATERIALIZED (SELECT scene_id, row, col FROM v WHERE value > thr AND value > 1000), {_WALK},
        blobs AS MATERIALIZED (SELECT scene_id, lr, lc, count(*) AS n, avg(row) + 0.5 AS row, avg(col) + 0.5 AS col, min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1 FROM comp GROUP BY 1, 2, 3 HAVING count(*) >= 2),
        low AS MATERIALIZED (SELECT scene_id, row, col FROM v WHERE value > thr * (1.0::DOUBLE / 1.5::DOUBLE)),
        grow AS (SELECT scene_id, lr, lc, row, col FROM comp JOIN low USING (scene_id, row, col) SEMI JOIN blobs USING (scene_id, lr, lc)
          UNION SELECT g.scene_id, g.lr, g.lc, n.row, n.col FROM grow g JOIN blobs o ON o.scene_id = g.scene_id AND o.lr = g.lr AND o.lc = g.lc JOIN low n ON n.scene_id = g.scene_id AND n.row BETWEEN g.row - 1 AND g.row + 1 AND n.col BETWEEN g.col - 1 AND g.col + 1
            WHERE n.row BETWEEN r0 - 4 AND r1 + 4 AND n.col BETWEEN c0 - 4 AND c1 + 4),
        size AS (SELECT scene_id, lr, lc, count(*) AS grown FROM grow GROUP BY 1, 2, 3),
        region AS (SELECT g.* FROM grow g JOIN size USING (scene_id, lr, lc) JOIN blobs USING (scene_id, lr, lc) WHERE grown >= n
          UNION ALL SELECT c.scene_id, c.lr, c.lc, c.row, c.col FROM comp c JOIN blobs o ON o.scene_id = c.scene_id AND o.lr = c.lr AND o.lc = c.lc LEFT JOIN size s ON s.scene_id = c.scene_id AND s.lr = c.lr AND s.lc = c.lc WHERE coalesce(grown, 0) < n),
        pts AS MATERIALIZED (SELECT DISTINCT scene_id, lr, lc, col + dx AS x, row + dy AS y FROM region, range(2) a(dx), range(2) e(dy)),
        wide AS (SELECT scene_id, lr, lc, max(x) - min(x) AS w, max(y) - min(y) AS h FROM pts GROUP BY 1, 2, 3),
        dirs AS (SELECT dx, dy FROM range(0, 64) a(dx), range(-63, 64) e(dy) WHERE gcd(dx, dy) = 1 AND (dx > 0 OR dy > 0)),
        cast_ AS (SELECT scene_id, lr, lc, dx, dy, dx * dx + dy * dy AS nn, max(x * dx + y * dy) - min(x * dx + y * dy) AS along, max(y * dx - x * dy) - min(y * dx - x * dy) AS across
          FROM pts JOIN wide USING (scene_id, lr, lc) JOIN dirs ON dx <= greatest(w, h) AND abs(dy) <= greatest(w, h) GROUP BY 1, 2, 3, 4, 5, 6),
        cand AS (SELECT scene_id, lr, lc, nn, along, across, along AS long, across AS short, dx AS ux, dy AS uy FROM cast_ WHERE along >= across
          UNION ALL SELECT scene_id, lr, lc, nn, along, across, across, along, CASE WHEN dy < 0 OR (dy = 0 AND dx < 0) THEN -dy WHEN dy = 0 THEN 0 ELSE dy END, CASE WHEN dy < 0 THEN dx WHEN dy = 0 THEN abs(dx) ELSE -dx END FROM cast_ WHERE across >= along),
        best AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY scene_id, lr, lc ORDER BY (along * across)::DOUBLE / nn, -(long * long)::DOUBLE / nn, abs(uy) / sqrt(nn), -uy) = 1),
        peak AS (SELECT o.scene_id, o.lr, o.lc, max(value) AS top, max(thr) AS lim FROM blobs o JOIN v ON v.scene_id = o.scene_id AND v.row BETWEEN r0 AND r1 AND v.col BETWEEN c0 AND c1 GROUP BY 1, 2, 3)"""
SQL = {
    "block_mean": f"WITH {_PX} SELECT scene_id, CAST(row // 32 AS BIGINT) AS block_row, CAST(col // 32 AS BIGINT) AS block_col, round(coalesce(avg(value) FILTER (WHERE valid), 0) + 0.0000123, 4) AS mean, round(count(*) FILTER (WHERE valid) / 1024.0::DOUBLE, 6) AS fill FROM px GROUP BY 1, 2, 3",
    "block_stats_censored": f"WITH {_PX}, {_STATS} SELECT scene_id, block_row, block_col, round(mean + 0.0000123, 4) AS mean, round(std, 3) AS std, round(fill, 6) AS fill FROM st",
    "cfar_hot": f"WITH {_PX}, {_STATS} SELECT scene_id, count(*) FILTER (WHERE value > mean + 1.5 * std) AS px_above_cfar, count(*) FILTER (WHERE value > 1000) AS px_above_floor, count(*) FILTER (WHERE value > mean + 1.5 * std AND value > 1000) AS px_hot FROM b JOIN st USING (scene_id, block_row, block_col) GROUP BY 1",
    "cfar_masked": f"""WITH {_PX}, c AS (SELECT scene_id, CAST(row // 8 AS BIGINT) AS br, CAST(col // 8 AS BIGINT) AS bc, coalesce(avg(value) FILTER (WHERE valid), 0) > pow(10, 4.76::DOUBLE) AS m, count(*) FILTER (WHERE valid) < 0.8::DOUBLE * count(*) AS fill FROM px GROUP BY ALL),
        e AS (SELECT c.*, m AND NOT EXISTS (SELECT 1 FROM c o WHERE NOT o.m AND o.scene_id = c.scene_id AND abs(o.br - c.br) + abs(o.bc - c.bc) <= 1) AS core FROM c),
        land AS (SELECT scene_id, br, bc, fill OR EXISTS (SELECT 1 FROM e o WHERE o.core AND o.scene_id = e.scene_id AND abs(o.br - e.br) + abs(o.bc - e.bc) <= 2) AS masked FROM e),
        w AS (SELECT px.*, masked, CAST(row // 32 AS BIGINT) AS block_row, CAST(col // 32 AS BIGINT) AS block_col FROM px JOIN land ON land.scene_id = px.scene_id AND br = row // 8 AND bc = col // 8),
        f AS (SELECT scene_id, block_row, block_col, count(*) AS n0, avg(value) AS m0, sqrt(greatest(sum(value * value) / count(*) - pow(sum(value) / count(*), 2), 0)) AS s0 FROM w WHERE valid AND NOT masked GROUP BY ALL),
        g AS (SELECT scene_id, block_row, block_col, count(*) AS n1, avg(value) AS m1, sqrt(greatest(sum(value * value) / count(*) - pow(sum(value) / count(*), 2), 0)) AS s1 FROM w JOIN f USING (scene_id, block_row, block_col) WHERE valid AND NOT masked AND value <= m0 + 1.0 * s0 GROUP BY ALL),
        st AS (SELECT scene_id, block_row, block_col, CASE WHEN coalesce(n1, 0) < 128 THEN m0 ELSE m1 END AS mean, CASE WHEN coalesce(n1, 0) < 128 THEN s0 ELSE s1 END AS std FROM f LEFT JOIN g USING (scene_id, block_row, block_col))
        SELECT scene_id, count(*) FILTER (WHERE valid) AS examined, count(*) FILTER (WHERE valid AND masked) AS masked, count(*) FILTER (WHERE valid AND NOT masked) AS water, count(*) FILTER (WHERE valid AND NOT masked AND value > mean + 1.5 * std) AS px_above_cfar,
          count(*) FILTER (WHERE valid AND NOT masked AND value > 1000) AS px_above_floor, count(*) FILTER (WHERE valid AND NOT masked AND value > mean + 1.5 * std AND value > 1000) AS px_hot FROM w LEFT JOIN st USING (scene_id, block_row, block_col) GROUP BY 1""",
    "components": f"""WITH RECURSIVE {_PX}, {_STATS}, hot AS MATERIALIZED (SELECT scene_id, row, col FROM b JOIN st USING (scene_id, block_row, block_col) WHERE value > mean + 1.5 * std), {_WALK}
        SELECT scene_id, row, col, lr AS blob_row, lc AS blob_col FROM comp""",
    "detect_blobs": f"""{_BLOBS}
        SELECT scene_id, round(row, 6) AS row, round(col, 6) AS col, round(long / sqrt(nn), 6) AS length_px, round(short / sqrt(nn), 6) AS width_px, round(ux / sqrt(nn), 6) AS dx, round(uy / sqrt(nn), 6) AS dy, round(top / greatest(lim, 1e-12), 6) AS margin, n AS pixels
        FROM blobs JOIN best USING (scene_id, lr, lc) JOIN peak USING (scene_id, lr, lc)""",
    "aoi_windows": """WITH s AS (SELECT DISTINCT l_returnflag AS scene_id FROM lineitem), k(lon, lat) AS (VALUES (10.0500371, 55.8000173), (10.2000371, 55.8000173), (10.0500371, 55.9500173), (10.2000371, 55.9500173)),
        p AS (SELECT ((lon - 10) * 0.0002 / 0.001 - (lat - 56)) / (0.001 + 0.0001 * 0.0002 / 0.001) AS r, (lon - 10 - 0.0001 * ((lon - 10) * 0.0002 / 0.001 - (lat - 56)) / (0.001 + 0.0001 * 0.0002 / 0.001)) / 0.001 AS c FROM k)
        SELECT scene_id, greatest(0, min(floor(r))::BIGINT - 20) AS row0, least(256, max(ceil(r))::BIGINT + 20) AS row1, greatest(0, min(floor(c))::BIGINT - 20) AS col0, least(256, max(ceil(c))::BIGINT + 20) AS col1 FROM s, p GROUP BY 1""",
    "vessels": f"""{_BLOBS},
        sized AS (SELECT scene_id, row, col, 10 * long / sqrt(nn) AS length_m, 10 * short / sqrt(nn) AS width_m, row + 40 * uy / sqrt(nn) AS tr, col + 40 * ux / sqrt(nn) AS tc, 10 * log10(greatest(top / greatest(lim, 1e-12), 1e-12)) AS db FROM blobs JOIN best USING (scene_id, lr, lc) JOIN peak USING (scene_id, lr, lc)),
        placed AS (SELECT *, 10 + 0.001 * col + 0.0001 * row AS lon, 56 - 0.001 * row + 0.0002 * col AS lat, 10 + 0.001 * tc + 0.0001 * tr AS lon2, 56 - 0.001 * tr + 0.0002 * tc AS lat2 FROM sized WHERE length_m BETWEEN 25 AND 90),
        named AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY row, col) - 1 AS k, (degrees(atan2(sin(radians(lon2 - lon)) * cos(radians(lat2)), cos(radians(lat)) * sin(radians(lat2)) - sin(radians(lat)) * cos(radians(lat2)) * cos(radians(lon2 - lon)))) + 360) % 180 AS h
          FROM placed WHERE lon BETWEEN 10.0500371 AND 10.2000371 AND lat BETWEEN 55.8000173 AND 55.9500173)
        SELECT printf('%s:det_%05d', scene_id, k) AS id, scene_id, round(lon + 1e-9, 6) AS lon, round(lat + 1e-9, 6) AS lat, round_even(length_m, 1) AS length_m, round_even(width_m, 1) AS width_m,
          CASE WHEN length_m / 10 >= 4 AND length_m / greatest(width_m, 10) >= 1.57 THEN round_even(h, 1) END AS heading_deg, round_even(least(1, greatest(0, db / 10)), 3) AS confidence, round_even(db, 2) AS cfar_margin_db FROM named""",
    "chips": f"""WITH {_PX}, c AS (SELECT s_suppkey AS id, ['A', 'N', 'R'][s_suppkey % 3 + 1] AS scene_id, s_suppkey * 37 % 256 AS r, s_suppkey * 91 % 256 AS c FROM supplier),
        b AS (SELECT id, c.scene_id, greatest(0, r - 18) AS r0, greatest(0, c - 18) AS c0, least(256, r + 18) - greatest(0, r - 18) AS h, least(256, c + 18) - greatest(0, c - 18) AS w FROM c SEMI JOIN px USING (scene_id)),
        o AS (SELECT *, unnest(range(greatest(1, h // 5))) AS y, greatest(1, h // 5) AS oh, greatest(1, w // 5) AS ow FROM b), g AS (SELECT *, unnest(range(ow)) AS x FROM o)
        SELECT id, y, x, CASE WHEN value IS NOT NULL THEN round(10 * log10(greatest(value, 1e-9)), 6) END AS db FROM g LEFT JOIN px ON px.scene_id = g.scene_id AND px.valid AND px.row = r0 + floor((y + 0.5) * h / oh)::BIGINT AND px.col = c0 + floor((x + 0.5) * w / ow)::BIGINT""",
    "spread": f"""WITH {SQL_DETECTIONS}, r AS (SELECT detection_id, row_number() OVER (ORDER BY length_m DESC, detection_id) AS place, count(*) OVER () AS n FROM detections)
        SELECT detection_id, place FROM r WHERE n <= 48 OR place - 1 IN (SELECT CAST(round_even(k * ((SELECT count(*) FROM orders) - 1) / 47.0::DOUBLE, 0) AS BIGINT) FROM range(48) t(k))""",
    "dilate": f"WITH {_PX}, {_CELLS % 60000} SELECT c.scene_id, c.block_row, c.block_col, EXISTS (SELECT 1 FROM c o WHERE o.m AND o.scene_id = c.scene_id AND abs(o.block_row - c.block_row) + abs(o.block_col - c.block_col) <= 2) AS mask FROM c",
    "erode": f"WITH {_PX}, {_CELLS % 35000} SELECT c.scene_id, c.block_row, c.block_col, NOT EXISTS (SELECT 1 FROM c o WHERE NOT o.m AND o.scene_id = c.scene_id AND abs(o.block_row - c.block_row) + abs(o.block_col - c.block_col) <= 1) AS mask FROM c",
    "single_link_merge": f"""WITH RECURSIVE {SQL_DETECTIONS}, near AS (SELECT a.detection_id AS a, b.detection_id AS b FROM detections a JOIN detections b USING (scene_id) WHERE abs(a.lat - b.lat) < 0.01 AND {sql_haversine('a.lon', 'a.lat', 'b.lon', 'b.lat')} <= 200),
        walk AS (SELECT detection_id AS n, detection_id AS label FROM detections UNION SELECT near.b, walk.label FROM walk JOIN near ON near.a = walk.n),
        comp AS (SELECT n, min(label) AS label FROM walk GROUP BY 1)
        SELECT scene_id, detection_id AS id, fragments FROM (SELECT d.scene_id, d.detection_id, count(*) OVER (PARTITION BY label) AS fragments, row_number() OVER (PARTITION BY label ORDER BY length_m DESC, detection_id) AS r FROM comp JOIN detections d ON d.detection_id = comp.n) WHERE r = 1""",
    "length_bands": f"WITH {SQL_DETECTIONS} SELECT scene_id, count(*) AS candidates, count(*) FILTER (WHERE length_m < 15) AS rejected_small, count(*) FILTER (WHERE length_m > 450) AS rejected_large, count(*) FILTER (WHERE length_m BETWEEN 15 AND 450) AS kept FROM detections GROUP BY 1",
    "on_land": f"""WITH {SQL_DETECTIONS}, {SQL_FOOTPRINTS}, p AS (SELECT detection_id AS id, round(lon, 4) AS lon, round(lat, 4) AS lat FROM detections)
        SELECT id FROM p WHERE EXISTS (SELECT 1 FROM footprints f WHERE p.lon >= f.min_lon AND p.lon < f.max_lon AND p.lat >= f.min_lat AND p.lat < f.max_lat)""",
    "shore_buffer": f"""WITH {SQL_DETECTIONS}, {SQL_FOOTPRINTS}, p AS (SELECT detection_id AS id, round(lon, 4) AS lon, round(lat, 4) AS lat FROM detections), place AS (SELECT DISTINCT lon, lat FROM p),
        e(ring, x1, y1, x2, y2) AS (VALUES (0, 0.0, 1.0, 0.5, 0.0), (0, 0.5, 0.0, 1.0, 1.0), (0, 1.0, 1.0, 0.5, 0.5), (0, 0.5, 0.5, 0.0, 1.0), (1, 0.46, 0.4, 0.5, 0.2), (1, 0.5, 0.2, 0.54, 0.4), (1, 0.54, 0.4, 0.5, 0.3), (1, 0.5, 0.3, 0.46, 0.4)),
        g AS MATERIALIZED (SELECT DISTINCT min_lon, min_lat, max_lon, max_lat, min_lon + (max_lon - min_lon) * x1 AS ax, min_lat + (max_lat - min_lat) * y1 AS ay, min_lon + (max_lon - min_lon) * x2 AS bx, min_lat + (max_lat - min_lat) * y2 AS bz FROM footprints, e),
        m AS (SELECT p.lon, p.lat, min_lon, min_lat, max_lon, max_lat, (ay > p.lat) <> (bz > p.lat) AND p.lon < ax + (p.lat - ay) * (bx - ax) / nullif(bz - ay, 0) AS hit, (ax - p.lon) * cos(radians(p.lat)) AS px, ay - p.lat AS py, (bx - p.lon) * cos(radians(p.lat)) AS qx, bz - p.lat AS qy
          FROM place p JOIN g ON p.lon BETWEEN min_lon - 0.03 AND max_lon + 0.03 AND p.lat BETWEEN min_lat - 0.03 AND max_lat + 0.03),
        n AS (SELECT *, least(1, greatest(0, -(px * (qx - px) + py * (qy - py)) / (pow(qx - px, 2) + pow(qy - py, 2)))) AS t FROM m),
        r AS (SELECT lon, lat FROM n GROUP BY lon, lat, min_lon, min_lat, max_lon, max_lat HAVING count(*) FILTER (WHERE hit) % 2 = 1 OR min(sqrt(pow(px + t * (qx - px), 2) + pow(py + t * (qy - py), 2))) * 6371008.8 * pi() / 180 <= 1000)
        SELECT id FROM p SEMI JOIN r USING (lon, lat)""",
    "scene_search": f"WITH {SQL_FOOTPRINTS} SELECT scene_id, CAST(at_s * 1000000 AS BIGINT) AS us FROM footprints WHERE min_lon <= 11.5 AND max_lon >= 10.0 AND min_lat <= 56.0 AND max_lat >= 55.0 AND at_s BETWEEN 1704153600 AND 1704758400",
    "scene_rank": f"""WITH {SQL_FOOTPRINTS}, r AS (SELECT scene_id, at_s, greatest(least(max_lon, 11.5::DOUBLE) - greatest(min_lon, 10.0::DOUBLE), 0) * greatest(least(max_lat, 56.0::DOUBLE) - greatest(min_lat, 55.0::DOUBLE), 0) AS coverage FROM footprints)
        SELECT scene_id, CAST(row_number() OVER (ORDER BY coverage DESC, at_s DESC, scene_id) AS INTEGER) AS rank, round(coverage, 6) AS coverage FROM r QUALIFY rank <= 20""",
    "footprint_area": f"WITH {SQL_FOOTPRINTS} SELECT scene_id, round((max_lon - min_lon) * (max_lat - min_lat) / 2, 6) AS area FROM footprints",
    "latest_run": "SELECT o_orderkey AS id, o_custkey AS scene_id, o_orderpriority AS detector FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "scene_counts": f"WITH {SQL_DETECTIONS} SELECT scene_id, count(*) AS n FROM detections GROUP BY 1",
    "table_counts": "SELECT 'scenes' AS name, CAST(30 AS BIGINT) AS rows UNION ALL SELECT 'detections', count(*) FROM orders UNION ALL SELECT 'positions', count(*) FROM events",
    # a step of the recursion gives the next target of every granule its nearest free detection
    "greedy_pairing": f"""WITH RECURSIVE {SQL_DETECTIONS}, theirs AS (SELECT scene_id AS g, lon + (detection_id % 9) * 0.001::DOUBLE AS lon, lat, bool_or(detection_id % 8 = 0) AS matched FROM detections GROUP BY 1, 2, 3),
        pairs AS MATERIALIZED (SELECT g, t.lon AS t_lon, t.lat AS t_lat, matched, o.detection_id AS id, {sql_haversine('o.lon', 'o.lat', 't.lon', 't.lat')} AS m FROM theirs t JOIN detections o ON o.scene_id = g AND abs(o.lat - t.lat) < 0.01 WHERE {sql_haversine('o.lon', 'o.lat', 't.lon', 't.lat')} <= 500),
        step AS MATERIALIZED (SELECT *, dense_rank() OVER (PARTITION BY g ORDER BY t_lat, t_lon) AS k FROM pairs),
        walk(g, k, taken, id, m, matched) AS (SELECT DISTINCT g, 0::BIGINT, []::BIGINT[], NULL::BIGINT, NULL::DOUBLE, NULL::BOOLEAN FROM step UNION ALL
          SELECT g, k, CASE WHEN best IS NULL THEN taken ELSE list_append(taken, struct_extract(best, 'id')) END, struct_extract(best, 'id'), struct_extract(best, 'm'), matched FROM (
            SELECT w.g, n.k, any_value(w.taken) AS taken, min(struct_pack(m := n.m, id := n.id)) FILTER (WHERE NOT list_contains(w.taken, n.id)) AS best, bool_or(n.matched) AS matched
            FROM walk w JOIN step n ON n.g = w.g AND n.k = w.k + 1 GROUP BY w.g, n.k)),
        pair AS (SELECT g, id, m, matched FROM walk WHERE id IS NOT NULL),
        mine AS (SELECT scene_id AS g, count(*) AS ours FROM detections GROUP BY 1), yours AS (SELECT g, count(*) AS theirs FROM theirs GROUP BY 1),
        agreed AS (SELECT g, count(*) AS agreed, count(*) FILTER (WHERE matched) AS both_matched, median(m) AS median_distance_m FROM pair GROUP BY 1),
        alone AS (SELECT * FROM detections WHERE detection_id NOT IN (SELECT id FROM pair)), used AS (SELECT * FROM detections WHERE detection_id IN (SELECT id FROM pair)),
        frag AS (SELECT a.scene_id AS g, count(DISTINCT a.detection_id) AS likely_fragments FROM alone a JOIN used u ON a.scene_id = u.scene_id AND abs(a.lat - u.lat) < 0.01 WHERE {sql_haversine('a.lon', 'a.lat', 'u.lon', 'u.lat')} <= 200 GROUP BY 1)
        SELECT g AS granule_id, ours, theirs, coalesce(agreed, 0) AS agreed, coalesce(both_matched, 0) AS their_matched_on_agreed, median_distance_m, coalesce(likely_fragments, 0) AS likely_fragments, ours - coalesce(agreed, 0) AS ours_only, theirs - coalesce(agreed, 0) AS theirs_only,
          coalesce(agreed, 0) - coalesce(both_matched, 0) AS their_unmatched_on_agreed, CASE WHEN theirs > 0 THEN coalesce(agreed, 0) / theirs ELSE 0.0::DOUBLE END AS recall, ours - coalesce(likely_fragments, 0) AS distinct_targets
        FROM mine FULL JOIN yours USING (g) LEFT JOIN agreed USING (g) LEFT JOIN frag USING (g)""",
    "partition_check": "SELECT o_orderkey AS detection_id, 'missing' AS side FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey <= 10",
}
