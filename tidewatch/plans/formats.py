"""Queries of what is read out of texts: product XML, catalogue items, GeoJSON, captures, identifiers; the texts are made from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..functions import text as rules
from ..operators import documents, manifest
from ..sources import ais, scenes
from . import derived as d
from .derived import SQL_FOOTPRINTS, read


def _say(template: str, **values: Column) -> Column:
    """The template with its {names} replaced by columns."""
    parts, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(before), values[name].cast("string")]
    return F.concat(*parts, F.lit(rest))


def _annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    header = "<adsHeader><missionId>S1D</missionId><productType>GRD</productType><mode>IW</mode><startTime>2026-01-01T00:00:{s}.000000</startTime><stopTime>2026-01-01T00:01:{e}.000000</stopTime><absoluteOrbitNumber>{k}</absoluteOrbitNumber></adsHeader>"
    orbits = "".join(f"<orbit><velocity><x>{{k}}.5</x><y>{7000 + n}</y><z>-{n}.25</z></velocity></orbit>" for n in (100, 200, 300))
    general = f"<generalAnnotation><productInformation><pass>Descending</pass><platformHeading>-{{h}}.5</platformHeading></productInformation><orbitList>{orbits}</orbitList></generalAnnotation>"
    image = "<imageAnnotation><imageInformation><incidenceAngleMidSwath>38.{s}</incidenceAngleMidSwath><rangePixelSpacing>10</rangePixelSpacing><azimuthPixelSpacing>10</azimuthPixelSpacing><numberOfSamples>{w}</numberOfSamples><numberOfLines>16669</numberOfLines></imageInformation></imageAnnotation>"
    points = "".join(f"<geolocationGridPoint><line>{n}</line><pixel>{m}</pixel><incidenceAngle>{30 + m}</incidenceAngle><slantRangeTime>0.0053</slantRangeTime><latitude>{{lat}}.{n}</latitude><longitude>1{m}.5</longitude></geolocationGridPoint>" for n in (1, 2) for m in (3, 4))
    tables = "".join(f"<calibrationVector><line>{n}</line><pixel count='3'>0 40 80</pixel><sigmaNought count='3'>{{k}} {n} 2.5</sigmaNought></calibrationVector>" for n in (20, 10))
    xml = _say(f"<product>{header}{general}{image}{points}{tables}</product>", s=F.lpad((k % 60).cast("string"), 2, "0"), e=F.lpad((k * 7 % 60).cast("string"), 2, "0"), k=k, h=k % 360, w=k + 100, lat=k % 80)
    return read(spark, sf_dir, "supplier").select("s_suppkey", xml.alias("xml"))


def product_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scenes.product_facts(_annotations(spark, sf_dir))
    return out.select(
        "s_suppkey", "platform", "mode", "product_type", "pass_direction", "absolute_orbit", F.unix_micros("start_time").alias("start_us"), F.unix_micros("end_time").alias("end_us"), F.unix_micros("acquisition_time").alias("us"),
        F.col("platform_heading_deg").alias("heading"), F.round("azimuth_bearing_deg", 6).alias("azimuth"), F.round("range_bearing_deg", 6).alias("range"), "incidence_angle", "range_spacing_m", "azimuth_spacing_m", "width", "height",
        F.round("platform_speed_ms", 6).alias("speed"), F.round("slant_range_m", 3).alias("slant_range_m"), F.round("r_over_v_s", 6).alias("r_over_v_s"),
    )


def grid_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scenes.grid_points(_annotations(spark, sf_dir))
    return out.select("s_suppkey", "line", "pixel", "latitude", "longitude", "incidenceAngle", F.round("slant_range_m", 3).alias("slant_range_m"))


def lut_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scenes.lut_vectors(_annotations(spark, sf_dir), "calibrationVector", "sigmaNought")
    return out.select("s_suppkey", "line", F.col("pixels")[2].alias("last_pixel"), F.aggregate("values", F.lit(0.0), lambda a, x: a + x).alias("total"))


def catalogue_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = d.footprints(spark, sf_dir)
    point = lambda x, y: F.array(F.col(x), F.col(y))
    ring = F.array(point("min_lon", "min_lat"), point("max_lon", "min_lat"), point("max_lon", "max_lat"), point("min_lon", "min_lat"))
    prop = F.struct(F.concat(F.lit("2026-07-17T05:"), F.lpad((F.col("scene_id") % 60).cast("string"), 2, "0"), F.lit(":36Z")).alias("datetime"), F.lit("sentinel-1d").alias("platform"), F.lit("IW").alias("sar:instrument_mode"), F.array(F.lit("VV"), F.lit("VH")).alias("sar:polarizations"), F.col("scene_id").alias("sat:relative_orbit"), F.lit(38.5).alias("view:incidence_angle"))
    link = lambda rel, href: F.struct(F.lit(rel).alias("rel"), href.alias("href"))
    item = F.to_json(F.struct(F.concat(F.lit("S"), F.col("scene_id").cast("string")).alias("id"), F.lit("grd").alias("collection"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"), prop.alias("properties"), F.array(link("root", F.lit("r")), link("self", F.concat(F.lit("https://example.invalid/"), F.col("scene_id").cast("string")))).alias("links")))
    out = scenes.items(f.select(item.alias("value")))
    return out.select("id", "collection", F.unix_micros("acquisition_time").alias("us"), "platform", "mode", F.array_join("polarizations", "+").alias("polarizations"), "relative_orbit", "incidence_angle", F.round(geo.ring_area(F.col("footprint")), 6).alias("area"), scenes.item_link(F.col("item")).alias("link"))


def footprint_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest's open ring of (lat, lon) closed as (lon, lat), the same ring from its WKT, and both areas."""
    f = d.footprints(spark, sf_dir)
    values = {c: F.col(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")}
    xml = _say("<safe><gml:coordinates> {min_lat},{min_lon} {min_lat},{max_lon} {max_lat},{max_lon} {max_lat},{min_lon} </gml:coordinates></safe>", **values)
    wkt = _say("POLYGON(({min_lon} {min_lat},{max_lon} {min_lat}, {max_lon} {max_lat},{min_lon} {max_lat},{min_lon} {min_lat}))", **values)
    rows = f.select("scene_id", scenes.footprint(xml).alias("ring"), geo.wkt_ring(wkt).alias("wkt"))
    return rows.select("scene_id", F.size("ring").alias("n"), F.col("ring")[2]["lon"].alias("lon"), F.col("wkt")[2]["lat"].alias("lat"), F.round(geo.ring_area(F.col("ring")), 6).alias("area"), F.round(geo.ring_area(F.col("wkt")), 6).alias("wkt_area"))


def reference_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in binary tiles, in two of them each."""
    k = F.col("c_custkey")
    name = F.concat(F.lit("S1A_IW_GRDH_"), k.cast("string"), F.lit(";"), (k % 180).cast("string"), F.lit("."), (k % 10).cast("string"), F.lit(";-"), (k % 80).cast("string"))
    tiles = read(spark, sf_dir, "customer").select(F.concat(F.lit("\u0001x"), name, F.lit("\u0002S1C_no;1;1;"), name, F.lit(";")).cast("binary").alias("content"))
    return scenes.reference_ids(tiles.union(tiles))


def capture_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    rows = read(spark, sf_dir, "events").select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss 'UTC'").alias("utc"), F.when(e % 9 == 0, " ").otherwise(F.col("user_id").cast("string")).alias("MMSI"), F.when(e % 5 == 0, "x").otherwise((e % 80).cast("string")).alias("lat"),
        (e % 170).cast("string").alias("lon"), F.when(e % 4 == 0, "").otherwise((e % 20).cast("string")).alias("sog"), (e % 360).cast("string").alias("cog"), F.lit(" A ").alias("name"),
    )
    return ais.capture(rows).select("mmsi", F.unix_micros("ts").alias("us"), "lat", "lon", F.round("sog_ms", 6).alias("sog_ms"), "cog_deg", "name", "ship_type", "source", "is_ground_truth")


def coast_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection for each customer: a polygon with a hole, and two polygons in one feature."""
    k = F.col("c_custkey") % 50
    square = lambda s: f"[[<k>,0],[<k>,{s}],[{s},{s}],[{s},0],[<k>,0]]"
    text = '{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"Polygon","coordinates":[' + square(90) + "," + square(60) + ']}},{"type":"Feature","geometry":{"type":"MultiPolygon","coordinates":[[' + square(70) + "],[" + square(80) + ']]}},{"type":"Feature","geometry":{"type":"Point","coordinates":[1,2]}}]}'
    rows = read(spark, sf_dir, "customer").select(F.replace(F.lit(text), F.lit("<k>"), k.cast("string")).alias("value"))
    found = scenes.polygons(rows).select(F.size("rings").alias("rings"), geo.ring_area(F.col("ring")).alias("area"))
    return found.groupBy("rings", "area").agg(F.count(F.lit(1)).alias("n"))


def text_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is put before a text to be embedded, ids from ids, arguments as a key, white space in one."""
    k = F.col("p_partkey")
    heading = F.when(k % 3 == 0, F.lit(None)).when(k % 3 == 1, "").otherwise(F.col("p_brand"))
    args = F.create_map(F.lit("z"), k.cast("string"), F.lit("a"), F.col("p_type"), F.lit("m"), F.lit("1"))
    spaced = F.concat(F.lit("  "), F.replace(F.col("p_name"), F.lit(" "), F.lit(" \n\t ")), F.lit("\n"))
    ids = F.concat(F.lit("S1:x:"), k.cast("string"), F.lit(":det_00001"))
    return read(spark, sf_dir, "part").select("p_partkey", rules.embedding_input(F.col("p_name"), heading, F.col("p_type")).alias("input"), rules.doc_of_chunk(F.concat(k.cast("string"), F.lit("#0001"))).alias("doc"), rules.scene_of_detection(ids).alias("scene"), rules.canonical_args(args).alias("args"), rules.collapse_space(spaced).alias("one_line"))


def role_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries and bytes of the wanted and of the skipped members."""
    role = F.element_at(F.array(F.lit("required"), F.lit("optional"), F.lit("superseded"), F.lit(None)), (F.col("p_partkey") % 4 + 1).cast("int"))
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), F.col("p_size").cast("long").alias("bytes"), role.alias("role"))
    wanted, skipped = manifest.select_roles(parts, ["required", "optional"])
    return manifest.totals(wanted).withColumn("side", F.lit("wanted")).union(manifest.totals(skipped).withColumn("side", F.lit("skipped")))


def member_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members against their manifest: some of another content, size or type, some twice, some more, some absent."""
    k = F.col("p_partkey")
    path = F.concat(F.lit("m/"), k.cast("string"))
    own = read(spark, sf_dir, "part").select("p_partkey", path.alias("path"), F.length("p_name").cast("long").alias("bytes"), F.sha2("p_name", 256).alias("sha256"))
    found = own.where("p_partkey % 10 <> 1").select(path.alias("path"), (F.col("bytes") + F.when(k % 10 == 2, 1).otherwise(0)).alias("bytes"), F.when(k % 10 == 3, F.sha2(F.lit("other"), 256)).otherwise(F.col("sha256")).alias("sha256"), (k % 10 != 4).alias("is_file"))
    twice = own.where("p_partkey % 10 = 5").select("path", "bytes", "sha256", F.lit(True))
    more = own.where("p_partkey % 10 = 6").select(F.concat("path", F.lit("x")), "bytes", "sha256", F.lit(True))
    return manifest.verify(own.select("path", "bytes", "sha256"), found.union(twice).union(more)).where("refusal IS NOT NULL").select("path", "copies", "refusal")


def activation_memos(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = F.to_json(F.struct(F.concat(F.lit("E"), F.col("o_orderkey").cast("string")).alias("code"), F.col("o_orderpriority").alias("name"), F.lit(" a\n  reason ").alias("reason"), F.lit("2026-01-01").alias("eventTime"), F.col("o_orderstatus").alias("category"), F.array(F.lit("DK"), F.lit("SE")).alias("countries")))
    return documents.activation_memo(read(spark, sf_dir, "orders").select(record.alias("value")))


QUERIES = {f.__name__: f for f in (product_facts, grid_points, lut_vectors, catalogue_items, footprint_texts, reference_tiles, capture_rows, coast_polygons, text_bits, role_totals, member_digests, activation_memos)}

SQL = {
    "product_facts": """WITH v AS (SELECT s_suppkey, epoch_us(TIMESTAMP '2026-01-01 00:00:00') + s_suppkey % 60 * 1000000 AS start_us, epoch_us(TIMESTAMP '2026-01-01 00:01:00') + s_suppkey * 7 % 60 * 1000000 AS end_us, -(s_suppkey % 360 + 0.5::DOUBLE) AS heading,
        (SELECT avg(sqrt(pow(s_suppkey + 0.5::DOUBLE, 2) + pow(7000 + n, 2) + pow(n + 0.25::DOUBLE, 2))) FROM (VALUES (100), (200), (300)) v(n)) AS speed, 0.0053::DOUBLE * 299792458 / 2 AS slant FROM supplier)
        SELECT s_suppkey, 'S1D' AS platform, 'IW' AS mode, 'GRD' AS product_type, 'descending' AS pass_direction, CAST(s_suppkey AS INTEGER) AS absolute_orbit, start_us, end_us, (start_us + end_us) // 2 AS us,
        heading, round((720 + heading) % 360, 6) AS azimuth, round((720 + heading + 90) % 360, 6) AS range, CAST('38.' || lpad(CAST(s_suppkey % 60 AS VARCHAR), 2, '0') AS DOUBLE) AS incidence_angle,
        10.0::DOUBLE AS range_spacing_m, 10.0::DOUBLE AS azimuth_spacing_m, CAST(s_suppkey + 100 AS INTEGER) AS width, 16669 AS height, round(speed, 6) AS speed, round(slant, 3) AS slant_range_m, round(slant / speed, 6) AS r_over_v_s FROM v""",
    "grid_points": """SELECT s_suppkey, n::DOUBLE AS line, m::DOUBLE AS pixel, s_suppkey % 80 + n / 10.0::DOUBLE AS latitude, 10 + m + 0.5::DOUBLE AS longitude, 30.0::DOUBLE + m AS incidenceAngle, round(0.0053::DOUBLE * 299792458 / 2, 3) AS slant_range_m
        FROM supplier, (VALUES (1), (2)) a(n), (VALUES (3), (4)) b(m)""",
    "lut_vectors": "SELECT s_suppkey, n AS line, 80.0::DOUBLE AS last_pixel, s_suppkey + n + 2.5::DOUBLE AS total FROM supplier, (VALUES (10), (20)) a(n)",
    "catalogue_items": f"""WITH {SQL_FOOTPRINTS} SELECT 'S' || scene_id AS id, 'grd' AS collection, epoch_us(TIMESTAMP '2026-07-17 05:00:36') + scene_id % 60 * 60000000 AS us, 'sentinel-1d' AS platform, 'IW' AS mode, 'VV+VH' AS polarizations, CAST(scene_id AS INTEGER) AS relative_orbit,
        38.5::DOUBLE AS incidence_angle, round((max_lon - min_lon) * (max_lat - min_lat) / 2, 6) AS area, 'https://example.invalid/' || scene_id AS link FROM footprints""",
    "footprint_texts": f"WITH {SQL_FOOTPRINTS} SELECT scene_id, 5 AS n, max_lon AS lon, max_lat AS lat, round((max_lon - min_lon) * (max_lat - min_lat), 6) AS area, round((max_lon - min_lon) * (max_lat - min_lat), 6) AS wkt_area FROM footprints",
    "reference_tiles": "SELECT 'S1A_IW_GRDH_' || c_custkey AS granule_id, c_custkey % 180 + (c_custkey % 10) / 10.0::DOUBLE AS lon, -(c_custkey % 80)::DOUBLE AS lat FROM customer",
    "capture_rows": """SELECT CAST(user_id AS VARCHAR) AS mmsi, epoch_us(date_trunc('second', ts)) AS us, (event_id % 80)::DOUBLE AS lat, (event_id % 170)::DOUBLE AS lon, CASE WHEN event_id % 4 <> 0 THEN round(event_id % 20 * 0.514444::DOUBLE, 6) END AS sog_ms,
        (event_id % 360)::DOUBLE AS cog_deg, 'A' AS name, CAST(NULL AS VARCHAR) AS ship_type, 'live' AS source, false AS is_ground_truth FROM events WHERE event_id % 9 <> 0 AND event_id % 5 <> 0""",
    "coast_polygons": "SELECT rings, (s - c_custkey % 50) * s::DOUBLE AS area, count(*) AS n FROM customer, (VALUES (2, 90), (1, 70), (1, 80)) v(rings, s) GROUP BY 1, 2",
    "text_bits": """SELECT p_partkey, p_name || CASE WHEN p_partkey % 3 = 2 THEN ' — ' || p_brand ELSE '' END || chr(10) || chr(10) || p_type AS input, CAST(p_partkey AS VARCHAR) AS doc, 'S1:x:' || p_partkey AS scene,
        '{"a":"' || p_type || '","m":"1","z":"' || p_partkey || '"}' AS args, p_name AS one_line FROM part""",
    "role_totals": "SELECT count(*) FILTER (WHERE p_partkey % 4 < 2) AS entries, coalesce(CAST(sum(p_size) FILTER (WHERE p_partkey % 4 < 2) AS BIGINT), 0) AS bytes, 'wanted' AS side FROM part UNION ALL SELECT count(*) FILTER (WHERE p_partkey % 4 >= 2), coalesce(CAST(sum(p_size) FILTER (WHERE p_partkey % 4 >= 2) AS BIGINT), 0), 'skipped' FROM part",
    "member_digests": """SELECT 'm/' || p_partkey AS path, CASE p_partkey % 10 WHEN 1 THEN 0 WHEN 5 THEN 2 ELSE 1 END AS copies, ['missing', 'size', 'digest', 'member_type', 'duplicate'][p_partkey % 10] AS refusal FROM part WHERE p_partkey % 10 BETWEEN 1 AND 5
        UNION ALL SELECT 'm/' || p_partkey || 'x', 1, 'unexpected' FROM part WHERE p_partkey % 10 = 6""",
    "activation_memos": "SELECT 'E' || o_orderkey AS doc_id, o_orderpriority AS title, '# ' || o_orderpriority || chr(10) || chr(10) || 'Category: ' || o_orderstatus || chr(10) || chr(10) || 'Countries: DK, SE' || chr(10) || chr(10) || 'Time: 2026-01-01' || chr(10) || chr(10) || 'a reason' AS text FROM orders",
}
