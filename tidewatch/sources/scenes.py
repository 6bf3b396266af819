"""Scene products: annotation XML, archive members, footprints, catalogue items; and coastlines, reference detections, manifests."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import geo
from ..operators.radar import SPEED_OF_LIGHT
from ..schemas import REFERENCE_DETECTIONS
from . import archives

SCENE_GLOB = "S1*_IW_GRDH_*.zip"


class NotConfigured(RuntimeError):
    """A product that lacks what it must have."""


def find_scenes(spark: SparkSession, folder: str) -> DataFrame:
    """Paths and sizes of scene archives below a folder, by path."""
    return archives.listed(spark, folder, SCENE_GLOB).orderBy("path")


def annotation_members(spark: SparkSession, path: str, polarization: str = "vh") -> DataFrame:
    """(path, kind, xml) of the annotation, calibration and noise files of a polarization; each must be there once."""
    patterns = {
        "annotation": re.compile(rf"[^/]+\.SAFE/annotation/s1[^/]*-{polarization}-[^/]*\.xml$", re.I),
        "calibration": re.compile(rf"[^/]+\.SAFE/annotation/calibration/calibration-[^/]*-{polarization}-[^/]*\.xml$", re.I),
        "noise": re.compile(rf"[^/]+\.SAFE/annotation/calibration/noise-[^/]*-{polarization}-[^/]*\.xml$", re.I),
    }

    def one(name: str) -> Iterator[tuple]:
        with archives.opened(name) as raw, zipfile.ZipFile(raw) as z:
            roots = {m.split("/")[0] for m in z.namelist() if m.split("/")[0].endswith(".SAFE")}
            if len(roots) != 1:
                raise NotConfigured(f"{name} holds {len(roots)} products, not one")
            for kind, pattern in patterns.items():
                hits = [m for m in z.namelist() if pattern.fullmatch(m)]
                if len(hits) != 1:
                    raise NotConfigured(f"{name} holds {len(hits)} {kind} files for {polarization}, not one")
                yield name, kind, z.read(hits[0]).decode()

    return archives.read_each(archives.listed(spark, path), one, "path string, kind string, xml string", 1)


def _one(xml: Column, path: str) -> Column:
    return F.nullif(F.trim(F.xpath_string(xml, F.lit(path))), F.lit(""))


def _spread(xml: DataFrame) -> DataFrame:
    """The rows dealt over all cores: paths cost far more than a file's bytes, by which Spark sizes tasks, so thousands of texts may lie in one."""
    return xml.repartition(3 * xml.sparkSession.sparkContext.defaultParallelism)


#: Single facts by the element that holds them, and lists by their elements' path and the texts below each.
_FACTS = {
    "platform": "adsHeader/missionId", "mode": "adsHeader/mode", "product_type": "adsHeader/productType", "start_time": "adsHeader/startTime", "end_time": "adsHeader/stopTime",
    "absolute_orbit": "adsHeader/absoluteOrbitNumber", "pass_direction": "generalAnnotation/productInformation/pass", "heading": "platformHeading",
    "incidence_angle": "imageAnnotation/imageInformation/incidenceAngleMidSwath", "range_spacing_m": "imageAnnotation/imageInformation/rangePixelSpacing",
    "azimuth_spacing_m": "imageAnnotation/imageInformation/azimuthPixelSpacing", "width": "imageAnnotation/imageInformation/numberOfSamples", "height": "imageAnnotation/imageInformation/numberOfLines",
}
_FACT_LISTS = {"velocities": ("orbitList/orbit/velocity", ("x", "y", "z")), "grid": ("geolocationGridPoint", ("pixel", "slantRangeTime"))}


def _parsed(xml: str) -> ET.Element:
    """The document below a node of its own, names as written; raises on what isn't XML."""
    build, parser = ET.TreeBuilder(), expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = build.start, build.end, build.data
    build.start("document", {})
    parser.Parse(xml, True)
    build.end("document")
    return build.close()


def _facts(xml: str | None) -> dict:
    """The texts of a file's facts, read in one pass; None where there is no such element."""
    root = _parsed(xml) if xml else ET.Element("document")
    text = lambda node, path: None if (at := node.find(path)) is None else "".join(at.itertext())
    lists = {n: [{p: text(e, p) for p in parts} for e in root.iterfind(f".//{path}")] for n, (path, parts) in _FACT_LISTS.items()}
    return {n: text(root, f".//{path}") for n, path in _FACTS.items()} | lists


def product_facts(annotations: DataFrame, xml_col: str = "xml") -> DataFrame:
    """Header facts of annotation files: times, mission, geometry, orbital speed, and slant range and R/V at mid swath.

    Mid swath is the column of the file's own grid points that is nearest to the middle sample (the smaller among equals); its
    slant range is the mean over the column's lines. A file is parsed once, whatever the number of its facts.
    """
    annotations = _spread(annotations)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in _FACTS])
    for n, (_, parts) in _FACT_LISTS.items():
        schema.add(n, T.ArrayType(T.StructType([T.StructField(p, T.StringType()) for p in parts])))
    kind = to_arrow_schema(schema)

    @F.arrow_udf(schema)
    def facts(xml: pa.Array) -> pa.Array:
        return pa.array([_facts(x) for x in xml.to_pylist()], pa.struct(list(kind)))

    keep = [c for c in annotations.columns if c != xml_col]
    rows = annotations.select(*keep, facts(F.col(xml_col)).alias("_f"))
    one = lambda n: F.nullif(F.trim(F.col(f"_f.{n}")), F.lit(""))
    number = lambda n: one(n).try_cast("double")
    mean = lambda xs: F.when(F.size(xs) > 0, F.aggregate(xs, F.lit(0.0), lambda s, x: s + x) / F.size(xs))
    double = lambda t: F.trim(t).try_cast("double")
    norm = lambda v: F.sqrt(double(v["x"]) * double(v["x"]) + double(v["y"]) * double(v["y"]) + double(v["z"]) * double(v["z"]))
    speed = geo._let(F.transform("_f.velocities", norm), mean)
    off = lambda p: F.abs(p - (number("width") - 1) / 2)
    points = F.transform("_f.grid", lambda p: F.struct(off(double(p["pixel"])).alias("off"), double(p["pixel"]).alias("pixel"), double(p["slantRangeTime"]).alias("t")))
    known = F.filter(points, lambda p: p["off"].isNotNull() & p["t"].isNotNull())
    at_mid = lambda ps: geo._let(F.array_min(ps), lambda m: F.transform(F.filter(ps, lambda p: p["pixel"] == m["pixel"]), lambda p: p["t"]))
    slant = geo._let(geo._let(known, at_mid), mean) * (SPEED_OF_LIGHT / 2)
    platform = number("heading")
    start, stop = (one(p).try_cast("timestamp") for p in ("start_time", "end_time"))
    out = rows.select(
        *keep, one("platform").alias("platform"), one("mode").alias("mode"), one("product_type").alias("product_type"),
        start.alias("start_time"), stop.alias("end_time"), F.timestamp_micros(((F.unix_micros(start) + F.unix_micros(stop)) / 2).cast("long")).alias("acquisition_time"),
        one("absolute_orbit").try_cast("int").alias("absolute_orbit"), F.lower(one("pass_direction")).alias("pass_direction"),
        platform.alias("platform_heading_deg"), F.pmod(platform, F.lit(360.0)).alias("azimuth_bearing_deg"), F.pmod(platform + 90.0, F.lit(360.0)).alias("range_bearing_deg"),
        number("incidence_angle").alias("incidence_angle"), number("range_spacing_m").alias("range_spacing_m"), number("azimuth_spacing_m").alias("azimuth_spacing_m"),
        number("width").cast("int").alias("width"), number("height").cast("int").alias("height"), speed.alias("platform_speed_ms"), slant.alias("slant_range_m"),
    )
    return out.withColumn("r_over_v_s", F.col("slant_range_m") / F.nullif(F.col("platform_speed_ms"), F.lit(0.0)))


def grid_points(annotations: DataFrame, xml_col: str = "xml") -> DataFrame:
    """The geolocation grid as rows, with slant range and, where the speed is known, R/V."""
    annotations, x = _spread(annotations), F.col(xml_col)
    names = ("line", "pixel", "incidenceAngle", "slantRangeTime", "latitude", "longitude")
    lists = [F.transform(F.xpath(x, F.lit(f"//geolocationGridPoint/{n}/text()")), lambda t: t.try_cast("double")) for n in names]
    keep = [c for c in annotations.columns if c != xml_col]
    rows = annotations.select(*keep, F.inline(F.arrays_zip(*(a.alias(n) for a, n in zip(lists, names, strict=True))))).toDF(*keep, *names)
    return rows.withColumn("slant_range_m", F.col("slantRangeTime") * SPEED_OF_LIGHT / 2)


def lut_vectors(xml: DataFrame, tag: str, value: str, xml_col: str = "xml") -> DataFrame:
    """Vectors of a look-up table (calibrationVector/sigmaNought, noiseRangeVector/noiseRangeLut) as (line, pixels, values)."""
    xml, x = _spread(xml), F.col(xml_col)
    lines = F.xpath(x, F.lit(f"//{tag}/line/text()"))
    split = lambda p: F.transform(F.xpath(x, F.lit(f"//{tag}/{p}/text()")), lambda t: F.transform(F.split(F.trim(t), r"\s+"), lambda n: n.try_cast("double")))
    keep = [c for c in xml.columns if c != xml_col]
    rows = xml.select(*keep, F.inline(F.arrays_zip(F.transform(lines, lambda t: t.try_cast("int")), split("pixel"), split(value)))).toDF(*keep, "line", "pixels", "values")
    return rows.orderBy("line")


def footprint(manifest_xml: Column) -> Column:
    """Closed ring (lon, lat) from <gml:coordinates>, which come as lat,lon."""
    text = F.trim(F.regexp_extract(manifest_xml, r"<gml:coordinates>([^<]*)</gml:coordinates>", 1))
    points = F.transform(F.split(text, r"\s+"), lambda p: F.struct(F.split(p, ",")[1].cast("double").alias("lon"), F.split(p, ",")[0].cast("double").alias("lat")))
    closed = F.when(F.element_at(points, 1) == F.element_at(points, -1), points).otherwise(F.concat(points, F.slice(points, 1, 1)))
    return F.when(text != "", closed)


def item_link(item_json: Column, rel: str = "self") -> Column:
    """The href of a catalogue item's link."""
    links = F.from_json(F.get_json_object(item_json, "$.links"), "array<struct<rel:string,href:string>>")
    return F.get(F.filter(links, lambda x: x["rel"] == rel), F.lit(0))["href"]


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue items, one JSON file each, as scene rows."""
    return items(spark.read.option("recursiveFileLookup", True).text(path, wholetext=True))


def items(whole: DataFrame) -> DataFrame:
    """Scene rows from catalogue items (value: JSON)."""
    prop = lambda p: F.get_json_object("value", f"$.properties['{p}']")
    ring = F.transform(F.from_json(F.get_json_object("value", "$.geometry.coordinates[0]"), "array<array<double>>"), lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))
    return whole.select(
        F.get_json_object("value", "$.id").alias("id"), F.get_json_object("value", "$.collection").alias("collection"), prop("datetime").try_cast("timestamp").alias("acquisition_time"),
        prop("platform").alias("platform"), prop("sar:instrument_mode").alias("mode"), F.from_json(prop("sar:polarizations"), "array<string>").alias("polarizations"),
        prop("sat:relative_orbit").try_cast("int").alias("relative_orbit"), prop("view:incidence_angle").try_cast("double").alias("incidence_angle"), ring.alias("footprint"), F.col("value").alias("item"),
    )


def read_coastline(spark: SparkSession, path: str) -> DataFrame:
    """Rings (outer ones and holes) of a GeoJSON file's polygons, and the outer one as ``ring``; no features, no land."""
    return polygons(spark.read.text(path, wholetext=True))


def polygons(whole: DataFrame) -> DataFrame:
    """As ``read_coastline``, from GeoJSON texts (value)."""
    features = F.from_json(F.get_json_object("value", "$.features"), "array<struct<geometry:struct<type:string,coordinates:string>>>")
    g = whole.select(F.explode(features).alias("f")).select("f.geometry.type", "f.geometry.coordinates")
    flat = F.when(F.col("type") == "Polygon", F.array(F.from_json("coordinates", "array<array<array<double>>>"))).when(F.col("type") == "MultiPolygon", F.from_json("coordinates", "array<array<array<array<double>>>>"))
    rings = F.transform("p", lambda r: F.transform(r, lambda q: F.struct(q[0].alias("lon"), q[1].alias("lat"))))
    return g.select(F.explode(flat).alias("p")).select(rings.alias("rings")).withColumn("ring", F.col("rings")[0])


def reference_ids(tiles: DataFrame, content_col: str = "content") -> DataFrame:
    """Distinct (granule_id, lon, lat) named in binary map tiles."""
    text = F.decode(F.col(content_col), "ISO-8859-1")
    found = tiles.select(F.explode(F.regexp_extract_all(text, F.lit(r"(S1[AB]_[A-Z0-9_]+;-?\d+(?:\.\d+)?;-?\d+(?:\.\d+)?)"))).alias("t")).distinct()
    part = lambda k: F.split("t", ";")[k]
    return found.select(part(0).alias("granule_id"), part(1).cast("double").alias("lon"), part(2).cast("double").alias("lat"))


def read_reference(spark: SparkSession, path: str) -> DataFrame:
    """Reference detections from a JSON file with provenance and detections."""
    whole = spark.read.text(path, wholetext=True)
    shape = "array<struct<" + REFERENCE_DETECTIONS.replace(" ", ":").replace(",:", ",") + ">>"
    return whole.select(F.inline(F.from_json(F.get_json_object("value", "$.detections"), shape)))


def write_reference(df: DataFrame, path: str, source: str) -> None:
    """One JSON document of all detections of a request, with where they are from."""
    one = df.groupBy(F.lit(source).alias("source")).agg(F.array_sort(F.collect_list(F.struct("granule_id", "lon", "lat", "matched"))).alias("detections"))
    one.select(F.to_json(F.struct("source", "detections")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def load_manifest(spark: SparkSession, text: str, section: str) -> DataFrame:
    """Items of a section of a YAML manifest: name, role, bytes, sha256, url."""
    items = (yaml.safe_load(text) or {}).get(section, {}).get("items") or []
    rows = [(i.get("name"), i.get("role", "required"), i.get("bytes"), i.get("sha256"), i.get("url")) for i in items]
    bad = [r[0] for r in rows if r[1] not in ("required", "optional", "superseded")]
    if bad:
        raise NotConfigured(f"unknown roles of {', '.join(map(str, bad))}")
    return spark.createDataFrame(rows, "name string, role string, bytes long, sha256 string, url string")
