"""Land: polygons of any shape, with holes, as edges in cells; points on it or near its shore; cutting it to a box.

``polygons`` has ``rings``, an array of rings (outer ones and holes, in any order), or one ``ring``; a point is inside
where it lies in an odd number of a polygon's rings. No ring is sent anywhere whole: an edge goes to the cells that it
touches, and a cell knows of all other edges only whether its lower right corner is inside. From there to a point of the cell
the way is one step up along the cell's side and one to the left, and only the cell's own edges can lie across it.

Longitudes are taken as they are: a polygon over the date line has to be given in longitudes that run on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo

#: Degrees along a cell.
CELL = 0.25
_METRES = 111_000.0


def edges(polygons: DataFrame) -> DataFrame:
    """(polygon, ax, ay, bx, by): each edge of each ring, with a number for each shape in ``polygons``, however often it is there. Closing points may stand or be left out."""
    rings = F.col("rings") if "rings" in polygons.columns else F.array("ring")
    numbered = polygons.select(rings.alias("rings"), F.monotonically_increasing_id().alias("polygon")).groupBy("rings").agg(F.min("polygon").alias("polygon"))
    points = numbered.select("polygon", F.explode("rings").alias("r")).where(F.size("r") > 0)
    ends = points.select("polygon", F.explode(geo._edges(F.col("r"))).alias("e"))
    return ends.select("polygon", F.col("e.a.lon").alias("ax"), F.col("e.a.lat").alias("ay"), F.col("e.b.lon").alias("bx"), F.col("e.b.lat").alias("by")).where("ax <> bx OR ay <> by")


def _crosses(a: str, b: str, at: Column) -> Column:
    return (F.col(a) > at) != (F.col(b) > at)


def _on(a: str, b: str, c: str, d: str, at: Column) -> Column:
    """Where the line from (a, c) to (b, d) has the first coordinate ``at``."""
    return F.col(c) + (at - F.col(a)) * (F.col(d) - F.col(c)) / (F.col(b) - F.col(a))


def _corners(lines: DataFrame, size: float) -> DataFrame:
    """(polygon, cy, marks): how many edges cross the lower side of each row of cells, by column of cells."""
    low, high = F.floor(F.least("ay", "by") / size), F.floor(F.greatest("ay", "by") / size)
    met = lines.withColumn("cy", F.explode(F.sequence(low, high))).where(_crosses("ay", "by", F.col("cy") * size))
    # a crossing on a side lies left of it, as in what is counted within a cell
    by_column = met.groupBy("polygon", "cy", (F.ceil(_on("ay", "by", "ax", "bx", F.col("cy") * size) / size) - 1).alias("column")).agg(F.count(F.lit(1)).alias("n"))
    # a number for each cell of the row at most
    return by_column.groupBy("polygon", "cy").agg(F.collect_list(F.struct("column", "n")).alias("marks"))


def on_land(points: DataFrame, polygons: DataFrame, buffer_m: float = 0.0, size: float = CELL) -> DataFrame:
    """Points (id, lon, lat) in a polygon or within ``buffer_m`` of its edge; each row of ``points`` once.

    What is looked up are distinct places against distinct shapes. Edges in cells are many more than the rows they come from, by
    whose size a join would be planned: they are sorted, never broadcast.
    """
    place, lines = ["lon", "lat"], edges(polygons)
    at = points.select(*place).where("lon IS NOT NULL AND lat IS NOT NULL").distinct().withColumns({"cx": F.floor(F.col("lon") / size), "cy": F.floor(F.col("lat") / size)})
    reach = buffer_m / _METRES
    wide = reach / F.greatest(F.cos(F.radians(F.least(F.lit(89.9), F.greatest(F.abs("ay"), F.abs("by")) + reach))), F.lit(1e-3)) if buffer_m > 0 else F.lit(0.0)
    span = lambda a, b, more: F.sequence(F.floor((F.least(a, b) - more) / size), F.floor((F.greatest(a, b) + more) / size))
    # an edge on a cell's side belongs to the cells on both
    touched = lines.withColumn("wide", wide + 1e-9).withColumn("cx", F.explode(span("ax", "bx", F.col("wide")))).withColumn("cy", F.explode(span("ay", "by", F.lit(reach + 1e-9))))
    # cells that hold points, against the polygons that their row of cells meets
    beyond = F.aggregate(F.filter("marks", lambda m: m["column"] > F.col("cx")), F.lit(0).cast("long"), lambda s, m: s + m["n"])
    inside = at.select("cx", "cy").distinct().join(_corners(lines, size), "cy").where(beyond % 2 == 1).select("cx", "cy", "polygon")
    # a cell in a polygon that has no edge in it is land as a whole, whatever else is there: its points are settled
    full = inside.join(touched.select("cx", "cy", "polygon").distinct().hint("merge"), ["cx", "cy", "polygon"], "left_anti").select("cx", "cy").distinct()
    settled, at, inside = at.join(full, ["cx", "cy"], "left_semi").select(*place), at.join(full, ["cx", "cy"], "left_anti"), inside.join(full, ["cx", "cy"], "left_anti")
    met = at.join(touched.hint("merge"), ["cx", "cy"])
    right, lower = (F.col("cx") + 1) * size, F.col("cy") * size
    across = F.when(_crosses("ay", "by", F.col("lat")), _on("ay", "by", "ax", "bx", F.col("lat")))
    along = F.when(_crosses("ax", "bx", right), _on("ax", "bx", "ay", "by", right))
    # the way up is a hair to the right of the cell's side, and both ends of it a hair's hair above what they are: so an edge that
    # meets the way's end there lies above it where it rises
    rise = (F.col("by") - F.col("ay")) * (F.col("bx") - F.col("ax"))
    up = ((along > lower) | ((along == lower) & (rise > 0))) & ((along < F.col("lat")) | ((along == F.col("lat")) & (rise <= 0)))
    ways = F.coalesce((across > F.col("lon")) & (across <= right), F.lit(False)).cast("int") + F.coalesce(up, F.lit(False)).cast("int")
    near = geo.segment_distance_m(F.col("lon"), F.col("lat"), *(F.col(c) for c in ("ax", "ay", "bx", "by"))) <= buffer_m if buffer_m > 0 else F.lit(False)
    own = met.groupBy(*place, "polygon").agg(F.sum(ways).alias("n"), F.bool_or(near).alias("near"))
    corner = at.join(inside, ["cx", "cy"]).select(*place, "polygon", F.lit(1).cast("long").alias("n"), F.lit(False).alias("near"))
    found = own.union(corner).groupBy(*place, "polygon").agg(F.sum("n").alias("n"), F.bool_or("near").alias("near")).where("near OR n % 2 = 1")
    return points.join(found.select(*place).distinct().union(settled), place, "left_semi")


def clip(polygons: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """``polygons`` with ``rings`` cut to the box; those that have nothing in it go.

    Rings may be concave: where a ring leaves the box and comes back, its parts stay one ring, joined along the box's
    side there and back, which changes neither its area nor what is inside.
    """
    rings = F.col("rings") if "rings" in polygons.columns else F.array("ring")
    low = lambda axis: F.array_min(F.transform(F.flatten(rings), lambda p: p[axis]))
    high = lambda axis: F.array_max(F.transform(F.flatten(rings), lambda p: p[axis]))
    near = polygons.where(geo.boxes_touch(low("lon"), low("lat"), high("lon"), high("lat"), box))
    cut = F.filter(F.transform(rings, lambda r: geo.clip_ring(r, box)), lambda r: (F.size(r) > 2) & (geo.ring_area(r) > 0))
    others = [c for c in polygons.columns if c not in ("rings", "ring")]
    return near.select(*others, cut.alias("rings")).where(F.size("rings") > 0)


def write_coastline(polygons: DataFrame, path: str) -> None:
    """One GeoJSON document of all polygons, as ``sources.scenes.read_coastline`` reads it; none give an empty one."""
    rings = F.col("rings") if "rings" in polygons.columns else F.array("ring")
    closed = F.transform(rings, lambda r: F.transform(F.concat(r, F.slice(r, 1, 1)), lambda p: F.array(p["lon"], p["lat"])))
    geometry = F.struct(F.lit("Polygon").alias("type"), closed.alias("coordinates"))
    features = polygons.select(F.struct(F.lit("Feature").alias("type"), F.create_map().cast("map<string,string>").alias("properties"), geometry.alias("geometry")).alias("f"))
    one = features.agg(F.collect_list("f").alias("features"))  # a coastline cut to one box, one file
    one.select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("value")).coalesce(1).write.mode("overwrite").text(path)
