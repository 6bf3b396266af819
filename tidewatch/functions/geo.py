"""Geodesy on a sphere, as column expressions.

Distances are in metres, angles in degrees, longitude before latitude in arguments. A sphere
differs from the ellipsoid by up to half a percent of a distance.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_008.8
KNOTS_TO_MS = 0.514444
#: The least metres in a degree of latitude that grid cells are sized by.
DEGREE_M = EARTH_RADIUS_M * math.pi / 180


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    half_lat, half_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_lon) * F.sin(half_lon)
    return F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), a)))) * (2 * EARTH_RADIUS_M)


def bearing_deg(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Initial bearing, 0 to under 360."""
    p1, p2, dl = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    y, x = F.sin(dl) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def destination(lon: Column, lat: Column, distance_m: Column, bearing: Column) -> tuple[Column, Column]:
    """(lon, lat) of the point that far along the bearing; a negative distance goes backwards."""
    p, b, d = F.radians(lat), F.radians(bearing), distance_m / EARTH_RADIUS_M
    s = F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(b)
    p2 = F.asin(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), s)))
    l2 = F.radians(lon) + F.atan2(F.sin(b) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(p2))
    return F.pmod(F.degrees(l2) + 540.0, F.lit(360.0)) - 180.0, F.degrees(p2)


def line_of_sight_ms(sog_ms: Column, cog: Column, range_bearing: Column, incidence: Column) -> Column:
    return sog_ms * F.cos(F.radians(cog - range_bearing)) * F.sin(F.radians(incidence))


def azimuth_shift_m(sog_ms: Column, cog: Column, range_bearing: Column, incidence: Column, r_over_v: Column, sign: float = -1.0) -> Column:
    """How far along the flight direction a moving target is drawn; none without a course."""
    shift = F.lit(sign) * r_over_v * F.coalesce(sog_ms, F.lit(0.0)) * F.cos(F.radians(cog - range_bearing)) * F.sin(F.radians(incidence))
    return F.when(cog.isNotNull(), shift).otherwise(0.0)


# -- grid cells: points within ``reach_m`` of each other lie in neighbouring cells -------------

def _rows(reach_m: float) -> float:
    """Degrees of latitude of a row of cells."""
    return min(180.0, 1.001 * reach_m / DEGREE_M)


def _columns_in(row: Column, reach_m: float) -> Column:
    """Cells around the globe in a row, wide enough at the poleward edge of the next row."""
    height = _rows(reach_m)
    edge = F.least(F.lit(90.0), F.greatest(F.abs((row - 1) * height - 90.0), F.abs((row + 2) * height - 90.0)))
    return F.greatest(F.lit(1), F.floor(360.0 * F.cos(F.radians(edge)) / height)).cast("int")


def _row_of(lat: Column, reach_m: float) -> Column:
    return F.floor((lat + 90.0) / _rows(reach_m)).cast("int")


def _column_of(lon: Column, row: Column, reach_m: float) -> Column:
    n = _columns_in(row, reach_m)
    return F.least(F.floor(F.pmod(lon + 180.0, F.lit(360.0)) / 360.0 * n).cast("int"), n - 1)


def cell(lon: Column, lat: Column, reach_m: float) -> Column:
    """struct(row, col) of a point."""
    row = _row_of(lat, reach_m)
    return F.struct(row.alias("row"), _column_of(lon, row, reach_m).alias("col"))


def cells_around(lon: Column, lat: Column, reach_m: float) -> Column:
    """Array of the cells where points within ``reach_m`` can lie; right at the poles and the date line too."""
    own = _row_of(lat, reach_m)

    def one(step: Column) -> Column:
        row = own + F.floor(step / 3).cast("int") - 1
        n = _columns_in(row, reach_m)
        col = F.pmod(_column_of(lon, row, reach_m) + F.pmod(step, F.lit(3)) - 1, n)
        return F.struct(row.alias("row"), col.cast("int").alias("col"))

    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(8)), one))


def cell_and_beside(lon: Column, lat: Column, reach_m: float) -> list[Column]:
    """What ``cells_around`` depends on, as columns: _row, and the point's column in the row below, its own and the one above (_c0, _c1, _c2)."""
    row = _row_of(lat, reach_m)
    return [row.alias("_row"), *(_column_of(lon, row + k - 1, reach_m).alias(f"_c{k}") for k in range(3))]


def cells_beside(reach_m: float) -> Column:
    """``cells_around`` from the columns of ``cell_and_beside``."""
    row = F.col("_row")
    return F.array_distinct(F.array(*(F.struct((row + k - 1).alias("row"), F.pmod(F.col(f"_c{k}") + s, _columns_in(row + k - 1, reach_m)).cast("int").alias("col")) for k in range(3) for s in (-1, 0, 1))))


def cells_touching(lon: Column, lat: Column, reach_m: float, side_m: float) -> Column:
    """Array of those cells of ``cell(..., side_m)`` where points within ``reach_m`` can lie, four at most; the side is four reaches at least."""
    if side_m < 4 * reach_m:
        raise ValueError("the side must be four reaches at least")
    reach = min(180.0, 1.001 * reach_m / DEGREE_M)
    wide = math.sin(math.radians(min(90.0, reach))) / F.cos(F.radians(lat))
    away = F.when(F.cos(F.radians(lat)) > 0, F.when(wide < 1, F.degrees(F.asin(wide)))).otherwise(F.lit(None))
    away = F.coalesce(away, F.lit(180.0))

    def one(north: float, east: Column) -> Column:
        row = _row_of(F.least(F.lit(90.0), F.greatest(F.lit(-90.0), lat + north)), side_m)
        return F.struct(row.alias("row"), _column_of(lon + east, row, side_m).alias("col"))

    return F.array_distinct(F.array(*(one(n, e) for n in (-reach, reach) for e in (-away, away))))


def tight_cell(lon: Column, lat: Column, reach_m: float) -> Column:
    """struct(row, col) of a cell so small that any two points in it are within ``reach_m`` of each other."""
    height = 0.999 * reach_m / math.sqrt(2) / DEGREE_M
    row = F.floor((lat + 90.0) / height)
    low = F.least(F.abs(row * height - 90.0), F.abs((row + 1) * height - 90.0))
    widest = F.when(F.signum(row * height - 90.0) * F.signum((row + 1) * height - 90.0) <= 0, 0.0).otherwise(low)
    columns = F.ceil(360.0 * F.cos(F.radians(widest)) / height)
    return F.struct(row.cast("long").alias("row"), F.least(F.floor(F.pmod(lon + 180.0, F.lit(360.0)) / 360.0 * columns), columns - 1).cast("long").alias("col"))


# -- tiles, boxes and polygons -----------------------------------------------------------------

def tile_x(lon: Column, zoom: int, clamped: bool = True) -> Column:
    """Column of tiles; what lies outside goes to the outermost one, or, not ``clamped``, on beyond it."""
    n = 2**zoom
    x = F.floor((lon + 180.0) / 360.0 * n).cast("int")
    return F.when(lon.isNotNull(), F.least(F.greatest(x, F.lit(0)), F.lit(n - 1))) if clamped else x


def tile_y(lat: Column, zoom: int, clamped: bool = True) -> Column:
    """Row of tiles; past the last parallel that tiles have as in ``tile_x``."""
    n = 2**zoom
    inside = F.greatest(F.least(lat, F.lit(85.05112878)), F.lit(-85.05112878)) if clamped else lat
    t = F.tan(F.radians(inside))
    # of the absolute value: asinh of a large negative number is lost in a difference
    y = F.floor((1.0 - F.signum(t) * F.asinh(F.abs(t)) / math.pi) / 2.0 * n).cast("int")
    return F.when(lat.isNotNull(), F.least(F.greatest(y, F.lit(0)), F.lit(n - 1))) if clamped else y


def tiles_for(min_lon: Column, min_lat: Column, max_lon: Column, max_lat: Column, zoom: int) -> Column:
    """Array of struct(z, x, y) of all tiles over a box."""
    xs = F.sequence(tile_x(min_lon, zoom), tile_x(max_lon, zoom))
    ys = F.sequence(tile_y(max_lat, zoom), tile_y(min_lat, zoom))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(F.lit(zoom).alias("z"), x.alias("x"), y.alias("y")))))


def in_box(lon: Column, lat: Column, box: tuple[float, float, float, float]) -> Column:
    """Closed on all sides; box is min_lon, min_lat, max_lon, max_lat."""
    return lon.between(box[0], box[2]) & lat.between(box[1], box[3])


def boxes_touch(min_lon: Column, min_lat: Column, max_lon: Column, max_lat: Column, box: tuple[float, float, float, float]) -> Column:
    return (min_lon <= box[2]) & (max_lon >= box[0]) & (min_lat <= box[3]) & (max_lat >= box[1])


def parse_box(text: str) -> tuple[float, float, float, float]:
    """min_lon,min_lat,max_lon,max_lat; raises ValueError on wrong arity, order or range."""
    parts = [float(p) for p in text.split(",")]
    if len(parts) != 4:
        raise ValueError("a box has four numbers: min_lon,min_lat,max_lon,max_lat")
    a, b, c, d = parts
    if not (-180 <= a <= 180 and -180 <= c <= 180 and -90 <= b <= 90 and -90 <= d <= 90):
        raise ValueError("out of range; the order is longitude, latitude")
    if a >= c or b >= d:
        raise ValueError("the minimum must be below the maximum")
    return a, b, c, d


def box_wkt(box: tuple[float, float, float, float]) -> str:
    a, b, c, d = box
    return f"POLYGON(({a} {b},{c} {b},{c} {d},{a} {d},{a} {b}))"


def wkt_ring(wkt: Column) -> Column:
    """Outer ring of a POLYGON as array<struct<lon,lat>>."""
    body = F.regexp_extract(wkt, r"\(\(([^()]*)\)", 1)
    return F.transform(F.split(body, r"\s*,\s*"), lambda p: F.struct(F.split(F.trim(p), r"\s+")[0].cast("double").alias("lon"), F.split(F.trim(p), r"\s+")[1].cast("double").alias("lat")))


def _let(value: Column, f) -> Column:
    """f(value) with the value worked out once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _edges(ring: Column) -> Column:
    """struct(a, b) of each point and its successor; ``ring`` should be a plain column or variable."""
    return F.transform(ring, lambda p, k: F.struct(p.alias("a"), F.element_at(ring, F.pmod(k + 1, F.size(ring)) + 1).alias("b")))


def in_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Even-odd rule over the edges of a ring; a closing point may stand or be left out."""
    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        above = (a["lat"] > lat) != (b["lat"] > lat)
        at = a["lon"] + (lat - a["lat"]) * (b["lon"] - a["lon"]) / F.nullif(b["lat"] - a["lat"], F.lit(0.0))
        return F.coalesce(above & (lon < at), F.lit(False))

    return _let(ring, lambda r: F.pmod(F.size(F.filter(_edges(r), crosses)), F.lit(2)) == 1)


def segment_distance_m(lon: Column, lat: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Metres from a point to a segment, on a local plane at the point's latitude."""
    k = F.cos(F.radians(lat))
    px, py, qx, qy = (ax - lon) * k, ay - lat, (bx - lon) * k, by - lat
    dx, dy = qx - px, qy - py
    t = F.coalesce(-(px * dx + py * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))
    return F.hypot(px + t * dx, py + t * dy) * DEGREE_M


def ring_area(ring: Column) -> Column:
    """Area in square degrees by the shoelace rule."""
    cross = lambda e: e["a"]["lon"] * e["b"]["lat"] - e["b"]["lon"] * e["a"]["lat"]
    return _let(ring, lambda r: F.abs(F.aggregate(F.transform(_edges(r), cross), F.lit(0.0), lambda s, x: s + x)) / 2)


def clip_ring(ring: Column, box: tuple[float, float, float, float]) -> Column:
    """A ring's part in a box, side by side of the box; parts of a concave ring stay joined along the box's sides."""
    side = lambda lon, limit, low: F.struct(F.lit(lon).alias("lon"), F.lit(float(limit)).alias("limit"), F.lit(low).alias("low"))
    sides = F.array(side(True, box[0], True), side(True, box[2], False), side(False, box[1], True), side(False, box[3], False))

    def cut(r: Column, s: Column) -> Column:
        at = lambda p: F.when(s["lon"], p["lon"]).otherwise(p["lat"])
        inside = lambda p: F.when(s["low"], at(p) >= s["limit"]).otherwise(at(p) <= s["limit"])

        def one(e: Column) -> Column:
            a, b = e["a"], e["b"]
            t = (s["limit"] - at(a)) / F.nullif(at(b) - at(a), F.lit(0.0))
            point = lambda lon, lat: F.struct(lon.alias("lon"), lat.alias("lat"))
            crossing = point(a["lon"] + t * (b["lon"] - a["lon"]), a["lat"] + t * (b["lat"] - a["lat"]))
            end = point(b["lon"], b["lat"])
            return F.filter(F.array(F.when(inside(a) != inside(b), crossing), F.when(inside(b), end)), lambda p: p.isNotNull())

        return F.flatten(F.transform(_edges(r), one))

    shape = "array<struct<lon:double,lat:double>>"
    return F.aggregate(sides, ring.cast(shape), lambda r, s: cut(r, s).cast(shape))
