"""The space-time match on hand-made cases, geodesy and grid joins against brute force."""

import math
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import geo
from tidewatch.operators import match

AT = datetime(2026, 7, 17, 5, 23, 36, tzinfo=timezone.utc)
RANGE, AZIMUTH, INCIDENCE, RV = 286.842, 196.842, 38.7, 115.0


def haversine(lon1, lat1, lon2, lat2):
    p1, p2 = math.radians(lat1), math.radians(lat2)
    a = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * geo.EARTH_RADIUS_M * math.asin(min(1, math.sqrt(a)))


def moved(lon, lat, metres, bearing):
    d, b, p = metres / geo.EARTH_RADIUS_M, math.radians(bearing), math.radians(lat)
    p2 = math.asin(math.sin(p) * math.cos(d) + math.cos(p) * math.sin(d) * math.cos(b))
    return math.degrees(math.radians(lon) + math.atan2(math.sin(b) * math.sin(d) * math.cos(p), math.cos(d) - math.sin(p) * math.sin(p2))), math.degrees(p2)


def shift(sog, cog):
    return -RV * sog * math.cos(math.radians(cog - RANGE)) * math.sin(math.radians(INCIDENCE))


def run(spark, reports, detections=((11.0, 56.0),), window_s=660, radius=500.0, correct=True, gt=True):
    positions = spark.createDataFrame([(m, AT + timedelta(seconds=dt), lat, lon, sog, cog, "f", gt) for m, dt, lon, lat, sog, cog in reports], "mmsi string, ts timestamp, lat double, lon double, sog_ms double, cog_deg double, source string, is_ground_truth boolean")
    scenes = spark.createDataFrame([("S", AT, RANGE, AZIMUTH), ("OTHER", AT + timedelta(days=3), RANGE, AZIMUTH)], "scene_id string, acquisition_time timestamp, range_bearing_deg double, azimuth_bearing_deg double")
    found = spark.createDataFrame([(f"S:det_{k:05d}", "S", lon, lat, INCIDENCE, RV, 40.0) for k, (lon, lat) in enumerate(detections)], "detection_id string, scene_id string, lon double, lat double, incidence_deg double, r_over_v_s double, length_m double")
    out = match.match(positions, scenes, found, window_s, radius, correct)
    return {r.detection_id: r for r in out.collect()}, out


def around(mmsi, lon, lat, sog=0.0, cog=90.0, seconds=60):
    return [(mmsi, -seconds, lon, lat, sog, cog), (mmsi, seconds, lon, lat, sog, cog)]


def only(rows):
    return rows[0]["S:det_00000"]


def test_stationary_vessel_on_the_detection(spark):
    r = only(run(spark, around("1", 11.0, 56.0)))
    assert r.status == "matched" and r.azimuth_shift_m == pytest.approx(0) and r.distance_m == pytest.approx(0, abs=1e-3) and r.time_delta_s == 60


def test_vessel_across_the_swath_is_drawn_aside(spark):
    s = shift(10, RANGE)
    assert s == pytest.approx(-719, abs=1)
    lon, lat = moved(11.0, 56.0, -s, AZIMUTH)
    r = only(run(spark, around("1", lon, lat, 10.0, RANGE)))
    assert r.status == "matched" and r.distance_m < 2 and r.distance_uncorrected_m == pytest.approx(719, abs=2)
    assert only(run(spark, around("1", lon, lat, 10.0, RANGE), correct=False)).status == "dark"


def test_along_track_and_unknown_course_have_no_shift(spark):
    for cog in (AZIMUTH, None):
        r = only(run(spark, around("1", 11.0, 56.0, 3.0, cog)))
        assert r.status == "matched" and abs(r.azimuth_shift_m) < 1e-6


def test_what_is_never_a_match(spark):
    one_sided = [("1", -120, 11.0, 56.0, 0.0, 90.0), ("1", -60, 11.0, 56.0, 0.0, 90.0)]
    far = around("1", *moved(11.0, 56.0, 40_000, 90))
    outside = around("1", 11.0, 56.0, seconds=1800)
    for reports in (one_sided, far, outside):
        assert only(run(spark, reports)).status == "dark"


def test_prefilter_limits_the_speed(spark):
    s = shift(44.5, RANGE)
    lon, lat = moved(11.0, 56.0, -s, AZIMUTH)
    assert only(run(spark, around("1", lon, lat, 44.5, RANGE))).status == "dark"
    assert only(run(spark, around("1", lon, lat, 44.5, RANGE), radius=3000.0)).status == "matched"


def test_nearest_wins_and_ties_go_by_mmsi(spark):
    reports = around("2", 11.0, 56.0) + around("1", *moved(11.0, 56.0, 300, 90)) + around("3", 11.0, 56.0)
    assert only(run(spark, reports)).mmsi == "2"


def test_interpolation_and_a_report_at_the_instant(spark):
    a, b = moved(11.0, 56.0, -600, AZIMUTH), moved(11.0, 56.0, 600, AZIMUTH)
    r = only(run(spark, [("1", -60, *a, 0.0, None), ("1", 60, *b, 0.0, None)]))
    assert r.distance_m < 1 and r.time_delta_s == 60
    rows, out = run(spark, [("1", -60, *a, 0.0, None), ("1", 0, 11.0, 56.0, 0.0, None), ("1", 60, *b, 0.0, None)])
    assert out.count() == 1 and only((rows,)).distance_m < 1 and only((rows,)).time_delta_s == 0


def test_summary_and_order(spark):
    detections = [(11.0, 56.0), (11.5, 56.0), (11.6, 56.2)]
    _, out = run(spark, around("1", 11.0, 56.0), detections)
    s = match.summary(out).first()
    assert (s.detections, s.matched, s.dark, s.unmatched_fraction, s.quotable) == (3, 1, 2, "66.7%", True)
    assert match.in_order(out).first().status == "matched"
    assert not match.summary(run(spark, around("1", 11.0, 56.0), gt=False)[1]).first().quotable
    assert match.summary(out.where("false")).first().unmatched_fraction == "n/a"


def test_no_feed_means_no_statement(spark):
    _, out = run(spark, around("1", 11.0, 56.0))
    feeds = spark.createDataFrame([("OTHER", "f", 3, True)], "scene_id string, source string, positions long, ground_truth boolean")
    assert match.scenes_with_feed(out, feeds).count() == 0
    assert match.feed_combined(feeds.union(spark.createDataFrame([("OTHER", "e", 2, False)], feeds.schema))).first()[1:] == ("e, f", 5, False)


def test_grid_join_equals_brute_force_everywhere(spark):
    rnd = random.Random(1)
    spots = [(0, 0), (179.99, 10), (-179.99, 10), (20, 69.9), (20, 89.9), (-100, -89.95), (11, 56)]
    points = lambda n: [(k, "s", *(lambda c: ((c[0] + rnd.uniform(-0.1, 0.1) + 540) % 360 - 180, max(-90, min(90, c[1] + rnd.uniform(-0.05, 0.05)))))(rnd.choice(spots))) for k in range(n)]
    a, b = points(150), points(150)
    left = spark.createDataFrame(a, "id long, scene_id string, lon double, lat double")
    right = spark.createDataFrame([(k + 1000, s, x, y) for k, s, x, y in b], "other long, scene_id string, t_lon double, t_lat double")
    got = sorted((r.id, r.other) for r in match.spatial_range_join(left, right, 2500.0, ["scene_id"]).collect())
    assert got == sorted((p[0], q[0] + 1000) for p in a for q in b if haversine(p[2], p[3], q[2], q[3]) <= 2500) and got


def test_time_join_equals_brute_force(spark):
    rnd = random.Random(2)
    ts = [AT + timedelta(seconds=rnd.uniform(-5000, 5000)) for _ in range(200)]
    left = spark.createDataFrame([(k, t) for k, t in enumerate(ts[:100])], "i long, t timestamp")
    right = spark.createDataFrame([(k, t) for k, t in enumerate(ts[100:])], "j long, u timestamp")
    got = {(r.i, r.j) for r in match.time_range_join(left, right, "t", "u", 300).collect()}
    assert got == {(i, j) for i in range(100) for j in range(100) if abs((ts[i] - ts[100 + j]).total_seconds()) <= 300}


def test_no_product_in_the_plan(spark):
    _, out = run(spark, around("1", 11.0, 56.0))
    plan = out._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_polygons_and_boxes(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    df = spark.createDataFrame([(ring, 1.0, 1.0), (ring, 5.0, 1.0), (ring + ring[:1], 3.9, 3.9)], "ring array<struct<lon:double,lat:double>>, x double, y double")
    inside = [r[0] for r in df.select(geo.in_ring(F.col("x"), F.col("y"), F.col("ring"))).collect()]
    assert inside == [True, False, True]
    area = df.limit(1).select(geo.ring_area(F.col("ring")), geo.ring_area(geo.clip_ring(F.col("ring"), (2.0, 1.0, 9.0, 2.0))), geo.ring_area(geo.clip_ring(F.col("ring"), (7.0, 7.0, 9.0, 9.0)))).first()
    assert tuple(area) == pytest.approx((16.0, 2.0, 0.0))
    d = df.where("x = 5").select(F.array_min(F.transform(geo._edges(F.col("ring")), lambda e: geo.segment_distance_m(F.col("x"), F.col("y"), e["a"]["lon"], e["a"]["lat"], e["b"]["lon"], e["b"]["lat"])))).first()[0]
    assert d == pytest.approx(111_195 * math.cos(math.radians(1)), rel=1e-3)
    assert geo.parse_box("10.5,55.5,12.5,57.5") == (10.5, 55.5, 12.5, 57.5)
    for bad in ("1,2,3", "12,55,10,57", "10,100,12,120"):
        with pytest.raises(ValueError):
            geo.parse_box(bad)
    wkt = spark.range(1).select(geo.ring_area(geo.wkt_ring(F.lit(geo.box_wkt((0.0, 0.0, 2.0, 3.0)))))).first()[0]
    assert wkt == pytest.approx(6.0)


def test_published_geodesics(spark):
    """Test lines of Vincenty (1975) and of the Australian datum manual, to a millimetre."""
    from tidewatch.functions import spheroid

    dms = lambda d, m, s: (abs(d) + m / 60 + s / 3600) * (-1 if str(d).startswith("-") else 1)
    lines = [  # ellipsoid, latitude, bearing, metres, longitude and latitude of the end
        (spheroid.BESSEL, dms(55, 45, 0), dms(96, 36, 8.79960), 14110526.170, dms(108, 13, 0), dms(-33, 26, 0)),
        (spheroid.INTERNATIONAL, dms(37, 19, 54.95367), dms(95, 27, 59.63089), 4085966.703, dms(41, 28, 35.50729), dms(26, 7, 42.83946)),
        (spheroid.INTERNATIONAL, dms(35, 16, 11.24862), dms(15, 44, 23.74850), 8084823.839, dms(137, 47, 28.31435), dms(67, 22, 14.77638)),
        (spheroid.WGS84, dms(-37, 57, 3.72030), dms(306, 52, 5.37), 54972.271, dms(143, 55, 35.38390) - dms(144, 25, 29.52440), dms(-37, 39, 10.15610)),
    ]
    for on, lat, bearing, metres, lon2, lat2 in lines:
        v = lambda x: F.lit(float(x))
        lon3, lat3 = spheroid.destination(v(0), v(lat), v(metres), v(bearing), on)
        r = spark.range(1).select(spheroid.distance_m(v(0), v(lat), v(lon2), v(lat2), on), lon3, lat3).first()
        assert abs(r[0] - metres) < 0.0015 and abs(r[1] - lon2) < 5e-7 and abs(r[2] - lat2) < 5e-7
        back_lon, back_lat = spheroid.destination(v(7), v(lat), v(-metres / 10), v(bearing), on)
        assert abs(spark.range(1).select(back_lon.alias("x"), back_lat.alias("y")).select(spheroid.distance_m(v(7), v(lat), F.col("x"), F.col("y"), on)).first()[0] - metres / 10) < 1e-5
    ends = [(0.0, 0.0, 0.0, 0.0, 0.0), (10.0, 0.0, 11.0, 0.0, 111319.491), (0.0, 0.0, 0.0, 1.0, 110574.389), (0.0, 90.0, 77.0, 90.0, 0.0)]
    df = spark.createDataFrame(ends, "a double, b double, c double, d double, m double")
    assert all(abs(r.m - r.got) < 0.002 for r in df.withColumn("got", spheroid.distance_m(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect())
    over, beside = (spark.range(1).select(spheroid.distance_m(F.lit(a), F.lit(10.0), F.lit(b), F.lit(11.0))).first()[0] for a, b in ((179.5, -179.5), (20.0, 21.0)))
    assert abs(over - beside) < 1e-6  # over the date line
    opposite = spark.range(1).select(spheroid.distance_m(F.lit(0.0), F.lit(0.0), F.lit(179.9), F.lit(0.1))).first()[0]
    assert 19.9e6 < opposite < 20.1e6


def test_metric_at_the_edge_of_the_radius(spark):
    """North-south at 56 degrees the ellipsoid is longer than the sphere: 500 m of one is not 500 m of the other."""
    from tidewatch.functions import spheroid

    one = spark.createDataFrame([("s", 11.0, 56.0)], "scene_id string, lon double, lat double")
    for metres, sphere, ellipsoid in ((498.5, 1, 1), (499.9, 1, 1), (500.5, 1, 0), (501.5, 0, 0)):
        lon, lat = spheroid.destination(F.col("lon"), F.col("lat"), F.lit(metres), F.lit(0.0))
        other = one.select("scene_id", lon.alias("t_lon"), lat.alias("t_lat"))
        assert [match.spatial_range_join(one, other, 500.0, ["scene_id"], m).count() for m in ("sphere", "ellipsoid")] == [sphere, ellipsoid]


def test_geodesics_run_in_batches(spark):
    """Iterations aren't interpreted row by row, and a null end gives nulls."""
    from tidewatch.functions import spheroid

    ends = spark.createDataFrame([(10.0, 0.0, 11.0, 0.0), (None, 0.0, 1.0, 1.0)], "a double, b double, c double, d double")
    lon, lat = spheroid.destination(*(F.col(c) for c in "abcd"))
    rows = ends.select(spheroid.distance_m(*(F.col(c) for c in "abcd")).alias("m"), lon.alias("lon"), lat.alias("lat"))
    assert "aggregate(" not in rows._jdf.queryExecution().optimizedPlan().toString()
    got = [tuple(r) for r in rows.collect()]
    assert got[0][0] == pytest.approx(111319.491, abs=1e-3) and got[1][1:] == (None, None)
