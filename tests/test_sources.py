"""Feeds, products and manifests read from files."""

import hashlib
import io
import json
import tarfile
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import documents, manifest
from tidewatch.sources import ais, scenes


def line(ts="17/07/2026 05:23:00", kind="Class A", mmsi="257843840", lat="56.489370", lon="10.951233", sog="7.0", cog="354.6", heading="180"):
    f = [""] * 26
    f[0], f[1], f[2], f[3], f[4], f[7], f[8], f[9], f[12], f[13], f[15], f[16] = ts, kind, mmsi, lat, lon, sog, cog, heading, "BORREGUTT", "Sailing", "4", "12"
    return ",".join(f)


LINES = [
    "# Timestamp,Type of mobile" + "," * 24, line(), line(), line(ts="17/07/2026 05:30:00"), line(ts="17/07/2026 09:00:00"), line(lon="20.0"), line(kind="Base Station"), line(kind="AtoN"),
    line(mmsi="2", lat="91", lon="181"), line(mmsi="3", heading="511", cog="360.1", sog="fast"), line(mmsi="4", cog="360"), line(mmsi="5", ts="no time"), line(mmsi="", ts="17/07/2026 05:24:00"),
]
BOX = (10.5, 55.5, 12.5, 57.5)


@pytest.fixture
def day(tmp_path):
    (tmp_path / "day.csv").write_text("\n".join(LINES) + "\n")
    with zipfile.ZipFile(tmp_path / "day.zip", "w") as z:
        z.write(tmp_path / "day.csv", "aisdk.csv")
    with zipfile.ZipFile(tmp_path / "two.zip", "w") as z:
        z.writestr("a.csv", "x")
        z.writestr("b.csv", "y")
    return tmp_path


def test_archive_day(spark, day):
    for name in ("day.csv", "day.zip"):
        got = {(r.mmsi, r.ts.minute): r for r in ais.positions(spark, "archive", f"{day}/{name}", BOX, "2026-07-17 05:12:00", "2026-07-17 05:34:00").collect()}
        assert sorted(got) == [("257843840", 23), ("257843840", 30), ("3", 23), ("4", 23)]
        first = got["257843840", 23]
        assert first.sog_ms == pytest.approx(3.601108) and first.name == "BORREGUTT" and first.length_m == 12 and first.nav_status is None and first.is_ground_truth
        assert got["3", 23].heading_deg is None and got["3", 23].cog_deg is None and got["3", 23].sog_ms is None and got["4", 23].cog_deg == 360


def test_refusals(spark, day):
    with pytest.raises(Exception, match="2 CSV files"):
        ais.read_zip(spark, f"{day}/two.zip").collect()
    for source in ("reference", "nonsense"):
        with pytest.raises(ais.NotConfigured):
            ais.positions(spark, source, "x", BOX, "2026-07-17", "2026-07-18")


def test_capture(spark, tmp_path):
    (tmp_path / "c.csv").write_text("utc,MMSI,lat,lon,sog,cog,name\n2026-08-03 15:12:39 UTC,1,56,11,10,511,A\nbad,2,56,11,1,1,B\n")
    r = ais.read_capture(spark, f"{tmp_path}/c.csv").collect()
    assert len(r) == 1 and r[0].ts == datetime(2026, 8, 3, 15, 12, 39) and r[0].cog_deg == 511 and not r[0].is_ground_truth and r[0].sog_ms == pytest.approx(5.14444)


def test_slices(spark, day):
    same = ais.slice_day(spark, f"{day}/day.csv", BOX, datetime(2026, 7, 17, 5, 12), datetime(2026, 7, 17, 5, 34))
    kept = [r.value for r in same.collect()]
    assert kept.count(line()) == 2 and line(kind="Base Station") in kept and line(ts="17/07/2026 09:00:00") not in kept
    over = ais.slice_day(spark, f"{day}/day.csv", BOX, datetime(2026, 7, 16, 23, 0), datetime(2026, 7, 17, 5, 34))
    assert line(kind="Base Station") not in [r.value for r in over.collect()]
    assert ais.slice_name("the bay", datetime(2026, 7, 17, 5), datetime(2026, 7, 17, 6)) == "the-bay_20260717T050000Z_20260717T060000Z.csv"


def test_loading_twice_adds_nothing(spark, day, tmp_path):
    p = ais.positions(spark, "archive", f"{day}/day.csv", BOX, "2026-07-17", "2026-07-18")
    assert tuple(ais.load(p, f"{tmp_path}/table").first()) == (5, 3)
    assert tuple(ais.load(p, f"{tmp_path}/table").first()) == (0, 0)


ANNOTATION = """<product><adsHeader><missionId>S1D</missionId><productType>GRD</productType><mode>IW</mode><startTime>2026-07-17T05:23:30</startTime><stopTime>2026-07-17T05:23:50</stopTime><absoluteOrbitNumber>42</absoluteOrbitNumber></adsHeader>
<generalAnnotation><productInformation><pass>Descending</pass><platformHeading>-163.158</platformHeading></productInformation><orbitList><orbit><velocity><x>3000</x><y>4000</y><z>0</z></velocity></orbit><orbit><velocity><x>0</x><y>0</y><z>7000</z></velocity></orbit></orbitList></generalAnnotation>
<imageAnnotation><imageInformation><incidenceAngleMidSwath>38.7</incidenceAngleMidSwath><rangePixelSpacing>10</rangePixelSpacing><azimuthPixelSpacing>10</azimuthPixelSpacing><numberOfSamples>26564</numberOfSamples><numberOfLines>16669</numberOfLines></imageInformation></imageAnnotation>
<geolocationGridPointList><geolocationGridPoint><line>0</line><pixel>0</pixel><incidenceAngle>30</incidenceAngle><slantRangeTime>0.0053</slantRangeTime><latitude>56</latitude><longitude>11</longitude></geolocationGridPoint>
<geolocationGridPoint><line>0</line><pixel>100</pixel><incidenceAngle>31</incidenceAngle><slantRangeTime>0.0054</slantRangeTime><latitude>56.1</latitude><longitude>11.1</longitude></geolocationGridPoint></geolocationGridPointList>
<calibrationVectorList><calibrationVector><line>0</line><pixel>0 40 80</pixel><sigmaNought>1.5 2.5 3.5</sigmaNought></calibrationVector></calibrationVectorList></product>"""


def test_annotation(spark, tmp_path):
    df = spark.createDataFrame([("a", ANNOTATION)], "path string, xml string")
    r = scenes.product_facts(df).first()
    assert r.acquisition_time == datetime(2026, 7, 17, 5, 23, 40) and r.range_bearing_deg == pytest.approx(286.842) and r.azimuth_bearing_deg == pytest.approx(196.842)
    assert r.platform_speed_ms == 6000 and (r.width, r.height, r.absolute_orbit, r.pass_direction) == (26564, 16669, 42, "descending")
    grid = scenes.grid_points(df).orderBy("pixel").collect()
    assert [g.pixel for g in grid] == [0, 100] and grid[0].slant_range_m == pytest.approx(0.0053 * 299_792_458 / 2)
    v = scenes.lut_vectors(df, "calibrationVector", "sigmaNought").first()
    assert (v.line, v.pixels, v["values"]) == (0, [0, 40, 80], [1.5, 2.5, 3.5])
    ring = spark.range(1).select(scenes.footprint(F.lit("<gml:coordinates>55,10 55,12 57,12 57,10</gml:coordinates>"))).first()[0]
    assert [(p.lon, p.lat) for p in ring] == [(10, 55), (12, 55), (12, 57), (10, 57), (10, 55)]
    with zipfile.ZipFile(tmp_path / "S1D_IW_GRDH_x.zip", "w") as z:
        for kind, m in (("annotation", "annotation/s1d-iw-grd-vh-1.xml"), ("calibration", "annotation/calibration/calibration-s1d-iw-grd-vh-1.xml"), ("noise", "annotation/calibration/noise-s1d-iw-grd-vh-1.xml")):
            z.writestr(f"S1D.SAFE/{m}", f"<{kind}/>")
    assert {r.kind: r.xml for r in scenes.annotation_members(spark, str(tmp_path)).collect()} == {k: f"<{k}/>" for k in ("annotation", "calibration", "noise")}
    assert scenes.find_scenes(spark, str(tmp_path)).count() == 1


def test_items_coast_and_reference(spark, tmp_path):
    item = {"id": "S", "collection": "c", "geometry": {"coordinates": [[[10, 55], [12, 55], [12, 57], [10, 55]]]}, "properties": {"datetime": "2026-07-17T05:23:36Z", "platform": "S1D", "sar:polarizations": ["VV", "VH"], "sat:relative_orbit": 168}, "links": [{"rel": "parent", "href": "p"}, {"rel": "self", "href": "me"}]}
    (tmp_path / "item.json").write_text(json.dumps(item))
    r = scenes.read_items(spark, f"{tmp_path}/item.json").withColumn("link", scenes.item_link(F.col("item"))).first()
    assert (r.id, r.polarizations, r.relative_orbit, r.link, len(r.footprint)) == ("S", ["VV", "VH"], 168, "me", 4)
    square = [[[0, 0], [1, 0], [1, 1], [0, 0]]]
    (tmp_path / "coast.json").write_text(json.dumps({"features": [{"geometry": {"type": "Polygon", "coordinates": square}}, {"geometry": {"type": "MultiPolygon", "coordinates": [square, square]}}]}))
    assert scenes.read_coastline(spark, f"{tmp_path}/coast.json").count() == 3
    (tmp_path / "tile").write_bytes(b"\x00\xffS1A_IW_GRDH_1;10.5;56.25\x00S1A_IW_GRDH_1;10.5;56.25\x01S1B_X;-1;2")
    ids = scenes.reference_ids(spark.read.format("binaryFile").load(f"{tmp_path}/tile"))
    assert sorted(tuple(r) for r in ids.collect()) == [("S1A_IW_GRDH_1", 10.5, 56.25), ("S1B_X", -1.0, 2.0)]
    scenes.write_reference(ids.withColumn("matched", F.lit(True)), f"{tmp_path}/ref", "test")
    assert scenes.read_reference(spark, f"{tmp_path}/ref").count() == 2


def test_manifests(spark, tmp_path):
    text = "sar:\n  items:\n  - {name: a, role: required, bytes: 3}\n  - {name: b, role: optional}\n"
    wanted, skipped = manifest.select_roles(scenes.load_manifest(spark, text, "sar"), ["required"])
    assert [r.name for r in wanted.collect()] == ["a"] and [r.name for r in skipped.collect()] == ["b"]
    with pytest.raises(scenes.NotConfigured):
        scenes.load_manifest(spark, "sar: {items: [{name: a, role: odd}]}", "sar")
    flat = documents.flatten_manifest({"groups": [{"publisher": "P", "items": [{"doc_id": "x"}, {"doc_id": "y", "publisher": "Q"}]}]})
    assert [(i["doc_id"], i["publisher"]) for i in flat] == [("x", "P"), ("y", "Q")]
    for bad in ([{"items": [{"doc_id": "x"}, {"doc_id": "x"}]}], [{"items": [{"doc_id": "x", "format": "odd"}]}]):
        with pytest.raises(documents.CorpusError):
            documents.flatten_manifest({"groups": bad})


def archive(path, entries, members, first=True):
    listed = json.dumps({"entries": entries}).encode()
    with tarfile.open(path, "w") as t:
        for name, data in ([("manifest.json", listed)] if first else []) + members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return str(path)


def test_archives(spark, tmp_path):
    entry = lambda n, d: {"path": n, "bytes": len(d), "sha256": hashlib.sha256(d).hexdigest(), "kind": "data"}
    good = [("a", b"one"), ("b", b"two")]
    entries = [entry(*m) for m in good]
    cases = {"whole": (entries, good, {}), "digest": (entries, [("a", b"onE"), good[1]], {"a": "digest"}), "size": (entries, [("a", b"on"), good[1]], {"a": "size"}), "missing": (entries, good[:1], {"b": "missing"}), "unexpected": (entries, [*good, ("c", b"x")], {"c": "unexpected"}), "duplicate": (entries, [*good, good[0]], {"a": "duplicate"})}
    for name, (listed, members, want) in cases.items():
        got = manifest.verify_archive(spark, archive(tmp_path / f"{name}.tar", listed, members))
        assert {r.path: r.refusal for r in got.collect()} == want, name
    late = manifest.verify_archive(spark, archive(tmp_path / "late.tar", entries, good, first=False))
    assert late.first().refusal == "manifest_not_first"


BIG = (2 << 30) + 12_345


def test_tar_over_two_gigabytes(spark, tmp_path):
    """A sparse member of over 2 GB, and the same archive cut off within it; workers get no more than 64 MB of either."""
    zeros, block = hashlib.sha256(), bytes(1 << 20)
    for _ in range(BIG >> 20):
        zeros.update(block)
    zeros.update(bytes(BIG & (1 << 20) - 1))
    listed = json.dumps({"entries": [{"path": "big.bin", "bytes": BIG, "sha256": zeros.hexdigest(), "kind": "data"}, {"path": "end.txt", "bytes": 3, "sha256": hashlib.sha256(b"end").hexdigest(), "kind": "data"}]}).encode()

    def write(path, whole):
        with open(path, "wb") as f:
            for name, data, size in (("manifest.json", listed, len(listed)), ("big.bin", b"", BIG), ("end.txt", b"end", 3)):
                info = tarfile.TarInfo(name)
                info.size = size
                f.write(info.tobuf())
                f.write(data)
                f.seek(f.tell() + size - len(data) + -size % 512)
                if name == "big.bin" and not whole:
                    f.truncate(f.tell() - (1 << 20))
                    return
            f.truncate(f.tell() + 1024)

    write(tmp_path / "whole.tar", True)
    write(tmp_path / "cut.tar", False)
    assert manifest.verify_archive(spark, str(tmp_path / "whole.tar")).collect() == []
    assert [tuple(r) for r in manifest.verify_archive(spark, str(tmp_path / "cut.tar")).collect()] == [("big.bin", "truncated")]
    sizes = {r.path: r.bytes for r in manifest.members(spark, str(tmp_path / "whole.tar")).collect()}
    assert sizes == {"manifest.json": len(listed), "big.bin": BIG, "end.txt": 3}


def test_zip_over_two_gigabytes(spark, tmp_path):
    """What stands before the zip's first member makes the file large, and is never read."""
    with open(tmp_path / "large.zip", "wb") as f:
        f.seek(BIG)
        with zipfile.ZipFile(f, "w") as z:
            z.writestr("day.csv", "# head\n" + ",".join(f"f{k}" for k in range(26)) + "\n")
    assert (tmp_path / "large.zip").stat().st_size > BIG
    assert [tuple(r) for r in ais.read_zip(spark, str(tmp_path / "large.zip")).collect()] == [tuple(f"f{k}" for k in range(26))]


def test_empty_and_broken_archives(spark, tmp_path):
    (tmp_path / "none.tar").write_bytes(b"")
    with tarfile.open(tmp_path / "no_members.tar", "w"):
        pass
    (tmp_path / "junk.tar").write_bytes(b"no archive at all" * 100)
    got = {n: [r.refusal for r in manifest.verify_archive(spark, str(tmp_path / f"{n}.tar")).collect()] for n in ("none", "no_members", "junk")}
    assert got == dict.fromkeys(got, ["manifest_not_first"])


def test_slice_is_written_with_its_counts(spark, day, tmp_path):
    window = datetime(2026, 7, 17, 5, 12), datetime(2026, 7, 17, 5, 34)
    for _ in range(2):  # the second time it is replaced
        kept, scanned = ais.write_slice(spark, f"{day}/day.csv", str(tmp_path / "slice"), BOX, *window)
    lines = sorted(r.value for r in spark.read.text(str(tmp_path / "slice")).collect())
    assert lines == sorted(r.value for r in ais.slice_day(spark, f"{day}/day.csv", BOX, *window).collect())
    assert (kept, scanned) == (len(lines), spark.read.text(f"{day}/day.csv").count()) and 0 < kept < scanned
    assert not (tmp_path / "slice.part").exists()


def tiff(values, order="<", large=False, rows=3):
    """An uncompressed image in strips of ``rows`` rows."""
    import struct

    data = values.astype(values.dtype.newbyteorder(order)).tobytes()
    height, width = values.shape
    line = width * values.dtype.itemsize
    word, head = ("Q", 16) if large else ("I", 8)
    offsets = [head + r * line for r in range(0, height, rows)]
    listed = struct.pack(f"{order}{len(offsets)}{word}", *offsets)
    tags = [(256, 4, 1, width), (257, 4, 1, height), (258, 3, 1, values.dtype.itemsize * 8), (259, 3, 1, 1), (273, 16 if large else 4, len(offsets), head + len(data) if len(offsets) > 1 else offsets[0]), (277, 3, 1, 1), (278, 4, 1, rows), (339, 3, 1, 3 if values.dtype.kind == "f" else 1)]
    size = 8 if large else 4
    entry = lambda t, k, n, v: struct.pack(f"{order}HH{word}", t, k, n) + struct.pack(order + {3: "H", 4: "I", 16: "Q"}[k if n == 1 else (16 if large else 4)], v).ljust(size, b"\0")
    start = head + len(data) + len(listed)
    begin = struct.pack(f"{order}2sHHHQ", b"II" if order == "<" else b"MM", 43, 8, 0, start) if large else struct.pack(f"{order}2sHI", b"II" if order == "<" else b"MM", 42, start)
    return begin + data + listed + struct.pack(order + ("Q" if large else "H"), len(tags)) + b"".join(entry(*t) for t in tags) + bytes(size)


def test_images_by_windows(spark, tmp_path):
    import numpy as np

    from tidewatch.operators import tiles
    from tidewatch.sources import rasters

    rng = np.random.default_rng(0)
    images = {"a": rng.integers(0, 4, (50, 37)).astype(np.uint16), "b.x": rng.uniform(-1, 9, (40, 20)).astype(np.float32)}
    (tmp_path / "a.tiff").write_bytes(tiff(images["a"]))
    (tmp_path / "b.x.tif").write_bytes(tiff(images["b.x"], ">", True, 7))
    sizes = rasters.image_sizes(spark, str(tmp_path))
    assert {r.scene_id: (r.height, r.width) for r in sizes.collect()} == {k: v.shape for k, v in images.items()}
    got = {(r.scene_id, r.tile_row, r.tile_col): r for r in rasters.read_tiles(sizes, 16).collect()}
    assert set(got) == {(s, r, c) for s, v in images.items() for r in range(-(-v.shape[0] // 16)) for c in range(-(-v.shape[1] // 16))}
    for (s, r, c), t in got.items():
        want = images[s][16 * r : 16 * r + 16, 16 * c : 16 * c + 16]
        value, state = np.frombuffer(t.value).reshape(16, 16), np.frombuffer(t.state, "u1").reshape(16, 16)
        box = tuple(slice(0, n) for n in want.shape)
        assert (value[box] == want).all() and ((state[box] & tiles.VALID > 0) == (want > 0)).all() and (state[box] & tiles.THERE).all() and (state & tiles.THERE).sum() == want.size
    part = rasters.read_tiles(sizes, 16, (17, 33), (16, 21)).collect()
    assert sorted((r.scene_id, r.tile_row, r.tile_col) for r in part) == [(s, r, 1) for s in ("a", "b.x") for r in (1, 2)]
    luts = [("a", [0.0, 20.0, 40.0], [0.0, 10.0, 30.0], [float(x) for x in range(2, 11)], [0.1 * x for x in range(9)])]
    done = rasters.calibrated(rasters.read_tiles(sizes, 16), spark.createDataFrame(luts, "scene_id string, lines array<double>, pixels array<double>, gain array<double>, noise array<double>"), 16)
    rows = {(r.tile_row, r.tile_col): r for r in done.collect()}
    assert len(rows) == 12

    def linear(flat, r, c):
        g, x, y = np.array(flat).reshape(3, 3), (0, 20, 40), (0, 10, 30)
        i, j = (0 if r < 20 else 1), (0 if c < 10 else 1)
        u, v = (r - x[i]) / (x[i + 1] - x[i]), min(1, (c - y[j]) / (y[j + 1] - y[j]))
        return (g[i, j] * (1 - v) + g[i, j + 1] * v) * (1 - u) + (g[i + 1, j] * (1 - v) + g[i + 1, j + 1] * v) * u

    for r, c in ((0, 0), (5, 7), (21, 12), (39, 29), (47, 36), (33, 31)):
        t, dn = rows[r // 16, c // 16], float(images["a"][r, c])
        gain, noise = linear(luts[0][3], r, c), linear(luts[0][4], r, c)
        assert np.frombuffer(t.value).reshape(16, 16)[r % 16, c % 16] == pytest.approx((dn * dn - noise) / gain**2)
        assert np.frombuffer(t.noise).reshape(16, 16)[r % 16, c % 16] == pytest.approx(noise / gain**2)
    counts = tiles.tested(done, None, None, tiles.Config(block=8, min_snr_db=0.0), 16).agg(F.sum("examined"), F.sum("px_above_floor")).first()
    want = sum(images["a"][r, c] > 0 and (float(images["a"][r, c]) ** 2 - linear(luts[0][4], r, c)) > linear(luts[0][4], r, c) for r in range(50) for c in range(37))
    assert tuple(counts) == (int((images["a"] > 0).sum()), want)
    (tmp_path / "no.tif").write_bytes(b"nothing of the kind")
    with pytest.raises(Exception, match="no TIFF"):
        rasters.image_sizes(spark, str(tmp_path)).collect()


def test_annotations_are_parsed_on_all_cores(spark, small):
    """However few bytes they have."""
    from tidewatch.plans import formats

    assert formats.product_facts(spark, small).rdd.getNumPartitions() == 3 * spark.sparkContext.defaultParallelism


def test_product_facts_are_whole(spark, small):
    """Slant range and R/V at mid swath from the file's own grid points; the query returns every fact; a file is parsed once."""
    from tidewatch.plans import formats

    point = lambda n, p, t: f"<geolocationGridPoint><line>{n}</line><pixel>{p}</pixel><slantRangeTime>{t}</slantRangeTime></geolocationGridPoint>"
    grid = "".join(point(n, p, t) for n, p, t in ((0, 0, 0.005), (0, 50, 0.0052), (0, 100, 0.006), (9, 0, 0.005), (9, 50, 0.0054), (9, 100, 0.006)))
    orbits = "<orbitList><orbit><velocity><x>3000</x><y>4000</y><z>0</z></velocity></orbit><orbit/><orbit><velocity><x> 0 </x><y>0</y><z>7000</z></velocity></orbit></orbitList>"
    xml = f'<?xml version="1.0" encoding="UTF-8"?><product xmlns="urn:x"><imageInformation><numberOfSamples>9</numberOfSamples></imageInformation><imageAnnotation><imageInformation><numberOfSamples>101</numberOfSamples></imageInformation></imageAnnotation>{orbits}{grid}</product>'
    rows = {r.k: r for r in scenes.product_facts(spark.createDataFrame([(1, xml), (2, xml.replace(orbits, "")), (3, None), (4, xml.replace(">101<", "> <"))], "k int, xml string")).collect()}
    assert rows[1].width == 101 and rows[1].slant_range_m == pytest.approx(0.0053 * 299_792_458 / 2) and rows[1].r_over_v_s == pytest.approx(rows[1].slant_range_m / 6000)
    assert (rows[2].platform_speed_ms, rows[2].r_over_v_s) == (None, None) and rows[2].slant_range_m == rows[1].slant_range_m
    assert all(rows[3][c] is None for c in scenes.product_facts(spark.createDataFrame([], "xml string")).columns) and rows[4].width is None and rows[4].slant_range_m is None
    got = formats.product_facts(spark, small)
    assert {"product_type", "start_us", "end_us", "heading", "range_spacing_m", "azimuth_spacing_m", "slant_range_m", "r_over_v_s"} <= set(got.columns)
    assert "xpath" not in got._jdf.queryExecution().executedPlan().toString()
