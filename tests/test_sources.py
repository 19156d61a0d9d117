"""Files in and out: shapes, GeoJSON, CSV, Parquet, names; and preparation against plain loops."""

import json
import math
import struct

import pytest
from pyspark.sql import functions as F

from tidemark.functions import crs, geodesy, names, numeric
from tidemark.operators import planar, prep
from tidemark.sources import hdf5, shapefile, staging, tables, wkb


def shp(parts):
    flat = [v for p in parts for v in p]
    body = struct.pack("<i4d2i", 3, 0, 0, 0, 0, len(parts), len(flat)) + b"".join(struct.pack("<i", sum(map(len, parts[:k]))) for k in range(len(parts))) + b"".join(struct.pack("<2d", *v) for v in flat)
    return b"\0" * 100 + struct.pack(">2i", 1, len(body) // 2) + body


def dbf(rows):
    fields = [(b"longitude", b"N", 14), (b"latitude", b"N", 14), (b"h_li", b"N", 8)]
    head = b"\x03\0\0\0" + len(rows).to_bytes(4, "little") + (32 + 32 * 3 + 1).to_bytes(2, "little") + (37).to_bytes(2, "little") + b"\0" * 20
    head += b"".join(n.ljust(11, b"\0") + t + b"\0" * 4 + bytes([size]) + b"\0" * 15 for n, t, size in fields) + b"\r"
    return head + b"".join(b" " + b"".join(str(v).encode().rjust(size) for v, (_, _, size) in zip(r, fields)) for r in rows)


def test_shoreline_from_shapes_and_geojson(spark, tmp_path):
    part = [[(500_000.0, 7.0e6), (500_003.0, 7.0e6 + 4)], [(0.0, 0.0), (0.0, 1.0), (0.0, 3.0)]]
    assert shapefile.shp_parts(shp(part)) == part
    (tmp_path / "a.shp").write_bytes(shp(part))
    (tmp_path / "a.prj").write_text(UTM6)
    (tmp_path / "b.geojson").write_text(json.dumps({"features": [{"geometry": {"type": "LineString", "coordinates": [[-147, 70], [-147, 70.1]]}}, {"geometry": {"type": "MultiLineString", "coordinates": [[[-147, 71], [-147, 71.1]], [[-146, 71], [-146, 71.2]]]}}]}))
    rows = shapefile.shoreline(spark, str(tmp_path)).collect()
    assert sorted(r.len for r in rows)[:3] == [1.0, 2.0, 5.0] and len(rows) == 6 and len({r.part for r in rows}) == 5
    assert [r.cum for r in rows if r.len == 2.0] == [1.0] and all(r.len > 10_000 for r in rows if r.len > 5)


def test_beams_and_named_files(spark, tmp_path):
    (tmp_path / "ATL06_0129_gt1l_20190105.dbf").write_bytes(dbf([(-147.5, 70.1, 1.25), (-147.4, 70.2, "")]))
    (tmp_path / "other.dbf").write_bytes(dbf([(-147.5, 70.1, 1.0)]))
    (tmp_path / "empty.dbf").write_bytes(b"")
    rows = shapefile.beams(spark, str(tmp_path))
    first = rows.where("seq = 0 AND gt_family = 'gt1'").first()
    assert rows.count() == 3 and (first.track_id, str(first.acq_date), first.year, first.h_li) == ("0129", "2019-01-05", 2019, 1.25)
    named = tables.named_beams(rows, keep=["longitude", "h_li"])
    assert named.columns == ["track_id", "gt", "acq_date", "longitude", "h_li"] and named.count() == 2 and named.first().gt == "gt1l"


def test_tables_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("0129", 1, 2.5, float("nan")), ("0204", 2, None, 1.0)], "track_id string, k int, NSM double, SCE double")
    tables.write_csv(rows, str(tmp_path / "csv"))
    back = tables.csv(spark, str(tmp_path / "csv"), "track_id string, k int, NSM double, SCE double, EPR double")
    assert sorted(map(tuple, back.collect())) == [("0129", 1, 2.5, None, None), ("0204", 2, None, 1.0, None)]
    tables.write_results(rows, str(tmp_path / "results"))
    assert {tuple(r) for r in tables.parquet_folder(spark, str(tmp_path / "results")).select("k", "NSM").collect()} == {(1, 2.5), (2, None)}
    assert sorted(p.name for p in (tmp_path / "results").iterdir() if p.is_dir()) == ["track_id=0129", "track_id=0204"]
    profiles = spark.createDataFrame([("0129", "gt1l", "2019-01-05", 1.0), ("0129", "gt1r", "2019-01-05", 2.0)], "track_id string, gt string, acq_date string, h_li double")
    for part in ("gt1l", "gt1r", "gt1r"):  # a repeated write replaces its own folders only
        tables.write_profiles(profiles.where(F.col("gt") == part), str(tmp_path / "profiles"))
    assert spark.read.parquet(str(tmp_path / "profiles")).count() == 2
    photons = spark.createDataFrame([("/x/ATL03_20190105.h5", "gt1l", 1.0, [1, 2])], "granule string, gt string, h_ph double, signal_conf_ph array<int>")
    tables.write_granules(photons, str(tmp_path / "granules"))
    assert (tmp_path / "granules" / "granule=ATL03_20190105" / "gt=gt1l").is_dir()
    tables.write_query(spark, str(tmp_path / "query"), {"product": "ATL03", "box": [1, 2]})
    assert json.loads(spark.read.text(str(tmp_path / "query")).first().value) == {"product": "ATL03", "box": [1, 2]}


def test_granules_need_their_library(spark, tmp_path):
    assert hdf5.PHOTONS["signal_conf_ph"] in hdf5.SEVERAL
    if hdf5.importlib.util.find_spec("h5py") is None:
        with pytest.raises(ModuleNotFoundError):
            hdf5.photons(spark, str(tmp_path))


def test_names_take_every_branch(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    text = lambda f, *xs: [one(f(F.lit(x))) for x in xs]
    assert text(names.track_number_legacy, "ATL06_0129_gt1l", "ATL06_gt1l_129020", "a_b") == ["0129", "1290", None]
    assert text(names.reference_track, "ATL03_20190105212430_01290203_007.h5", "ATL03_0129_x.h5", "ATL03-01290203-x.h5", "ATL03-0129-x.h5", "none") == ["0129", "0129", "0129", "0129", None]
    assert text(names.granule_date, "ATL06_20190105212430_0129.h5", "x_y_20190105212430_0129", "none") == ["20190105", "20190105", None]
    assert text(names.granule_track, "ATL06_20190105212430_01290203_006.h5", "x_y_z_20190105212430_0129", "none") == ["0129", "0129", None]
    assert tuple(one(names.old_name(F.lit("processed_ATL06_20190105212430_01290203_006")))) == ("20190105", "0129")
    assert one(names.beam_file(F.lit("other_gt1l"))) is None and one(names.key_text(F.lit("  a "))) == "a"
    assert one(numeric.presented(F.lit(1.005 + 1e-9))) == pytest.approx(1.01)


def test_clipped_profiles_against_a_plain_loop(spark):
    rows = [("p", k, 70.0 + k * 0.002, -147.0, 1.0 if k != 3 else float("nan"), 0 if k != 5 else 1) for k in range(12)] + [("q", 0, 72.0, -147.0, 1.0, 0)]
    points = spark.createDataFrame(rows, "file string, seq int, latitude double, longitude double, h_li double, atl06_quality_summary int")
    spot = spark.range(1).select(geodesy.polar(F.lit(70.01), F.lit(-147.0)).alias("p")).first().p
    coast = spark.createDataFrame([(spot.x - 1000, spot.y, spot.x + 1000, spot.y)], "x0 double, y0 double, x1 double, y1 double")
    placed = points.withColumn("p", geodesy.polar(F.col("latitude"), F.col("longitude"))).collect()
    want = [r for r in placed if not math.isnan(r.h_li) and r.atl06_quality_summary == 0 and math.hypot(max(abs(r.p.x - spot.x) - 1000, 0), r.p.y - spot.y) <= 500]
    got = prep.clipped_profiles(points, coast, ["file"]).orderBy(F.desc("latitude")).collect()
    assert [r.seq for r in got] == sorted((r.seq for r in want), reverse=True) and len(got) > 2
    assert got[0].distance_m == 0 and all(b.distance_m - a.distance_m == pytest.approx(111_500 * (a.latitude - b.latitude), rel=0.01) for a, b in zip(got, got[1:]))
    old = prep.clipped_profiles(points, coast, ["file"], spherical=True).orderBy("seq").collect()
    assert old[0].distance == 0 and old[-1].distance == pytest.approx(6371_000 * math.radians(old[-1].latitude - old[0].latitude), rel=1e-6)
    assert prep.clipped_profiles(points, coast, ["file"], minimum=100).count() == 0
    whole = prep.whole_profiles(points, ["file"], ["seq"])
    assert whole.count() == 11 and whole.where("distance = 0").count() == 2


def test_long_segments_take_cells_in_proportion(spark):
    from tidemark.operators.spatial import along, within_segments

    cells = spark.range(1).select(F.size(along(*[F.lit(v) for v in (0.0, 0.0, 50_000.0, 50_000.0)], 25.0, 25.0)).alias("n")).first().n
    assert cells < 40_000  # the box of it holds four million
    points = spark.createDataFrame([(float(k), float(k) + d) for k in range(0, 5000, 250) for d in (30.0, 40.0)], "x double, y double")
    line = spark.createDataFrame([(0.0, 0.0, 5000.0, 5000.0)], "x0 double, y0 double, x1 double, y1 double")
    assert {r.y - r.x for r in within_segments(points, line, 25.0).collect()} == {30.0}


def test_staged_tables_of_a_scope_go(spark, tmp_path):
    with staging.scope() as kept:
        gone, stays = staging.staged(spark.range(3)), None
        stays = kept(gone.where("id > 0"))
    assert stays.count() == 2
    with pytest.raises(Exception):
        gone.count()


def test_measures_of_many_lines(spark):
    points = spark.createDataFrame([("gt1", "a", 0.0, 0.0), ("gt1", "a", 3.0, 4.0), ("gt1", "b", 1.0, 1.0)], "gt_family string, beam_id string, x double, y double")
    assert [(r.beam_id, r.length) for r in planar.measures(planar.beam_lines(points), ["gt_family", "beam_id"]).collect()] == [("a", 5.0)]


UTM6 = 'PROJCS["WGS 84 / UTM zone 6N",GEOGCS["WGS 84",DATUM["WGS_1984",SPHEROID["WGS 84",6378137,298.257223563]],PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433]],PROJECTION["Transverse_Mercator"],PARAMETER["latitude_of_origin",0],PARAMETER["central_meridian",-147],PARAMETER["scale_factor",0.9996],PARAMETER["false_easting",500000],PARAMETER["false_northing",0],UNIT["metre",1],AUTHORITY["EPSG","32606"]]'
UTM5 = 'PROJCRS["WGS 84 / UTM zone 5N",BASEGEOGCRS["WGS 84",DATUM["World Geodetic System 1984",ELLIPSOID["WGS 84",6378137,298.257223563,LENGTHUNIT["metre",1]]],PRIMEM["Greenwich",0,ANGLEUNIT["degree",0.0174532925199433]]],CONVERSION["UTM zone 5N",METHOD["Transverse Mercator",ID["EPSG",9807]],PARAMETER["Latitude of natural origin",0,ANGLEUNIT["degree",0.0174532925199433]],PARAMETER["Longitude of natural origin",-153,ANGLEUNIT["degree",0.0174532925199433]],PARAMETER["Scale factor at natural origin",0.9996,SCALEUNIT["unity",1]],PARAMETER["False easting",500000,LENGTHUNIT["metre",1]],PARAMETER["False northing",0,LENGTHUNIT["metre",1]]],CS[Cartesian,2],AXIS["(E)",east,ORDER[1],LENGTHUNIT["metre",1]],AXIS["(N)",north,ORDER[2],LENGTHUNIT["metre",1]]]'
POLAR = 'PROJCS["Sea ice",GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137.0,298.257223563]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]],PROJECTION["Stereographic_North_Pole"],PARAMETER["False_Easting",0.0],PARAMETER["False_Northing",0.0],PARAMETER["Central_Meridian",-45.0],PARAMETER["Standard_Parallel_1",70.0],UNIT["Meter",1.0]]'


def test_descriptions_of_systems():
    close = lambda a, b: [getattr(a, k) for k in ("kind", "south")] == [getattr(b, k) for k in ("kind", "south")] and all(
        math.isclose(getattr(a, k), getattr(b, k), abs_tol=1e-9) for k in ("central", "origin", "scale", "easting", "northing", "metre")
    )
    assert close(crs.parse(UTM6), crs.parse(32606)) and close(crs.parse(UTM5), crs.parse("EPSG:32605")) and close(crs.parse(POLAR), crs.parse("urn:ogc:def:crs:EPSG::3413"))
    assert crs.parse(POLAR).true_scale == 70.0 and crs.parse("OGC:CRS84") == crs.parse(4326) and crs.parse("32733").northing == 1e7
    feet = crs.parse(UTM6.replace('UNIT["metre",1]', 'UNIT["US survey foot",0.3048006096012192]').replace("500000", "1640416.6666666667"))
    assert feet.easting == pytest.approx(500_000) and feet.metre == 0.3048006096012192
    for bad in ('PROJCS["UTM"]', "EPSG:2154", "", 'GEOGCS["x"', 'PROJCS["x"]]', UTM6.replace("Transverse_Mercator", "Lambert_Conformal_Conic_2SP"), UTM6.replace('["Greenwich",0]', '["Paris",2.33]')):
        with pytest.raises(crs.UnknownSystem):
            crs.parse(bad)


def test_positions_in_published_systems(spark):
    at = lambda system, lat, lon: spark.range(1).select(crs.forward(system, F.lit(lat), F.lit(lon)).alias("p")).first().p
    # Worked examples of the published guidance on coordinate operations: polar stereographic by scale and by parallel.
    p = at(crs.parse(32661), 73.0, 44.0)
    assert (p.x, p.y) == (pytest.approx(3320416.75, abs=0.01), pytest.approx(632668.43, abs=0.01))
    p = at(crs.System("polar", central=70.0, true_scale=-71.0, easting=6e6, northing=6e6, south=True), -75.0, 120.0)
    assert (p.x, p.y) == (pytest.approx(7255380.79, abs=0.01), pytest.approx(7053389.56, abs=0.01))
    # Transverse Mercator with a latitude of origin, on another ellipsoid.
    p = at(crs.System("transverse", central=-2.0, origin=49.0, scale=0.9996012717, easting=400_000.0, northing=-100_000.0, ellipsoid=geodesy.Ellipsoid(6377563.396, 1 / 299.3249646)), 50.5, 0.5)
    assert (p.x, p.y) == (pytest.approx(577274.99, abs=0.01), pytest.approx(69740.50, abs=0.01))
    spots = spark.createDataFrame([(70.3, -148.9), (69.0, -150.0), (71.5, -144.2)], "lat double, lon double")
    for code in (32605, 32606, 3413, 3995, 32661, 3857, 26906):
        system = crs.parse(code)
        there = spots.withColumn("p", crs.forward(system, F.col("lat"), F.col("lon"))).withColumn("b", crs.inverse(system, F.col("p.x"), F.col("p.y")))
        assert all(max(abs(r.b.lat - r.lat), abs(r.b.lon - r.lon)) < 1e-10 for r in there.collect()), code


def test_one_shore_in_four_systems(spark, tmp_path):
    line = [(-148.9, 70.31), (-148.85, 70.33), (-148.7, 70.3)]
    spots = spark.createDataFrame(line, "lon double, lat double")
    for name, text in (("utm6", UTM6), ("utm5", UTM5), ("polar", POLAR), ("degrees", None)):
        folder = tmp_path / name
        folder.mkdir()
        system = crs.parse(text or 4326)
        drawn = [(r.p.x, r.p.y) for r in spots.select(crs.forward(system, F.col("lat"), F.col("lon")).alias("p")).collect()]
        (folder / "shore.shp").write_bytes(shp([drawn]))
        if text:
            (folder / "shore.prj").write_text(text)
    held = {name: sorted((r.x0, r.y0, r.x1, r.y1) for r in shapefile.shoreline(spark, str(tmp_path / name)).collect()) for name in ("utm6", "utm5", "polar", "degrees")}
    for name in ("utm5", "polar", "degrees"):
        assert len(held[name]) == 2 and max(abs(a - b) for s, t in zip(held["utm6"], held[name]) for a, b in zip(s, t)) < 1e-3
    together = shapefile.shoreline(spark, str(tmp_path), target=32605)
    assert together.count() == 8 and together.selectExpr("round(x0, 2)").distinct().count() == 2
    (tmp_path / "utm6" / "shore.prj").write_text('PROJCS["Somewhere"]')
    with pytest.raises(crs.UnknownSystem):
        shapefile.shoreline(spark, str(tmp_path))


def test_shores_from_binary_and_text_geometry(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    parts = [[(-148.9, 70.31), (-148.85, 70.33), (-148.7, 70.3)], [(-147.0, 70.0), (-147.0, 70.1)]]
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "shore.shp").write_bytes(shp(parts))
    key = lambda rows: sorted((r.x0, r.y0, r.x1, r.y1, r.cum) for r in rows.collect())
    want = key(shapefile.shoreline(spark, str(tmp_path / "s")))
    held = wkb.binary(5, parts)
    assert wkb.parts(held) == parts == wkb.text_parts(wkb.text(5, parts)) and wkb.parts(wkb.binary(3, parts)) == parts
    assert wkb.text_parts("MULTIPOINT ((1 2), (3 4))") == [[(1.0, 2.0)], [(3.0, 4.0)]] == wkb.text_parts("MULTIPOINT (1 2, 3 4)") and wkb.text_parts("POINT EMPTY") == []
    raised = struct.pack(">BII", 0, 0xA0000002, 4326) + struct.pack(">I6d", 2, 1, 2, 9, 3, 4, 9)  # other byte order, a height and an identifier
    assert wkb.parts(raised) == [[(1.0, 2.0), (3.0, 4.0)]] and wkb.parts(struct.pack("<BI2d", 1, 1, math.nan, math.nan)) == []
    for bad in (held[:-1], held + b"x", b"", b"\x02" + held[1:], struct.pack("<BII", 1, 2, 2**31)):
        with pytest.raises(wkb.Damaged):
            wkb.parts(bad)
    table = spark.createDataFrame([(held, wkb.text(5, parts)), (b"rubbish", "LINESTRING (1 x)"), (None, None)], "g binary, t string")
    assert key(shapefile.shoreline_of(table, "g")) == want == key(shapefile.shoreline_of(table, "t"))
    geo = {"version": "1.0.0", "primary_column": "geometry", "columns": {"geometry": {"encoding": "WKB", "geometry_types": [], "crs": {"id": {"authority": "EPSG", "code": 4326}}}}}
    rows = pa.table({"geometry": pa.array([held], type=pa.binary())})
    pq.write_table(rows.replace_schema_metadata({"geo": json.dumps(geo)}), tmp_path / "shore.parquet")
    assert shapefile.geoparquet_system(spark, str(tmp_path / "shore.parquet")) == ("geometry", "EPSG:4326")
    assert key(shapefile.shoreline_geoparquet(spark, str(tmp_path / "shore.parquet"))) == want


def test_unreadable_files_are_named(spark, tmp_path):
    good = dbf([(-147.5, 70.1, 1.25), (-147.4, 70.2, 2.0)])
    for name, content in (("a_gt1l_20190105", good), ("cut", good[:-20]), ("empty", b""), ("head", good[:20])):
        (tmp_path / f"{name}.dbf").write_bytes(content)
    rows, left_out = shapefile.load_beams(spark, str(tmp_path))
    why = {r.file_path.rsplit("/", 1)[1]: r.reason for r in left_out.collect()}
    assert rows.count() == 2 and why == {"cut.dbf": "cut off after 1 of 2 rows", "empty.dbf": "empty", "head.dbf": "cut off within the head"}
    whole = shp([[(0.0, 0.0), (0.0, 1.0)]])
    for name, content in (("good.shp", whole), ("cut.shp", whole[:-8]), ("none.shp", b""), ("bad.geojson", b'{"features": ['), ("point.geojson", b'{"type": "Point", "coordinates": [1, 2]}')):
        (tmp_path / name).write_bytes(content)
    rows, left_out = shapefile.load_shoreline(spark, str(tmp_path))
    why = {r.file_path.rsplit("/", 1)[1]: r.reason for r in left_out.collect()}
    assert rows.count() == 1 and set(why) == {"cut.shp", "none.shp", "bad.geojson", "point.geojson"} and why["bad.geojson"].startswith("JSONDecodeError")
