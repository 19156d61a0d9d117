"""Point shapefiles, and shores from shapefiles, GeoJSON, Parquet with binary geometry and CSV with text.

Positions of beams come from the longitude and latitude attributes, as they do
when such files are reloaded, so only the ``.dbf`` is needed.  Coordinates of
shores are in the system that their ``.prj``, ``crs`` member or ``geo`` entry
names; a system that is not known is refused.  Everything ends in the plane
of ``target``.  A file that is empty, damaged or without the attributes is left
out, with the reason in the second table of the ``load_`` functions.
"""

from __future__ import annotations

import json
import struct

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import crs, names
from tidemark.functions.numeric import finite
from tidemark.operators.planar import segments
from tidemark.params import Params
from tidemark.sources import files, wkb

#: Different systems in one folder; each is parsed once, on the driver.
SYSTEMS = 100


def dbf_rows(content: bytes) -> list[dict]:
    """Rows of a dBase III table; deleted ones are left out, blank numbers are null."""
    if len(content) < 32:
        raise files.Unreadable("empty" if not content else "cut off within the head")
    count, head, width = struct.unpack("<IHH", content[4:12])
    fields, at = [], 32
    while at + 32 <= head and content[at] != 0x0D:
        name = content[at : at + 11].split(b"\0")[0].decode("ascii", "replace")
        fields.append((name, chr(content[at + 11]), content[at + 16]))
        at += 32
    rows = []
    for k in range(count):
        record, place, row = content[head + k * width : head + (k + 1) * width], 1, {}
        if len(record) < width:
            raise files.Unreadable(f"cut off after {k} of {count} rows")
        if record[:1] == b"*":
            continue
        for name, kind, size in fields:
            raw = record[place : place + size].decode("utf-8", "replace").strip(" \0")
            place += size
            try:
                row[name] = (float(raw) if raw else None) if kind in "NF" else raw
            except ValueError:
                row[name] = None
        rows.append(row)
    return rows


def shp_parts(content: bytes) -> list[list[tuple[float, float]]]:
    """The vertices of every part of the lines and polygons of a ``.shp``, and every point as a part of its own."""
    if len(content) < 100:
        raise files.Unreadable("empty" if not content else "cut off within the head")
    out, at = [], 100
    while at < len(content):
        if at + 12 > len(content):
            raise files.Unreadable(f"cut off at byte {at}")
        (words,) = struct.unpack(">i", content[at + 4 : at + 8])
        if words < 2 or at + 8 + 2 * words > len(content):
            raise files.Unreadable(f"cut off at byte {at}")
        record = content[at + 8 : at + 8 + 2 * words]
        at += 8 + 2 * words
        kind = struct.unpack("<i", record[:4])[0] % 10 if len(record) >= 4 else 0
        if kind == 1:
            out.append([struct.unpack("<2d", record[4:20])])
        elif kind in (3, 5):
            parts, count = struct.unpack("<2i", record[36:44])
            starts = [*struct.unpack(f"<{parts}i", record[44 : 44 + 4 * parts]), count]
            flat = struct.unpack(f"<{2 * count}d", record[44 + 4 * parts : 44 + 4 * parts + 16 * count])
            out += [list(zip(flat[2 * a : 2 * b : 2], flat[2 * a + 1 : 2 * b : 2])) for a, b in zip(starts, starts[1:])]
    return out


def _systems(named: DataFrame, default: str) -> dict[str | None, crs.System]:
    """The systems that ``system`` names in a table, by its text; null stands for the default."""
    texts = [r.system for r in named.select("system").where("system IS NOT NULL").distinct().limit(SYSTEMS + 1).collect()]
    if len(texts) > SYSTEMS:
        raise crs.UnknownSystem(f"more than {SYSTEMS} different systems below one folder")
    return {None: crs.parse(default)} | {t: crs.parse(t) for t in texts}


def placed(table: DataFrame, systems: dict[str | None, crs.System], target: crs.System, a: str = "a", b: str = "b") -> Column:
    """struct(x, y) in ``target`` of the positions (a, b), each in the system of its row."""
    default = crs.transform(systems[None], target, F.col(a), F.col(b))
    others = [(text, system) for text, system in systems.items() if text is not None and system != systems[None]]
    if not others:
        return default
    out = F
    for text, system in others:
        out = out.when(F.col("system") == text, crs.transform(system, target, F.col(a), F.col(b)))
    return out.otherwise(default)


_VERTICES = "part int, seq int, a double, b double"


def _vertices(parts: list) -> list[tuple]:
    return [(k, n, float(a), float(b)) for k, part in enumerate(parts) for n, (a, b) in enumerate(part)]


def _shape(path: str, content: bytes):
    found = _vertices(shp_parts(content))
    if not found:
        raise files.Unreadable("no lines")
    return found


def _geojson(path: str, content: bytes):
    held = json.loads(content)
    parts = []

    def geometry(g: dict) -> None:
        kind, at = g.get("type"), g.get("coordinates")
        if kind == "LineString":
            parts.append([v[:2] for v in at])
        elif kind in ("MultiLineString", "Polygon"):
            parts.extend([v[:2] for v in line] for line in at)
        elif kind == "MultiPolygon":
            parts.extend([v[:2] for v in ring] for area in at for ring in area)
        elif kind == "GeometryCollection":
            for inner in g["geometries"]:
                geometry(inner)

    for one in held["features"] if "features" in held else [held]:
        geometry(one.get("geometry") or {} if "features" in held or one.get("type") == "Feature" else one)
    if not parts:
        raise files.Unreadable("no lines")
    return _vertices(parts)


def load_shoreline(spark: SparkSession, path: str, default: str = Params.original_crs, target: int | str = Params.utm_epsg) -> tuple[DataFrame, DataFrame]:
    """The shore's segments (part, seg, x0, y0, x1, y1, len, cum) from ``.shp`` or ``.geojson`` files under ``path``, and the files left out.

    A ``.prj`` beside a ``.shp``, or the ``crs`` member, names the system;
    without one it is the default.
    """
    held = files.binary(spark, path)
    of = lambda kind: held.where(F.lower("path").endswith(kind))
    stem = lambda c: F.regexp_replace(c, r"\.[^.]*$", "")
    known = of(".prj").select(stem(F.col("path")).alias("stem"), F.trim(F.col("content").cast("string")).alias("system"))
    member = F.from_json(F.col("content").cast("string"), "crs struct<properties:struct<name:string>>")["crs"]["properties"]["name"]
    known = known.unionByName(of(".geojson").select(stem(F.col("path")).alias("stem"), member.alias("system"))).where("system IS NOT NULL")
    drawn = files.decoded(of(".shp"), _shape, _VERTICES).unionByName(files.decoded(of(".geojson"), _geojson, _VERTICES))
    rows, left_out = files.split(drawn, files.binary(spark, path, "*.{shp,geojson}"))
    rows = rows.withColumn("stem", stem(F.col("file_path"))).join(known, "stem", "left")
    return _segments(rows, _systems(known, default), crs.parse(target)), left_out


def _segments(rows: DataFrame, systems: dict, target: crs.System) -> DataFrame:
    flat = rows.select(F.xxhash64("file_path", "part").alias("part"), "seq", placed(rows, systems, target).alias("p"))
    return segments(flat.select("part", "seq", "p.x", "p.y"), ["part"], ["seq"])


def shoreline(spark: SparkSession, path: str, default: str = Params.original_crs, target: int | str = Params.utm_epsg) -> DataFrame:
    """``load_shoreline`` without the table of files left out."""
    return load_shoreline(spark, path, default, target)[0]


def shoreline_of(table: DataFrame, geometry: str, system: str = Params.original_crs, target: int | str = Params.utm_epsg) -> DataFrame:
    """A shore's segments from a column of well-known binary or text; a damaged or null geometry gives none."""
    is_text = table.schema[geometry].dataType.simpleString() == "string"
    lines = table.select(F.col(geometry).alias("g")).where("g IS NOT NULL").distinct().select(F.sha2(F.col("g").cast("binary"), 256).alias("file_path"), "g")

    def run(batches):
        import pandas as pd

        for batch in batches:
            for name, g in zip(batch.file_path, batch.g):
                try:
                    found = _vertices(wkb.text_parts(g) if is_text else wkb.parts(bytes(g)))
                except wkb.Damaged:
                    continue
                yield pd.DataFrame([(name, *v) for v in found], columns=["file_path", "part", "seq", "a", "b"])

    rows = lines.mapInPandas(run, f"file_path string, {_VERTICES}")
    return _segments(rows, {None: crs.parse(system)}, crs.parse(target))


def geoparquet_system(spark: SparkSession, path: str) -> tuple[str, str]:
    """The geometry column of a GeoParquet file or folder and its system, from the ``geo`` entry of its first file."""
    first = spark.read.parquet(path).inputFiles()[0]
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    opened = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(first), conf))
    try:
        entry = opened.getFooter().getFileMetaData().getKeyValueMetaData().get("geo")
    finally:
        opened.close()
    if entry is None:
        raise crs.UnknownSystem(f"no geo entry in {first}")
    geo = json.loads(entry)
    column = geo["primary_column"]
    held = geo["columns"][column].get("crs", {"id": {"authority": "OGC", "code": "CRS84"}})
    if not held or "id" not in held:
        raise crs.UnknownSystem(f"system of {column} without an identifier")
    return column, f"{held['id']['authority']}:{held['id']['code']}"


def shoreline_geoparquet(spark: SparkSession, path: str, target: int | str = Params.utm_epsg) -> DataFrame:
    """A shore's segments from GeoParquet with binary geometry."""
    column, system = geoparquet_system(spark, path)
    return shoreline_of(spark.read.parquet(path), column, system, target)


def load_beams(
    spark: SparkSession, folder: str, pattern: str = "*.dbf", lon: str = "longitude", lat: str = "latitude", height: str = "h_li", original: str = Params.original_crs, target: int | str = Params.utm_epsg
) -> tuple[DataFrame, DataFrame]:
    """Points of all files, and the files left out: position in degrees and in the plane, height, and what the file's name says."""

    def decode(path: str, content: bytes):
        rows = dbf_rows(content)
        if not rows or lon not in rows[0] or lat not in rows[0]:
            raise files.Unreadable(f"without {lon} and {lat}" if rows else "no rows")
        return [(k, r.get(lon), r.get(lat), r.get(height)) for k, r in enumerate(rows)]

    listed = files.binary(spark, folder, pattern)
    points, left_out = files.split(files.decoded(listed, decode, "seq int, longitude double, latitude double, h_li double"), listed)
    points = points.withColumns({c: finite(F.col(c)) for c in ("longitude", "latitude", "h_li")}).dropna(subset=["longitude", "latitude"])
    stem = names.stem(F.col("file_path"))
    tagged = points.withColumns({"beam_id": stem, "gt_family": names.family(stem), "track_id": names.track_number_legacy(stem), "acq_date": names.acquisition_date(stem)})
    place = crs.transform(crs.parse(original), crs.parse(target), F.col("longitude"), F.col("latitude"))
    return tagged.withColumn("year", F.year("acq_date")).withColumn("p", place).withColumns({"x": F.col("p.x"), "y": F.col("p.y")}).drop("p"), left_out


def beams(spark: SparkSession, folder: str, pattern: str = "*.dbf", **named) -> DataFrame:
    """``load_beams`` without the table of files left out."""
    return load_beams(spark, folder, pattern, **named)[0]
