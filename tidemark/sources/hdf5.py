"""Granules in HDF5: listed and read by Spark, decoded in tasks where ``h5py`` is installed."""

from __future__ import annotations

import io
import importlib.util

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources import files

BEAMS = ("gt1l", "gt1r", "gt2l", "gt2r", "gt3l", "gt3r")
SEGMENTS = {"latitude": "latitude", "longitude": "longitude", "h_li": "h_li", "atl06_quality_summary": "atl06_quality_summary", "rgt": "rgt", "cycle_number": "cycle_number"}
PHOTONS = {"lat_ph": "latitude", "lon_ph": "longitude", "h_ph": "h_ph", "signal_conf_ph": "signal_conf_ph"}
#: Columns with several values a row: one for each surface type.
SEVERAL = ("signal_conf_ph",)


def _groups(spark: SparkSession, folder: str, group: str, columns: dict[str, str], needed: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    if importlib.util.find_spec("h5py") is None:
        raise ModuleNotFoundError("h5py is needed to read granules; land them as Parquet where it is not installed", name="h5py")

    def decode(path: str, content: bytes):
        import h5py

        found = False
        with h5py.File(io.BytesIO(content), "r") as granule:
            for beam in BEAMS:
                held = granule.get(f"{beam}/{group}")
                if held is None or any(c not in held for c in needed):
                    continue  # a beam without what is needed is skipped
                found, n = True, len(held[needed[0]])
                read = lambda old: [list(v) for v in held[old][:]] if old in SEVERAL else held[old][:].tolist()  # noqa: E731, B023
                yield from zip([path] * n, [beam] * n, range(n), *[read(old) if old in held else [None] * n for old in columns])
        if not found:
            raise files.Unreadable(f"no beam with {group} and {', '.join(needed)}")

    kinds = ", ".join(f"{c} array<int>" if c in SEVERAL else f"{c} double" for c in columns.values())
    listed = files.binary(spark, folder, "*.h5")
    rows, left_out = files.split(files.decoded(listed, decode, f"granule string, gt string, seq int, {kinds}"), listed)
    return rows.drop("file_path"), left_out


def load_land_ice_segments(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Segments of all granules, and the granules left out with the reason."""
    return _groups(spark, folder, "land_ice_segments", SEGMENTS, ("latitude", "longitude", "h_li"))


def load_photons(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Photons of all granules, and the granules left out with the reason."""
    return _groups(spark, folder, "heights", PHOTONS, ("lat_ph", "lon_ph", "h_ph"))


def land_ice_segments(spark: SparkSession, folder: str) -> DataFrame:
    return load_land_ice_segments(spark, folder)[0]


def photons(spark: SparkSession, folder: str) -> DataFrame:
    return load_photons(spark, folder)[0]
