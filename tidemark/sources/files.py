"""Foreign files: Spark lists and reads them, tasks decode one file at a time, and what cannot be read gets a line with the reason."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable
from urllib.parse import unquote, urlparse

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.staging import staged

# Executors get the decoders with the tasks: they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules["tidemark.sources"])

#: Rows that a decoder hands on at a time.
CHUNK = 50_000


class Unreadable(Exception):
    """Raised by a decoder for a file that holds nothing it can give rows of."""


def binary(spark: SparkSession, folder: str, pattern: str | None = None) -> DataFrame:
    """``path`` and ``content`` of the files below a folder."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(folder).select("path", "content")


def decoded(files: DataFrame, decode: Callable[[str, bytes], Iterable[tuple]], columns: str) -> DataFrame:
    """What ``decode(path, content)`` gives for every file, as ``columns``, with ``reason``: null, or why the file failed.

    A file that fails after some of its rows gives none of them: its rows are
    held until all are there.
    """
    names = [c.strip().split()[0] for c in columns.split(",")]

    def run(batches):
        import pandas as pd

        for batch in batches:
            for path, content in zip(batch.path, batch.content):
                try:
                    rows, reason = list(decode(path, bytes(content))), None
                except Unreadable as why:
                    rows, reason = [], str(why)
                except Exception as why:  # noqa: BLE001 - whatever a damaged file makes a decoder do
                    rows, reason = [], f"{type(why).__name__}: {why}"
                if reason is not None:
                    yield pd.DataFrame([(path, *[None] * len(names), reason)], columns=["file_path", *names, "reason"])
                for k in range(0, len(rows), CHUNK):
                    frame = pd.DataFrame(rows[k : k + CHUNK], columns=names)
                    yield frame.assign(file_path=path, reason=None)[["file_path", *names, "reason"]]

    return files.mapInPandas(run, f"file_path string, {columns}, reason string")


def readable(table: DataFrame) -> DataFrame:
    """The rows of the files that could be read."""
    return table.where("reason IS NULL").drop("reason")


def split(table: DataFrame, *read: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of readable files, and (file_path, reason) of the others; the files are read once.

    ``read``: the files as listed.  Spark hands on no row for a file without a
    byte, so those are told by their absence.
    """
    held = staged(table)
    listed = [(unquote(urlparse(p).path), "empty") for some in read for p in some.inputFiles()]
    named = table.sparkSession.createDataFrame(listed, "file_path string, reason string")
    place = F.regexp_replace("file_path", "^[A-Za-z0-9+.-]+:(//[^/]*)?", "")
    seen = held.select(place.alias("file_path")).distinct()
    return readable(held), held.where("reason IS NOT NULL").select("file_path", "reason").unionByName(named.join(seen, "file_path", "left_anti"))
