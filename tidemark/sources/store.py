"""A result store in generations: tracks are replaced as a whole, and a reader sees all of an update or nothing.

Below the store's folder, ``data-<generation>-<writer>`` holds what one update
wrote, in folders by track, and ``manifest/<generation>.json`` names, for every
track, the data folder that counts.  An update reads the tracks that it touches,
merges, writes a new data folder, and then creates the next manifest; creating
a file that exists fails, so of two writers one commits and the other merges
again with what the first has written.  A writer that dies leaves data that no
manifest names, or a manifest cut off, which readers pass over; ``vacuum``
deletes such data.  (A file system without exclusive creation, such as some
object stores, serves one writer at a time only.)

A manifest has a line for each track, and an update's data only those that it
touches.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.plans.merge import upsert
from tidemark.sources.staging import staged


class Conflict(RuntimeError):
    """Other writers committed first, again and again."""


class ResultStore:
    """Results under ``folder``; ``schema``: their columns, with ``track_id``; ``keys``: what makes a row the same."""

    def __init__(self, spark: SparkSession, folder: str, schema: str | StructType, keys: list[str]):
        self.spark, self.folder, self.keys = spark, folder.rstrip("/"), keys
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        if "track_id" not in self.schema.names or not set(keys) <= set(self.schema.names):
            raise ValueError("a store needs track_id and its keys among the columns")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self, name: str) -> list[str]:
        system, path = self._path(name)
        return [s.getPath().getName() for s in system.listStatus(path)] if system.exists(path) else []

    def generations(self) -> list[int]:
        """The numbers that manifests have taken, whether whole or cut off."""
        return sorted(int(n.removesuffix(".json")) for n in self._names("manifest") if n.endswith(".json") and n[:-5].isdigit())

    def _manifest(self, generation: int) -> dict | None:
        """What a manifest holds (tracks, base: the generation that it goes on from), None if it is cut off."""
        system, path = self._path(f"manifest/{generation}.json")
        stream = system.open(path)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            held = json.loads(text)
            return held if held.get("whole") else None
        except ValueError:
            return None

    def latest(self) -> tuple[int, dict[str, str]]:
        """The newest whole generation (0: none) and the data folder of each track."""
        for generation in reversed(self.generations()):
            held = self._manifest(generation)
            if held is not None:
                return generation, held["tracks"]
        return 0, {}

    def _table(self, tracks: dict[str, str]) -> DataFrame:
        paths = [f"{self.folder}/{data}/track={name}" for name, data in sorted(tracks.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, generation: int | None = None) -> DataFrame:
        """The results as of the newest generation, or of an earlier one."""
        if generation is None:
            return self._table(self.latest()[1])
        held = self._manifest(generation) if generation else {"tracks": {}}
        if held is None:
            raise ValueError(f"generation {generation} was never finished")
        return self._table(held["tracks"])

    def update(self, fresh: DataFrame, attempts: int = 5) -> int:
        """Merge ``fresh`` into the store, the fresh row where a key is in both; returns the new generation.

        Rows without a track are refused.  Only tracks of ``fresh`` are read or written.
        """
        fresh = staged(fresh.select(*[F.col(c).cast(self.schema[c].dataType).alias(c) for c in self.schema.names]))
        if not fresh.where("track_id IS NULL").isEmpty():
            raise ValueError("rows without track_id")
        touched = {r.track_id: self._folder_name(r.track_id) for r in fresh.select("track_id").distinct().collect()}
        if not touched:
            return self.latest()[0]
        for _ in range(attempts):
            generation, tracks = self.latest()
            before = {name: tracks[name] for name in touched.values() if name in tracks}
            data = f"data-{generation + 1}-{uuid.uuid4().hex[:12]}"
            merged = upsert(self._table(before), fresh, self.keys).select(*self.schema.names)
            # ``track`` names the folder; track_id stays in the files.
            names = F.create_map(*[F.lit(x) for pair in touched.items() for x in pair])
            merged.withColumn("track", names[F.col("track_id")]).repartition("track").write.partitionBy("track").parquet(f"{self.folder}/{data}")
            number = self._commit(generation, tracks | {name: data for name in touched.values()})
            if number:
                return number
            system, path = self._path(data)
            system.delete(path, True)
        raise Conflict(f"{attempts} updates of {self.folder} were overtaken")

    @staticmethod
    def _folder_name(track: str) -> str:
        """The track as a folder's name: letters, digits and hyphens as they are, all else by code."""
        return "".join(c if c.isascii() and (c.isalnum() or c == "-") else f"_{ord(c):x}_" for c in track) or "_empty_"

    def _commit(self, base: int, tracks: dict[str, str]) -> int:
        """Create the next manifest; 0 if another writer has finished one that goes on from ``base`` too."""
        number = max([base, *self.generations()]) + 1
        if self.latest()[0] != base:
            return 0
        system, path = self._path(f"manifest/{number}.json")
        try:
            stream = system.create(path, False)
        except Exception as why:  # py4j wraps what the file system throws
            if "FileAlreadyExists" in str(why) or "already exists" in str(why):
                return 0
            raise
        stream.write(bytearray(json.dumps({"base": base, "tracks": tracks, "whole": True}, sort_keys=True).encode()))
        stream.close()
        # Whoever took this manifest for one cut off, before it was closed, has gone past it.
        newest = self.latest()[0]
        while newest > number:
            newest = self._manifest(newest)["base"]
        return number if newest == number else 0

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete data that none of the newest ``keep`` whole generations names, and the manifests before those; not while a writer is at work."""
        whole = [g for g in self.generations() if self._manifest(g) is not None]
        used = {data for g in whole[-keep:] for data in self._manifest(g)["tracks"].values()} if keep else set()
        gone = [n for n in self._names("") if n.startswith("data-") and n not in used]
        for name in [*gone, *[f"manifest/{g}.json" for g in whole[:-keep]]]:
            system, path = self._path(name)
            system.delete(path, True)
        return gone
