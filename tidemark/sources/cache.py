"""Steps kept across runs, by what they were made of.

A step's table lies under a name that is a digest of the contents of its
inputs, its parameters and the version of the code that made it, so a later
run, in another session or on another day, finds it, and anything that changes
makes a new one.  A table is written aside and renamed when it is whole: a run
that dies leaves nothing that others would read, and of two that make the same
table one is kept.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: To be raised with every change of what a step computes.
VERSION = 1


def content(table: DataFrame) -> str:
    """A digest of a table's rows, in whatever order and partitions: count, and sums of two 64-bit hashes of each row."""
    names = sorted(table.columns)
    row = [F.col(f"`{c}`") for c in names]
    # Null is skipped by the hash, so each column also says whether it is.
    marked = [x for c in row for x in (c.isNull(), c)]
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), *marked).cast("decimal(20,0)"))
    found = table.agg(F.count(F.lit(1)).alias("n"), total(1).alias("a"), total(2).alias("b")).first()
    kinds = [(c, table.schema[c].dataType.simpleString()) for c in names]
    return hashlib.sha256(json.dumps([kinds, found.n, str(found.a), str(found.b)]).encode()).hexdigest()


class SetupCache:
    """Tables under ``folder``, which outlives the run; ``inputs``: digest of what all of them are made of."""

    def __init__(self, spark: SparkSession, folder: str, inputs: str = ""):
        self.spark, self.folder, self.inputs = spark, folder.rstrip("/"), inputs

    def of(self, *tables: DataFrame) -> SetupCache:
        """This cache for steps that are made of ``tables`` as well."""
        return SetupCache(self.spark, self.folder, hashlib.sha256(json.dumps([self.inputs, *map(content, tables)]).encode()).hexdigest())

    def name(self, step: str, made_with: dict) -> str:
        said = json.dumps([VERSION, step, self.inputs, made_with], sort_keys=True, default=str)
        return f"{step}-{hashlib.sha256(said.encode()).hexdigest()[:40]}"

    def table(self, step: str, made_with: dict, make: Callable[[], DataFrame]) -> DataFrame:
        """The table of a step: found, or made and kept."""
        to = f"{self.folder}/{self.name(step, made_with)}"
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        place = jvm.org.apache.hadoop.fs.Path(to)
        system = place.getFileSystem(conf)
        if not system.exists(place):
            aside = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/.making-{uuid.uuid4().hex}")
            make().write.parquet(aside.toString())
            system.mkdirs(place.getParent())
            # A rename onto a folder that has come meanwhile puts this one inside it or fails: either way that one counts.
            if system.exists(place) or not system.rename(aside, place):
                system.delete(aside, True)
        return self.spark.read.parquet(to)
