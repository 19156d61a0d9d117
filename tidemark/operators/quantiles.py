"""Exact quantiles of whole columns, without a buffer of their values.

A value's bits, put in order, are a 64-bit number.  Values are counted by the
first ``BITS[0]`` of them, then, among those that share the prefix of a wanted
rank, by the next ones, until all bits of the order statistic are known: as
many passes as ``BITS`` has entries, each an aggregation by bucket that every
task combines before it sends anything.  Once no more than ``GATHER`` values
are left in question, they are fetched instead, counted by value.
"""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.staging import staged

BITS = (16, 12, 12, 12, 12)
#: Different values that are fetched at most.
GATHER = 50_000
_FLIP = 0x7FFFFFFFFFFFFFFF


def sortable(value: Column) -> Column:
    """A long that orders as the double does; both zeros are one."""
    raw = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToRawLongBits"), value.cast("double") + F.lit(0.0)).cast("long")
    return F.when(raw < 0, raw.bitwiseXOR(F.lit(_FLIP))).otherwise(raw)


def value_of(bits: int) -> float:
    """The double whose sortable long is given."""
    return struct.unpack("<d", struct.pack("<q", bits if bits >= 0 else bits ^ _FLIP))[0]


def order_statistics(long: DataFrame, wanted: dict[str, set[int]], gather: int = GATHER) -> dict[tuple[str, int], float]:
    """The values of the given ranks (from 0) of each metric; ``long``: metric, bits."""
    found, used = {}, 0
    # What is left of a rank among the values with its prefix, and how many those are.
    open_: dict[tuple[str, int], list[tuple[int, int]]] = {(m, 0): [(k, k) for k in sorted(ranks)] for m, ranks in wanted.items() if ranks}
    sizes = None
    for bits in (*BITS, 0):
        if not open_:
            break
        prefix = F.shiftright("bits", 64 - used) if used else F.lit(0).cast("long")
        among = F.lit(False)
        for metric, start in open_:
            among = among | ((F.col("metric") == metric) & (prefix == F.lit(start)))
        held = long.where(among) if used else long.where(F.col("metric").isin(*{m for m, _ in open_}))
        last = sizes is not None and sum(sizes[key] for key in open_) <= gather
        if sizes is None:
            last = held.limit(gather + 1).count() <= gather
        depth = 64 if last else used + bits
        bucket = F.shiftright("bits", 64 - depth) if depth < 64 else F.col("bits")
        counts: dict[tuple[str, int], list[tuple[int, int]]] = {}
        for r in held.groupBy("metric", prefix.alias("prefix"), bucket.alias("bucket")).count().collect():
            counts.setdefault((r.metric, r.prefix), []).append((r.bucket, r["count"]))
        below, sizes = {}, {}
        for key, ranks in open_.items():
            buckets, at, before = sorted(counts.get(key, [])), 0, 0
            for rank, left in sorted(ranks, key=lambda x: x[1]):
                while before + buckets[at][1] <= left:
                    before += buckets[at][1]
                    at += 1
                start = buckets[at][0]
                if depth == 64:
                    found[key[0], rank] = value_of(start)
                else:
                    below.setdefault((key[0], start), []).append((rank, left - before))
                    sizes[key[0], start] = buckets[at][1]
        open_, used = below, depth
    return found


def exact_quantiles(table: DataFrame, columns: dict[str, Column], probabilities: tuple[float, ...], gather: int = GATHER) -> dict[str, list[float | None]]:
    """Quantiles of each column, between neighbouring values in proportion; null and NaN take no part, a column without values has null.

    Infinities count as values; between an infinity and another value the quantile is that infinity.
    """
    each = F.array(*[F.struct(F.lit(name).alias("metric"), column.cast("double").alias("value")) for name, column in columns.items()])
    long = table.select(F.explode(each).alias("x")).select("x.*").where(F.col("value").isNotNull() & ~F.isnan("value"))
    long = staged(long.select("metric", sortable(F.col("value")).alias("bits")))
    sizes = {r.metric: r["count"] for r in long.groupBy("metric").count().collect()}
    at = {m: [p * (n - 1) for p in probabilities] for m, n in sizes.items()}
    ranks = {m: {k for x in places for k in (int(x), min(int(x) + 1, sizes[m] - 1))} for m, places in at.items()}
    held = order_statistics(long, ranks, gather)

    def between(metric: str, place: float) -> float:
        low, high = held[metric, int(place)], held[metric, min(int(place) + 1, sizes[metric] - 1)]
        part = place - int(place)
        return low if not part or low == high else high if abs(high) == float("inf") else low if abs(low) == float("inf") else (1 - part) * low + part * high

    return {m: [between(m, x) for x in at[m]] if m in at else [None] * len(probabilities) for m in columns}
