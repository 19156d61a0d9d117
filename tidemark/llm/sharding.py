"""Sharding by a minimax contiguous partition.

Documents stand in the order of a digest of their text, so equal texts stand
together: the atomic groups of the partition.  Their sizes are summed by the
digest's first ``ATOM_BITS`` bits, at most 65,536 sums however large the
corpus, and only where a cut may fall are those split, ``STEP`` bits at a time,
down to single groups: the sums in the windows of the cuts are all that
reaches the driver besides.  A binary search finds the smallest capacity for
which greedy filling of contiguous shards succeeds, and the cuts go there: no
shard exceeds that capacity, which is the least for the groups themselves, and
as far as it allows each shard takes its even share of what is left, so one
heavy group does not leave shards empty.

The law is ``bytes``: sizes near equal.  A group of copies that outweighs a
shard sets the capacity.

Slots number the rows of a shard from 0 without gaps.  Rows are range-sorted;
each sorted partition knows from the (few) counts of those before it where its
numbers begin, so no task sees a whole shard.

Defined results: a null text has no bytes and size 1, and belongs with the
empty texts; null ids sort first; repeated rows get a slot each; an empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, text_of

ATOM_BITS, STEP = 16, 8


def feasible(ends: np.ndarray, capacity: int, shards: int, start: int = 0) -> bool:
    """Whether greedy filling from atom ``start`` needs ``shards`` shards at most; ``ends``: prefix sums from 0."""
    at = start
    for _ in range(shards):
        if at == len(ends) - 1:
            return True
        stop = int(np.searchsorted(ends, ends[at] + capacity, "right")) - 1
        if stop == at:
            return False
        at = stop
    return at == len(ends) - 1


def smallest_capacity(sizes: np.ndarray, shards: int) -> int:
    """The least capacity with which contiguous runs of ``sizes`` fill ``shards`` shards at most."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    low, high = max(int(sizes.max(initial=0)), -(-int(ends[-1]) // shards)), int(ends[-1])
    while low < high:
        middle = (low + high) // 2
        if feasible(ends, middle, shards):
            high = middle
        else:
            low = middle + 1
    return low


def cuts(sizes: np.ndarray, shards: int) -> list[int]:
    """First atom of shards 1 to ``shards - 1``: none exceeds the smallest capacity, each near its even share."""
    capacity, out, at = smallest_capacity(sizes, shards), [], 0
    ends = np.concatenate([[0], np.cumsum(sizes)])
    for left in range(shards - 1, 0, -1):
        share = (int(ends[-1]) - int(ends[at])) / (left + 1)
        most = int(np.searchsorted(ends, ends[at] + capacity, "right")) - 1
        near = int(np.searchsorted(ends, ends[at] + share, "left"))
        if near > at + 1 and share - (ends[near - 1] - ends[at]) < ends[min(near, len(ends) - 1)] - ends[at] - share:
            near -= 1
        stop = min(near, most)
        at = stop if feasible(ends, capacity, left, stop) else most
        out.append(at)
    return out


def to_split(sizes: np.ndarray, single: np.ndarray, shards: int) -> list[int]:
    """The atoms that must be split before the smallest capacity is that of the groups; ``single``: whether an atom is one group.

    The capacity lies between an even share (or the largest group) and what the
    atoms allow.  Greedy filling of groups with any capacity between puts its
    ``k``-th cut behind where filling of atoms with the lower one does and
    before ``k`` times the upper one: only atoms there matter.
    """
    total = int(sizes.sum())
    low = max(-(-total // shards), int(sizes[single].max(initial=0)))
    heavy = np.flatnonzero(~single & (sizes > low))
    if len(heavy):
        return heavy.tolist()
    high, ends, at, out = smallest_capacity(sizes, shards), np.concatenate([[0], np.cumsum(sizes)]), 0, set()
    if high == low:
        return []
    for k in range(1, shards):
        at = int(np.searchsorted(ends, ends[at] + low, "right")) - 1
        last = int(np.searchsorted(ends, min(k * high, total), "left"))
        out.update(range(at, min(last, len(sizes))))
    return sorted(k for k in out if not single[k])


def atoms(slim: DataFrame, shards: int) -> tuple[list[int], np.ndarray]:
    """First digests and sizes of contiguous atoms of ``slim`` (digest, size), fine enough for the cuts."""

    def sums(rows: DataFrame, bits: int) -> list[tuple[int, int, int, bool]]:
        atom = F.shiftright("digest", 64 - bits)
        found = rows.groupBy(atom.alias("atom")).agg(F.sum("size").alias("size"), (F.min("digest") == F.max("digest")).alias("single")).collect()
        return [(r.atom << (64 - bits), bits, r["size"], r.single) for r in found]

    held = sorted(sums(slim, ATOM_BITS))
    while held:
        sizes, single = np.array([h[2] for h in held], dtype=np.int64), np.array([h[3] for h in held])
        split = to_split(sizes, single, shards)
        if not split:
            return [h[0] for h in held], sizes
        gone, fresh = set(split), []
        for bits in {held[k][1] for k in split}:
            own = [held[k][0] >> (64 - bits) for k in split if held[k][1] == bits]
            fresh += sums(slim.where(F.shiftright("digest", 64 - bits).isin(own)), min(64, bits + STEP))
        held = sorted([h for k, h in enumerate(held) if k not in gone] + fresh)
    return [], np.zeros(0, dtype=np.int64)


def size_of(text: str = "text") -> Column:
    return (F.octet_length(text_of(text)) + 1).cast("long")


def assign(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = 16) -> DataFrame:
    """One line per row: doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law)."""
    scratch = Scratch(docs.sparkSession)
    digest = F.xxhash64(text_of(text))
    slim = scratch.table(
        docs.select(F.col(doc_id).cast("long").alias("doc_id"), size_of(text).alias("size"), F.crc32(text_of(text)).alias("text_crc32"), digest.alias("digest"))
        .withColumn("row", F.monotonically_increasing_id())
    )
    firsts, sizes = atoms(slim, shards)
    starts = [firsts[k] for k in cuts(sizes, shards) if k < len(firsts)] if firsts else []
    shard = sum((F.when(F.col("digest") >= F.lit(k).cast("bigint"), 1).otherwise(0) for k in starts), F.lit(0))
    order = ["digest", "doc_id", "row"]
    placed = slim.withColumn("shard", shard.cast("int")).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = scratch.table(placed.select("doc_id", "size", "text_crc32", "shard", F.monotonically_increasing_id().alias("at")))
    # One row for each sorted partition and shard that it meets: as many as partitions and shards together.
    part = F.shiftright("at", 33).alias("part")
    runs = placed.groupBy("shard", part).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("shard", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return placed.withColumn("part", F.shiftright("at", 33)).join(F.broadcast(runs), ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("base") + F.col("at") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
