"""Conflict-constrained best-fit packing.

Documents go into bins of a fixed capacity (bytes of text).  A bin holds at
most one document of a source and one of a cluster of equal texts; it carries
both as bitmaps.  Bins are ordered by what is left in them: the search starts
at the tightest bin that has room and goes on to its successors until one is
compatible; else a new bin opens.  Documents come in order of falling size.
A document over the capacity is cut: its full pieces have bins of their own,
and the rest is packed like others.

Documents are dealt by a digest of id, text and place in the input to blocks
of about ``BLOCK`` rows, however often a row is repeated, and each block is
packed by itself, so sources are mixed evenly, a block fits in a task at any
size of the corpus, and at most one bin a block stays open for want of
documents.

Defined results: a null text is empty; an empty text takes a bin's place but
no room.  Rows without a source conflict with no source.  Null ids and
repeated rows are packed like others (repeated rows are one cluster, so never
in one bin).  An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_of
from tidemark.llm.exact_dedup import normalised

CAPACITY, BLOCK = 8192, 4096


def best_fit(items: list[tuple[int, object, object]], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each (size, source, cluster), sizes at most ``capacity``, in the order given."""
    source_bit: dict = {}
    cluster_bit: dict = {}
    bins: list[tuple[int, int]] = []  # (left, number), ascending
    sources, clusters, out = [], [], []
    for size, source, cluster in items:
        s = 1 << source_bit.setdefault(source, len(source_bit)) if source is not None else 0
        c = 1 << cluster_bit.setdefault(cluster, len(cluster_bit))
        for at in range(bisect_left(bins, (size, -1)), len(bins)):
            left, number = bins[at]
            if not (sources[number] & s or clusters[number] & c):
                del bins[at]
                break
        else:
            left, number = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        sources[number] |= s
        clusters[number] |= c
        insort(bins, (left - size, number))
        out.append((number, capacity - left))
    return out


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """One line per piece: bin, doc_id, piece, start (in the text) and size in bytes, offset in the bin."""
    blocks = max(1, -(-docs.count() // block))
    slim = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.octet_length(text_of(text)).cast("long").alias("size"), F.col(source).cast("string").alias("source"), F.xxhash64(normalised(text)).alias("cluster")
    ).withColumn("block", F.pmod(F.xxhash64("doc_id", "cluster", F.monotonically_increasing_id()), F.lit(blocks)))

    def packed(rows):
        import pandas as pd

        # Ids may be null: they come as floats then, and are ordered as they are.
        rows = rows.sort_values(["size", "doc_id", "cluster", "source"], ascending=[False, True, True, True], na_position="first", kind="stable")
        base, out, full, items = int(rows.block.iloc[0]) << 32, [], 0, []
        whole = rows["size"].to_numpy() // capacity
        rest = rows["size"].to_numpy() % capacity
        order = sorted(range(len(rows)), key=lambda k: -rest[k])
        ids = [None if pd.isna(x) else int(x) for x in rows.doc_id]
        for k in order:
            for piece in range(whole[k]):
                out.append((base + full, ids[k], piece, piece * capacity, capacity, 0))
                full += 1
            if rest[k] or not whole[k]:
                items.append(k)
        sources, clusters = rows.source.tolist(), rows.cluster.tolist()
        for k, (number, offset) in zip(items, best_fit([(int(rest[k]), sources[k], clusters[k]) for k in items], capacity)):
            out.append((base + full + number, ids[k], int(whole[k]), int(whole[k]) * capacity, int(rest[k]), offset))
        made = pd.DataFrame(out, columns=["bin", "doc_id", "piece", "start", "size", "offset"])
        return made.astype({"doc_id": "Int64"})

    return slim.groupBy("block").applyInPandas(packed, "bin long, doc_id long, piece long, start long, size long, offset long")
