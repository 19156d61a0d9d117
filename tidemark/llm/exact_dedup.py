"""Exact dedup by deterministic block naming, in DataFrame operations only.

Texts are equal when identical after deleting space and U+0009 to U+000D.
A text is cut into blocks of a fixed number of characters.  The distinct
blocks are sorted and numbered, so that each block has an integer name; then
adjacent names are paired, the distinct pairs get integer names in turn, and
so on until one name is left of each text.  Equal final names (of texts with
equally many blocks) mean equal texts: no step trusts a hash.

Naming starts with the length and first ``FIRST`` characters of every text,
which get a name by sorting as well.  A text that has its name for itself has
its identity, and nothing more is to be told apart; those that share one go on
to the naming of their whole blocks.

Defined results: a null text counts as empty; a null ``doc_id`` loses every
tie; of rows that agree in id and length as well one stays, any one, since
they do not differ.  Columns beside id and text are carried, never read,
whatever their names.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, small, text_of

#: The characters that equality ignores, as a regular expression.
IGNORED = r"[\x20\x09-\x0D]+"
#: Code points in a block, and those that with the length give the first name.
BLOCK, FIRST = 1024, 64
#: First names (of some 100 bytes) that are broadcast at most; beyond that texts are shuffled to meet them.
BROADCAST_ROWS = 500_000


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(text_of(text), IGNORED, "")


def _start(norm: Column) -> list[Column]:
    return [F.length(norm).alias("length"), F.substring(norm, 1, FIRST).alias("start")]


def _named(keys: DataFrame) -> DataFrame:
    """Distinct keys with an integer name each: their place in the order by partition (a hash of the key), then by key.

    The shuffle that makes them distinct sorts them by that hash already; a
    range sort of long keys would send samples of them to the driver.
    """
    return keys.distinct().sortWithinPartitions(*keys.columns).withColumn("name", F.monotonically_increasing_id())


def _first_names(rows: DataFrame) -> DataFrame:
    """(length, start, n, name): the first names of ``rows`` (length, start) and how many have each."""
    counts = rows.groupBy("length", "start").agg(F.count(F.lit(1)).alias("n"))
    return counts.sortWithinPartitions("length", "start").withColumn("name", F.monotonically_increasing_id())


def _shared(scratch: Scratch, names: DataFrame) -> DataFrame:
    """(length, start) of the first names that several texts have."""
    return small(scratch.table(names.where("n > 1").select("length", "start")), BROADCAST_ROWS)


def identities(scratch: Scratch, texts: DataFrame, block: int = BLOCK) -> DataFrame:
    """(row, norm) -> (row, blocks, name): rows have equal ``blocks`` and ``name`` exactly if their texts are equal."""
    pieces = F.regexp_extract_all("norm", F.lit("(?s).{1,%d}" % block), F.lit(0))
    cut = texts.select("row", F.when(F.length("norm") > 0, pieces).otherwise(F.array(F.lit(""))).alias("pieces"))
    cut = scratch.table(cut.select("row", F.size("pieces").alias("blocks"), F.posexplode("pieces").alias("pos", "piece")))
    names = scratch.table(_named(cut.select("piece")))
    level = scratch.table(cut.join(names, "piece").select("row", "blocks", "pos", "name"))
    most = level.agg(F.max("blocks")).first()[0] or 1
    scratch.drop(cut, names)
    done, width = [level.where("blocks = 1")], 1
    while width < most:
        pairs = (
            level.where(F.col("blocks") > width)
            .groupBy("row", "blocks", F.shiftright("pos", 1).alias("pos"))
            .agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"), F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))).alias("right"))
            .withColumn("right", F.coalesce("right", F.lit(-1)))
        )
        pairs = scratch.table(pairs)
        names = scratch.table(_named(pairs.select("left", "right")))
        level = scratch.table(pairs.join(names, ["left", "right"]).select("row", "blocks", "pos", "name"))
        scratch.drop(pairs, names)
        done.append(level.where((F.col("blocks") > width) & (F.col("blocks") <= 2 * width)))
        width *= 2
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select("row", "blocks", "name")


def _groups(scratch: Scratch, twins: DataFrame) -> DataFrame:
    """(row, doc_id, points, norm) -> one line per row: row, keep_id, group_size, kept, identity."""
    lines = twins.select("row", "doc_id", "points").join(identities(scratch, twins.select("row", "norm")), "row")
    lines = scratch.table(lines)
    # ~id turns the order of ids round without overflow; null is the smallest of all.
    best = F.max(F.struct("points", F.bitwise_not("doc_id").alias("turned"), "row")).alias("best")
    groups = scratch.table(lines.groupBy("blocks", "name").agg(F.count(F.lit(1)).alias("group_size"), best))
    return lines.join(groups, ["blocks", "name"]).select(
        "row",
        F.bitwise_not("best.turned").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.struct("blocks", "name").alias("identity"),
    )


def mark(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One line per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256 and identity, which equal texts share and no others."""
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text")).withColumn("norm", normalised())
    # What each row needs whether or not it has a twin, so that texts are read twice and not four times.
    slim = scratch.table(rows.select("doc_id", *_start(F.col("norm")), F.unhex(F.sha2("norm", 256)).alias("sha")))
    names = scratch.table(_first_names(slim))
    shared, alone = _shared(scratch, names), slim.join(names.where("n = 1"), ["length", "start"])
    alone = alone.select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
        F.struct(F.lit(0).alias("blocks"), "name").alias("identity"),
    )
    twins = rows.withColumns({"length": F.length("norm"), "start": F.substring("norm", 1, FIRST)}).join(shared, ["length", "start"], "left_semi")
    twins = scratch.table(
        twins.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.length("text").alias("points"), F.sha2("norm", 256).alias("text_sha256"), "norm")
    )
    named = twins.select("row", "doc_id", "text_sha256").join(_groups(scratch, twins), "row")
    return scratch.last(alone.unionByName(named.select("doc_id", "keep_id", "group_size", "kept", "text_sha256", "identity")))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, every column as it was."""
    scratch = Scratch(docs.sparkSession)
    own = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*own).alias("own"), normalised(text).alias("norm"))
    rows = rows.select("own", "norm", *_start(F.col("norm")))
    shared = _shared(scratch, _first_names(rows))
    alone = rows.join(shared, ["length", "start"], "left_anti").select("own.*")
    own_id, own_text = F.col("own").getField(doc_id), F.col("own").getField(text)
    twins = scratch.table(
        rows.join(shared, ["length", "start"], "left_semi").select(
            F.monotonically_increasing_id().alias("row"), own_id.cast("long").alias("doc_id"), F.length(F.coalesce(own_text, F.lit(""))).alias("points"), "norm", "own"
        )
    )
    stay = _groups(scratch, twins.drop("own")).where("kept").select("row")
    return alone.unionByName(twins.join(stay, "row", "left_semi").select("own.*"))
