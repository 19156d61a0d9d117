"""From raw documents to packed training bins, in five stages.

Each stage takes all rows that the one before it kept.  Toxic documents go,
then copies, then near copies; secrets are blanked out in the texts that hold
them (those documents stay); what is left is packed into bins.

All but the last return the columns that they were given, whatever their
names; extra columns are carried and never read.  Null texts count as empty,
ids may be null, and an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, ngram_join, packing, secrets
from tidemark.llm import toxicity as toxic
from tidemark.llm.common import Scratch, free_name, read, tidied

TOXIC = 0.7


def _carried(docs: DataFrame) -> tuple[DataFrame, str, dict]:
    """``docs`` with all its columns once more in one struct, the struct's name, and each column as it was."""
    own = free_name(docs, "own")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(own), "text")
    return whole, own, {c: F.col(own).getField(c).alias(c) for c in docs.columns}


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below ``TOXIC``.

    Null and empty texts have the base score and stay; repeated rows have one
    score and stay or go together; a score of ``TOXIC`` itself goes.  Labels of
    documents that are not there are not used.
    """
    model = toxic.fit(docs, read(spark, sf_dir, "labels"))
    whole, own, columns = _carried(docs)
    return toxic.assess(whole, model, keep=[own]).where(F.col("toxicity") < TOXIC).select(*columns.values())


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of equal texts: the one with the most characters, then the smallest id.

    Null and empty texts are one group; a null id loses every tie; of rows that
    agree in both any one stays.
    """
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each class of near copies: the one with the smallest id, then text digest.

    Texts without a word have no near copy and all stay; repeated rows are near
    copies of each other.
    """
    return ngram_join.keep_first(docs)


def secret(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with ``[SECRET]`` in place of every secret and ``n_chars``, where there is such a column, as it is then.

    Null and empty texts stay as they are; repeated rows are treated alike.
    """
    whole, own, columns = _carried(docs)
    clean = secrets.scan(whole, secrets.fit(docs), keep=[own], redact="[SECRET]")
    columns["text"] = F.col("text")
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        found = F.exists("findings", lambda f: f.secret)
        columns["n_chars"] = F.when(found, F.length("text").cast(kind)).otherwise(F.col(own).getField("n_chars")).alias("n_chars")
    return clean.select(*columns.values())


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins: one line per piece of a document.

    Null and empty texts take a place and no room; ties in size go by id;
    repeated rows never share a bin.
    """
    return packing.pack(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact), ("ngram_join", near), ("secrets", secret), ("packing", pack)]
#: Scores and bins are beyond SQL; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written to the shared folder and read again; what is no longer read is deleted."""
    scratch, docs = Scratch(spark), read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before = docs
        with tidied():
            docs = scratch.table(stage(spark, docs, sf_dir))
        if before is not docs and hasattr(before, "scratch_path"):
            scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
