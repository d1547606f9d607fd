"""A training-text pipeline of five stages, each written as Parquet and read again.

Each stage takes and returns the columns of ``documents`` in their order; further columns pass through,
whatever their names, also names that the operators use themselves.  Rows are treated as rows: ids may be
null or repeated.  An empty table passes through all stages as an empty table.

ORACLE_SQL is None: language identification and packing can't be expressed in SQL; the tests hold
each stage, and the whole, against a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grafwerk.llm import decontam, jaccard, langid, linededup, packing
from grafwerk.llm.common import Scratch, load, spread_join, store

#: Near duplicates: words of a shingle, and the least similarity as a fraction.
SHINGLE_WORDS, SIMILARITY = 5, (80, 100)
#: Keys of removed rows that are broadcast (8 bytes each, and their hash table); with more, the texts are shuffled.
BROADCAST_REMOVED = 1_000_000

#: The columns that operators read; all others are carried in one struct, where no name can clash.
READ = ("doc_id", "text", "lang", "source")


def _slim(docs: DataFrame) -> DataFrame:
    others = [c for c in docs.columns if c not in READ]
    return docs.select(*[c for c in READ if c in docs.columns], *([F.struct(*others).alias("rest")] if others else []))


def _whole(slim: DataFrame, docs: DataFrame) -> DataFrame:
    return slim.select(*[c if c in READ else F.col("rest").getField(c).alias(c) for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the rejected ones (null, empty or without letters among them) go.
    Repeated rows share their fate."""
    return _whole(langid.identify(_slim(docs)).where(~F.col("rejected")), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept text of each document, and its length where there is a column ``n_chars``.  A null text is an
    empty one from here on; a document all of whose lines go stays, empty; rows that share an id count as one document."""
    kept = _whole(linededup.dedup_lines(_slim(docs)), docs)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked texts: the one with the smallest id (a null id is the largest), of several
    with that id any one.  Texts without words are linked with nothing, so all such rows stay, repeated ones too."""
    slim = _slim(docs)
    with Scratch(spark, "near-rows") as scratch:
        ids = slim.agg(F.count("*").alias("rows"), F.count_distinct("doc_id").alias("ids")).first()
        if ids["rows"] == ids["ids"] and isinstance(docs.schema["doc_id"].dataType, T.IntegralType):  # the ids name the rows
            rows = slim.withColumn("row", F.col("doc_id"))
        else:
            rows = scratch.store(slim.withColumn("row", F.monotonically_increasing_id()))
        groups = jaccard.components(rows.select(F.col("row").alias("doc_id"), "text"), SHINGLE_WORDS, SIMILARITY)
        named = scratch.store(groups.select(F.col("doc_id").alias("row"), "component_id").join(rows.select("row", "doc_id"), "row"))
        least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("least")
        shared = scratch.store(named.groupBy("component_id").agg(least, F.count("*").alias("held")).where("held > 1").select("component_id", F.col("least.row").alias("kept")))
        removed = scratch.store(spread_join(named, shared, "component_id").where("row <> kept").select("row"))
        if removed.count() <= BROADCAST_REMOVED:
            removed = F.broadcast(removed)
        return store(_whole(rows.join(removed, "row", "left_anti"), docs), "near-kept")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item; a null or empty text holds none, and repeated rows share their fate."""
    return _whole(decontam.find_items(_slim(docs), load(spark, sf_dir, "benchmark")).where(~F.col("contaminated")), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each document's pieces in bins; each row is a document of its own."""
    return packing.pack(docs)


STAGES = [
    ("language", language),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("pack", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
