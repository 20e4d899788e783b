"""A training corpus from raw documents: quality, near-duplicates, benchmark passages, the mix of sources, shards.

Each stage takes the documents its predecessor kept and returns documents; the last one adds their shards. Decisions are
carried to rows by doc_id and a hash of the text. Defined results, in every stage: rows without a doc_id, a source or a
text go through like any other (null and empty texts score by the classifier's bias, link with nothing, hold no
passage and are never taken by the mix); repeated rows of a document become one in the near-duplicate stage; texts are
read whole; columns beside doc_id, text and source are carried along under whatever name, and only the last stage
replaces those named like its own columns; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import cleared, sized, staged, table
from quire.llm.decontam import contamination
from quire.llm.mixing import in_order, mix, occurrences
from quire.llm.near_dup import near_duplicates
from quire.llm.quality import quality_scores
from quire.llm.sharding import shard_rows

SHARDS = 40
#: Documents that share four fifths of their five-word shingles are one.
PERCENT = 80


#: Columns that stages read; all others are set aside under names that nothing else has.
OWN = ("doc_id", "text", "source")


def _aside(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """docs with its other columns renamed, and the columns that bring docs back."""
    names = {c: c if c in OWN else f"_held_{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), [F.col(n).alias(c) for c, n in names.items()]


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs but for the rows (doc_id, text_key) in gone."""
    gone = sized(staged(gone.select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct(), "gone"))
    rest, back = _aside(docs)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("gone_id")) & (F.xxhash64("text") == F.col("gone_key"))
    return rest.join(gone, same, "left_anti").select(*back)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    rest, back = _aside(docs)
    return quality_scores(rest, table(spark, sf_dir, "labels")).where("predicted = 1").select(*back)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates; repeated rows of it become one."""
    rest = _without(docs, near_duplicates(docs, percent=PERCENT).where("not representative"))
    twins = not docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    if not twins:
        return rest
    return rest.where("doc_id is not null").dropDuplicates(["doc_id", "text"]).unionByName(rest.where("doc_id is null"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return _without(docs, contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (at least half of their words), sorted by training position."""
    rest, back = _aside(docs)
    return in_order(occurrences(mix(rest))).select(*back)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and slot. Slots of a shard follow the rows of the files read, so the mix's order."""
    rest, back = _aside(docs)
    order = None
    if docs.inputFiles():
        part = F.lpad(F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1), 12, "0")
        rest, order = rest.select("*", F.concat(part, "_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_place")), ("_file", "_place")
    sharded = shard_rows(rest, SHARDS, order=order)
    added = [c for c in sharded.columns if c not in rest.columns]
    return sharded.select(*[c for c, name in zip(back, docs.columns) if name not in added], *added)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_stage),
    ("minhash_near_dup", near_dup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("source_mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: The quality classifier's weights cannot be told in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again; what a stage staged on its way is deleted,
    also where it fails."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with cleared(spark):
            docs = staged(stage(spark, docs, sf_dir), name)
    return docs
