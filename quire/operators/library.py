"""Catalog and cache accounting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.operators.windows import cut_lineage


def library_list(library: DataFrame, chunk_meta: DataFrame) -> DataFrame:
    """Catalog rows with the bytes and chunks they have, newest opened first."""
    sums = chunk_meta.groupBy("hash").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("chunks"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return library.join(sums, "hash", "left").select(*library.columns, zero("bytes"), zero("chunks")).orderBy(F.desc("opened"), "hash")


def rendered_chunks(chunk_meta: DataFrame, key) -> DataFrame:
    return chunk_meta.where(F.col("hash") == key).orderBy("chunk_index")


def lru_evict(library: DataFrame, cap, keep=None) -> DataFrame:
    """hash of whole documents to drop, oldest opened first, until the rest fits cap; keep is never dropped.

    Bytes are summed along the order in two steps: documents are parted by ranges of it, sums of the parts come first.
    """
    parted = cut_lineage(library.select("hash", "opened", "bytes").repartitionByRange("opened", "hash").withColumn("part", F.spark_partition_id()))
    free = F.lit(True) if keep is None else ~F.col("hash").eqNullSafe(F.lit(keep))
    # a row for each part
    sums = parted.groupBy("part").agg(F.sum("bytes").alias("all"), F.sum(F.when(free, F.col("bytes")).otherwise(0)).alias("free"))
    before = F.sum("free").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    sums = sums.select("part", F.sum("all").over(W.partitionBy()).alias("total"), F.coalesce(before, F.lit(0)).alias("start"))
    inside = F.sum("bytes").over(W.partitionBy("part").orderBy("opened", "hash").rowsBetween(W.unboundedPreceding, -1))
    placed = parted.where(free).withColumn("inside", F.coalesce(inside, F.lit(0))).join(F.broadcast(sums), "part")
    return placed.where(F.col("total") - F.col("start") - F.col("inside") > cap).select("hash")


def usage(chunk_meta: DataFrame) -> DataFrame:
    return chunk_meta.agg(F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"))


def touch(library: DataFrame, updates: DataFrame, order: list[str]) -> DataFrame:
    """The latest row of each hash."""
    both = library.unionByName(updates)
    last = W.partitionBy("hash").orderBy(*[F.desc(c) for c in order])
    return both.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def remove_cascade(table: DataFrame, hashes: DataFrame) -> DataFrame:
    """A table of the cache without the rows of some hashes."""
    return table.join(hashes.select("hash").distinct(), "hash", "left_anti")


def cache_hits(incoming: DataFrame, library: DataFrame, keys: tuple[str, ...] = ("hash", "version", "voice")) -> DataFrame:
    """Incoming documents whose result is there, of the same version and voice."""
    return incoming.join(library.select(*keys).distinct(), list(keys), "left_semi")


def to_import(incoming: DataFrame, library: DataFrame, keys: tuple[str, ...] = ("hash", "version", "voice")) -> DataFrame:
    return incoming.join(library.select(*keys).distinct(), list(keys), "left_anti")
