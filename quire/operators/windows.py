"""Patterns that most sequence operators are made of: islands, as-of lookups and folds."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def islands(df: DataFrame, keys: list[str], order: list[str], starts: Column, name: str) -> DataFrame:
    """df with the 0-based number of the island of each row; starts marks first rows (the first row always starts one)."""
    along = W.partitionBy(*keys).orderBy(*order)
    first = F.row_number().over(along) == 1
    flag = F.when(first | F.coalesce(starts, F.lit(False)), 1).otherwise(0)
    df = df.withColumn("_flag", flag)
    return df.withColumn(name, (F.sum("_flag").over(along.rowsBetween(W.unboundedPreceding, 0)) - 1).cast("int")).drop("_flag")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, start: str, take: list[str], first_if_before: bool = False) -> DataFrame:
    """left with the columns `take` of the last row of right (by keys) whose start <= at; ties take the greatest row.

    One shuffle by the keys: both sides are unioned and the last right row is carried along. Left rows before the first
    right row get nulls, or the first right row if asked for.
    """
    rest = [c for c in left.columns if c not in keys]
    both = left.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.struct(*rest).alias("_left"), F.lit(None).alias("_right")).unionByName(
        right.select(*keys, F.col(start).alias("_at"), F.lit(0).alias("_kind"), F.lit(None).alias("_left"), F.struct(*take).alias("_right"))
    )
    order = W.partitionBy(*keys).orderBy("_at", "_kind", "_right")
    found = F.last("_right", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    if first_if_before:
        found = F.coalesce(found, F.first("_right", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    out = both.withColumn("_found", found).where("_kind = 1")
    return out.select(*keys, *[F.col(f"_left.{c}").alias(c) for c in rest], *[F.col(f"_found.{c}").alias(c) for c in take])


def let(value: Column, result: Callable[[Column], Column]) -> Column:
    """result of value, which is computed once however often result names it."""
    return F.get(F.transform(F.array(value), result), F.lit(0))


@cache
def _temporary(application: str) -> str:
    return tempfile.mkdtemp(prefix="quire-")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; in local mode with none set, a temporary one, which the session is not told of."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: name a folder that all executors share")
    return _temporary(spark.sparkContext.applicationId)


def cut_lineage(df: DataFrame) -> DataFrame:
    """df checkpointed in the shared folder, or in the one that the caller has set on the context."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
