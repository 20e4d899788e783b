"""Streams that are run to their end: what arrives, what each micro-batch leaves, and the last word on each key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_session(spark: SparkSession) -> SparkSession:
    """A session of its own for streams, so that the caller's settings stay: state in RocksDB, as many partitions of
    state as the cluster has cores (their number is fixed for the life of a checkpoint)."""
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    session.conf.set("spark.sql.shuffle.partitions", spark.sparkContext.defaultParallelism)
    session.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    return session


def drain(stream: DataFrame, path: str, mode: str) -> int:
    """Run a stream over all that has arrived since the checkpoint in path, and stop; the number of micro-batches so far.

    A micro-batch is written to a folder of its own, over what a failed attempt at it has left, so a restart neither
    loses nor repeats rows. In update mode a folder holds the touched keys only.
    """
    query = (
        stream.writeStream.outputMode(mode).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{path}/out/batch={n}"))
        .option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query.lastProgress["batchId"] + 1 if query.lastProgress else 0


def emitted(spark: SparkSession, path: str) -> DataFrame:
    """All rows of all micro-batches, with batch."""
    return spark.read.parquet(f"{path}/out")


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last row of each key: upserts are resolved by reading, so writing one touches no other key's row."""
    rows = emitted(spark, path)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_last")).select(*keys, "_last.*")


def replay(events: DataFrame, at: str, path: str, make: Callable[[DataFrame], DataFrame], mode: str, parts: int = 3) -> None:
    """Let events arrive in `parts` lots by their time, and restart the stream that make gives from its checkpoint for
    each of them. events are written once by lots and once as they arrive, in the folder path."""
    spark = events.sparkSession
    session = stream_session(spark)
    time = F.unix_micros(F.col(at).cast("timestamp"))
    cuts = events.agg(F.percentile_approx(time, [i / parts for i in range(1, parts)], 1000)).first()[0] or []
    lot = sum([(time > c).cast("int") for c in cuts], F.lit(0))
    lots = events.withColumn("lot", lot)
    lots.write.parquet(f"{path}/lots")
    for i in range(parts):
        rows = spark.read.schema(lots.schema).parquet(f"{path}/lots").where(F.col("lot") == i).drop("lot")
        rows.write.mode("append").parquet(f"{path}/in")
        drain(make(session.readStream.schema(rows.schema).parquet(f"{path}/in")), path, mode)
