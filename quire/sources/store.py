"""What is kept between runs: derived tables by document, originals by hash, vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sidecar_write(tables: dict[str, DataFrame], path: str, version: int, voice: str) -> None:
    """Write derived tables (each with a hash column) under path, by version and voice."""
    for name, df in tables.items():
        df.withColumn("version", F.lit(version)).withColumn("voice", F.lit(voice)).write.mode("append").partitionBy("version", "voice").parquet(f"{path}/{name}")


def sidecar_read(spark: SparkSession, path: str, name: str, version: int, voice: str, hashes: DataFrame | None = None) -> DataFrame:
    """A derived table of one version and voice; partitions of others are not read."""
    df = spark.read.parquet(f"{path}/{name}").where((F.col("version") == version) & (F.col("voice") == voice))
    return df if hashes is None else df.join(hashes.select("hash").distinct(), "hash", "left_semi")


def originals_store(files: DataFrame, path: str, content: str = "content") -> None:
    """Keep source bytes by their hash."""
    files.select(F.sha2(F.col(content).cast("binary"), 256).alias("hash"), F.col(content).cast("binary").alias("bytes")).dropDuplicates(["hash"]).write.mode("append").parquet(path)


def originals_read(spark: SparkSession, path: str, hashes: DataFrame) -> DataFrame:
    return spark.read.parquet(path).join(hashes.select("hash").distinct(), "hash", "left_semi")


def vocab_load(spark: SparkSession, path: str, fallback: dict[str, int]) -> DataFrame:
    """symbol, id from a JSON file, a flat map or one under model.vocab; numeric ids only; the fallback if none is found."""
    raw = spark.read.text(path, wholetext=True)
    flat = F.from_json("value", "map<string,string>")
    nested = F.from_json(F.get_json_object("value", "$.model.vocab"), "map<string,string>")
    found = raw.select(F.explode(F.coalesce(nested, flat)).alias("symbol", "text")).select("symbol", F.expr("try_cast(text AS INT)").alias("id")).where("id is not null")
    if found.isEmpty():
        return spark.createDataFrame(list(fallback.items()), "symbol string, id int")
    return found
