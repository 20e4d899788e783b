"""How good an extracted text is, and which of two extractions to keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.text import bare, half_up
from quire.functions.wordlists import FUNCTION_WORDS

SAMPLE_PAGES, LEAST_TOKENS, ACCEPTABLE = 8, 40, 0.55


def sample_pages(docs: DataFrame, limit: int = SAMPLE_PAGES) -> DataFrame:
    """doc_id, page of docs (doc_id, page_count): all pages, or `limit` of them spread evenly."""
    n = F.col("page_count")
    some = F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda i: F.floor((i + 0.5) * n / limit).cast("int"))
    return docs.where("page_count > 0").select("doc_id", F.explode(F.when(n <= limit, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(some)).alias("page"))


def pronounceable(word: Column) -> Column:
    low = F.lower(word)
    return low.rlike("[aeiouy]") & ~low.rlike("[bcdfghjklmnpqrstvwxz]{5,}")


def quality_metrics(tokens: DataFrame, areas: DataFrame) -> DataFrame:
    """doc_id, density, function_ratio, pronounceable_ratio, n_tokens of tokens (doc_id, token) and areas (doc_id, area)."""
    core = bare(F.col("token"))
    t = tokens.select("doc_id", "token", core.alias("core"))
    words = F.broadcast(tokens.sparkSession.createDataFrame([(w,) for w in sorted(set(FUNCTION_WORDS))], "core string").withColumn("is_function", F.lit(True)))
    t = t.where("core <> ''").join(words, "core", "left")
    alpha = F.col("core").rlike(r"^\p{L}{3,}$")
    sums = t.groupBy("doc_id").agg(
        F.sum(F.length("token")).alias("chars"), F.count("*").alias("n_tokens"), F.count_if(F.coalesce("is_function", F.lit(False))).alias("n_function"),
        F.count_if(alpha).alias("n_alpha"), F.count_if(alpha & pronounceable(F.col("core"))).alias("n_said"),
    )
    part = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return sums.join(areas, "doc_id").select("doc_id", part("chars", "area").alias("density"), part("n_function", "n_tokens").alias("function_ratio"), part("n_said", "n_alpha").alias("pronounceable_ratio"), "n_tokens")


def quality_score(metrics: DataFrame) -> DataFrame:
    """metrics with score and ok."""
    dense = F.least(F.lit(1.0), F.col("density") / 0.006)
    whole = 0.3 * dense + 0.45 * F.least(F.lit(1.0), F.col("function_ratio") / 0.2) + 0.25 * F.col("pronounceable_ratio")
    return metrics.withColumn("score", F.when(F.col("n_tokens") < LEAST_TOKENS, 0.3 * dense).otherwise(whole)).withColumn("ok", F.col("score") >= ACCEPTABLE)


def choose_extraction(embedded: DataFrame, other: DataFrame) -> DataFrame:
    """doc_id, choice, needs_review of two scored extractions (doc_id, score, ok)."""
    e = embedded.select("doc_id", F.col("score").alias("e_score"), F.col("ok").alias("e_ok"))
    o = other.select("doc_id", F.col("score").alias("o_score"), F.col("ok").alias("o_ok"))
    both = e.join(o, "doc_id", "full")
    keep = F.coalesce("e_ok", F.lit(False))
    stay = keep | F.col("o_score").isNull() | (F.col("e_score").isNotNull() & (F.col("o_score") < F.col("e_score")))
    return both.select("doc_id", F.when(stay, "embedded").otherwise("ocr").alias("choice"), F.when(keep, False).when(stay, True).otherwise(~F.col("o_ok")).alias("needs_review"))


def dictionary_hit_ratio(tokens: DataFrame, dictionary: DataFrame, sample: int = 600) -> DataFrame:
    """doc_id, n, hits of every (n div 600)-th alphabetic token of three letters or more found in a dictionary (word)."""
    t = tokens.select("doc_id", "token_idx", bare(F.col("token")).alias("word")).where(F.col("word").rlike(r"^\p{L}{3,}$"))
    mine = W.partitionBy("doc_id")
    t = t.withColumn("n", F.row_number().over(mine.orderBy("token_idx")) - 1).withColumn("step", F.greatest(F.lit(1), F.floor(F.count("*").over(mine) / sample)))
    picked = t.where(F.col("n") % F.col("step") == 0).select("doc_id", "word")
    hit = picked.join(dictionary.select("word").distinct().withColumn("hit", F.lit(1)), "word", "left")
    return hit.groupBy("doc_id").agg(F.count("*").alias("n"), F.count("hit").alias("hits")).withColumn("ratio", F.when(F.col("n") >= LEAST_TOKENS, F.col("hits") / F.col("n")).otherwise(0.0))


__all__ = ["choose_extraction", "dictionary_hit_ratio", "half_up", "pronounceable", "quality_metrics", "quality_score", "sample_pages"]
