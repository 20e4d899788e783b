"""Mixing sources to target weights by a curriculum whose weights vary over time.

Each source has a target number of words. Its documents, in the order of a hash, make a stream that is read up to the
target, again from its start if the target is larger than the source, three times at most. Each source's weight over the
training time is a schedule of (time, weight) points, straight between them; its integral is the source's cumulative
demand, and the time at which the demand reaches a document's place in the stream is the document's training position.
Documents are range-sorted by position.

Streams are summed in two steps, over hash buckets and inside each, so that a source of any size is spread out.

Defined results: null text has size 0 and is never taken. A null source is a source of its own, the last one. Rows with
equal doc_ids are separate, and repeated rows are taken each; rows without a doc_id are ordered by their text. Equal
places are taken by doc_id, then size; equal positions are sorted by doc_id. Of a text only its number of words counts,
however long it is. Sources of size 0 have target 0. Other columns
are kept, but for those named like what is computed here (see `mix`), which are dropped. Empty tables give empty results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import sized, staged

WEIGHTS = (5, 2, 1)
MOST = 3
#: Rows for which a hash bucket is planned, and the hexadecimal digits of its name at most.
BUCKET_ROWS, LONGEST = 1000, 6
#: Weight over time of the first, second, ... source, repeating: steady, early and late ones.
SCHEDULES = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 2.0), (0.5, 1.0), (1.0, 0.5)), ((0.0, 0.25), (0.6, 1.0), (1.0, 2.5)))
_WORD = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame) -> DataFrame:
    """docs with size, the number of words, and place, a hash that orders a source's documents."""
    place = F.coalesce(F.concat(F.lit("mix:"), F.col("doc_id").cast("string")), F.concat(F.lit("no id:"), F.coalesce("text", F.lit(""))))
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long")).withColumn("place", F.md5(place))


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, number (in code point order, null last), source_size, target of each source.

    All words are shared by weight; what a source cannot take within `most` times its size is shared anew among the
    others. That ends at one level for each unit of weight: sources are filled in the order of their room for each unit
    of weight, and the level follows from the first one that does not reach its bound.
    """
    each = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("number", F.lit(len(weights))) + 1).cast("int")).cast("long")
    each = each.withColumn("number", number).withColumn("weight", weight).withColumn("bound", F.col("source_size") * most)
    rank = Window.orderBy(F.col("bound") / F.col("weight"), "number")
    before = rank.rowsBetween(Window.unboundedPreceding, -1)
    after = rank.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = rank.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("bound").over(before), F.lit(0))
    share = left.cast("double") * F.col("weight") / F.sum("weight").over(after)
    each = each.withColumn("share", share).withColumn("full", F.col("share") >= F.col("bound"))
    # from the first source that stays below its bound on, all share what is left there
    first = F.min(F.when(~F.col("full"), F.struct("bound_rank", "rest", "rest_weight"))).over(Window.partitionBy())
    each = each.withColumn("bound_rank", F.row_number().over(rank)).withColumn("rest", left).withColumn("rest_weight", F.sum("weight").over(after)).withColumn("at", first)
    target = F.when(F.col("at").isNull() | (F.col("bound_rank") < F.col("at.bound_rank")), F.col("bound").cast("double")).otherwise(F.col("at.rest").cast("double") * F.col("weight") / F.col("at.rest_weight"))
    return each.select("source", "number", "source_size", target.alias("target"))


def inverse_demand(share: Column, schedule: tuple[tuple[float, float], ...]) -> Column:
    """The time by which a share (0 to 1) of the schedule's whole integral has passed."""
    pieces, total = [], 0.0
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        pieces.append((t0, w0, (w1 - w0) / (t1 - t0), total))
        total += (w0 + w1) / 2 * (t1 - t0)
    out = None
    for t0, w0, slope, before in pieces:
        y = share * F.lit(total) - F.lit(before)
        # w0 * d + slope / 2 * d * d = y
        d = y / F.lit(w0) if slope == 0 else (F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * y, F.lit(0.0))) - F.lit(w0)) / F.lit(slope)
        out = F.lit(t0) + d if out is None else F.when(share * F.lit(total) >= F.lit(before), F.lit(t0) + d).otherwise(out)
    return out


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, schedules=SCHEDULES) -> DataFrame:
    """The columns of docs, then size, source_size, target, taken, position, the training word at which the mix first
    comes to it (null if it is never taken), and passes, the words and the position of each time its stream is read."""
    rest = docs.drop("size", "place", "bucket", "source_key", "no_source", "bucket_start", "number", "source_size", "target", "start", "taken", "position", "passes", "pass")
    rows = sizes(rest)
    small = staged(rows.select("source", F.substring("place", 1, LONGEST).alias("bucket"), "size"), "mix_sizes")
    # buckets are so narrow that each holds about BUCKET_ROWS rows of all sources; results do not depend on it
    digits = min(LONGEST, max(1, math.ceil(math.log(max(1, small.count() / BUCKET_ROWS), 16))))
    rows, small = (df.withColumn("bucket", F.substring(c, 1, digits)) for df, c in ((rows, "place"), (small, "bucket")))
    goals = staged(targets(small, weights, most), "targets")
    parts = small.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    along = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    key = F.coalesce(F.col("source"), F.lit("")), F.col("source").isNull()
    named = lambda df: df.withColumn("source_key", key[0]).withColumn("no_source", key[1])
    starts = named(parts.withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(along), F.lit(0)))).drop("source", "bucket_size")
    starts = staged(starts.join(sized(named(goals).drop("source")), ["source_key", "no_source"]), "starts")
    placed = named(rows).join(sized(starts), ["source_key", "no_source", "bucket"])
    inside = Window.partitionBy("source_key", "no_source", "bucket").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("start", F.col("bucket_start") + F.sum("size").over(inside) - F.col("size"))
    goal = F.floor(F.col("target") + 0.5)
    total = F.lit(goals.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]).cast("long")

    def time(share: Column) -> Column:
        out = None
        for k, schedule in enumerate(schedules):
            here = inverse_demand(share, schedule)
            out = here if out is None else F.when(F.pmod("number", F.lit(len(schedules))) == k, here).otherwise(out)
        return out

    passes = []
    for again in range(most):
        start = F.lit(again) * F.col("source_size") + F.col("start")
        words = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), goal - start))
        passes.append(F.struct(words.alias("words"), F.least(F.floor(time(start / F.greatest(goal, F.lit(1).cast("long"))) * total), total).alias("position")))
    placed = placed.withColumn("passes", F.array(*passes))
    taken = F.aggregate("passes", F.lit(0).cast("long"), lambda a, p: a + p["words"])
    placed = placed.withColumn("taken", taken).withColumn("position", F.when(F.col("taken") > 0, F.col("passes")[0]["position"]))
    return placed.select(*rest.columns, "size", "source_size", "target", "taken", "position", "passes")


def in_order(mixed: DataFrame) -> DataFrame:
    """Range-sorted by training position; what is never taken comes last."""
    return mixed.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def occurrences(mixed: DataFrame) -> DataFrame:
    """A row for each time that the mix takes at least half of a document, with the position of that time."""
    whole = F.filter("passes", lambda p: (p["words"] > 0) & (p["words"] * 2 >= F.col("size")))
    return mixed.withColumn("pass", F.explode(whole)).withColumn("position", F.col("pass.position")).drop("pass", "passes")
