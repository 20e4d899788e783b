"""Durations of symbols and chunks in frames, and how they lie along a document."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.text import half_up
from quire.functions.wordlists import OTHER_WEIGHT, SYMBOL_WEIGHTS

SILENCE, SAMPLES_A_FRAME = 16, 600


def round_frames(raw: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), half_up(raw))


def symbol_weights(symbols: DataFrame) -> DataFrame:
    """symbols with weight, by the class of their symbol."""
    rows = [(c, w) for members, w in SYMBOL_WEIGHTS for c in members]
    table = symbols.sparkSession.createDataFrame(rows, "symbol string, weight double").groupBy("symbol").agg(F.max("weight").alias("weight"))
    return symbols.join(F.broadcast(table), "symbol", "left").withColumn("weight", F.coalesce("weight", F.lit(OTHER_WEIGHT)))


def estimate_chunk(weighted: DataFrame, keys: list[str], scale: float = 1.0) -> DataFrame:
    """keys, n, frames: the weights' sum, at least a frame for each symbol."""
    sums = weighted.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    return sums.select(*keys, "n", F.greatest(F.col("n"), half_up(F.col("w") * scale)).alias("frames"))


def distribute_frames(weighted: DataFrame, keys: list[str], order: str, total: str) -> DataFrame:
    """weighted (half-weights as whole numbers in weight2) with frames that sum to max(n, total) in each group.

    Largest remainders: each row gets its whole share, one at least; rows with the greatest remainders (the first on
    ties) get what is left. What is over is taken from the longest rows in turn, never below one frame.
    """
    group = W.partitionBy(*keys)
    t = weighted.withColumn("_n", F.count("*").over(group)).withColumn("_sum", F.sum("weight2").over(group))
    t = t.withColumn("_goal", F.greatest(F.col("_n"), F.col(total)))
    share = F.when(F.col("_sum") > 0, F.col("weight2") * F.col("_goal")).otherwise(F.col("_goal"))
    part = F.when(F.col("_sum") > 0, F.col("_sum")).otherwise(F.col("_n"))
    t = t.withColumn("_share", share).withColumn("_part", part).withColumn("_base", F.greatest(F.lit(1).cast("long"), F.expr("_share div _part"))).withColumn("_rest", F.expr("_share % _part"))
    t = t.withColumn("_left", F.col("_goal") - F.sum("_base").over(group)).withColumn("_rank", F.row_number().over(group.orderBy(F.desc("_rest"), order)))
    # what is left may go round more than once, since shares below one were raised
    more = F.when(F.col("_left") > 0, F.expr("_left div _n") + F.when(F.col("_rank") <= F.col("_left") % F.col("_n"), 1).otherwise(0)).otherwise(0)
    t = t.withColumn("frames", F.col("_base") + more)
    # each frame over the first can be taken; rows give one in each round, the longest first
    t = t.withColumn("_over", -F.least(F.lit(0).cast("long"), F.col("_left"))).withColumn("_long", F.row_number().over(group.orderBy(F.desc("frames"), order)))
    levels = t.where("_over > 0 and frames > 1").select(*keys, order, "_over", "_long", F.explode(F.sequence(F.lit(1).cast("long"), F.col("frames") - 1)).alias("_round"))
    taken = levels.withColumn("_k", F.row_number().over(group.orderBy("_round", "_long"))).where("_k <= _over").groupBy(*keys, order).agg(F.count("*").alias("_taken"))
    out = t.join(taken, [*keys, order], "left").withColumn("frames", F.col("frames") - F.coalesce("_taken", F.lit(0)))
    return out.drop("_n", "_sum", "_goal", "_share", "_part", "_base", "_rest", "_left", "_rank", "_over", "_long", "_taken")


def calibration(pairs: DataFrame) -> DataFrame:
    """pairs (doc_id, seq, estimated, actual) with scale from the pairs before: actual over estimated, 1 without any."""
    before = W.partitionBy("doc_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    good = (F.col("estimated") > 0) & (F.col("actual") > 0)
    sums = lambda c: F.sum(F.when(good, F.col(c))).over(before)
    return pairs.withColumn("scale", F.coalesce(sums("actual") / sums("estimated"), F.lit(1.0)))


def silence_between(chunks: DataFrame) -> DataFrame:
    """chunks (doc_id, stream, n, block_idx) with silence: none at the start and inside a block, else a pause."""
    before = F.lag("block_idx").over(W.partitionBy("doc_id", "stream").orderBy("n"))
    return chunks.withColumn("silence", F.when(before.isNull() | (before == F.col("block_idx")), 0).otherwise(SILENCE))


def stream_layout(chunks: DataFrame) -> DataFrame:
    """chunks (doc_id, stream, n, silence, frames) with start, and offset that leaves the silences out."""
    upto = W.partitionBy("doc_id", "stream").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(F.col("silence") + F.col("frames")).over(upto)
    return chunks.withColumn("start", end - F.col("frames")).withColumn("offset", F.sum("frames").over(upto) - F.col("frames"))


def commit_lengths(chunks: DataFrame, actual: DataFrame) -> DataFrame:
    """The layout with real lengths (doc_id, stream, n, real) in place of estimates, and whether all are real."""
    key = ["doc_id", "stream", "n"]
    c = chunks.join(actual, key, "left").withColumn("committed", F.col("real").isNotNull()).withColumn("frames", F.coalesce("real", "frames")).drop("real")
    return stream_layout(c).withColumn("exact", F.bool_and("committed").over(W.partitionBy("doc_id", "stream")))


def word_timeline(layout: DataFrame, symbol_frames: DataFrame, words: DataFrame) -> DataFrame:
    """doc_id, block_idx, token_idx, start_frame, end_frame of words whose chunk-local symbol ranges are lo to hi; chunks
    are framed by one pad symbol at each end."""
    key = ["doc_id", "block_idx", "chunk_idx"]
    # a chunk's symbols and words meet as arrays in one row each, so that no symbol is joined by itself
    f = symbol_frames.groupBy(*key).agg(F.collect_list(F.struct(F.col("pos").cast("int").alias("pos"), F.col("frames").cast("int").alias("frames"))).alias("_f"))
    w = words.groupBy(*key).agg(F.collect_list(F.struct("token_idx", F.col("lo").cast("int").alias("lo"), F.col("hi").cast("int").alias("hi"))).alias("_w"))
    both = w.join(f, key).join(layout.select(*key, "start"), key)
    return timed_words(both.select("doc_id", "block_idx", "start", "_f.pos", "_f.frames", "_w.token_idx", "_w.lo", "_w.hi"))


def timed_words(chunks: DataFrame) -> DataFrame:
    """word_timeline of chunks (doc_id, block_idx, start) whose symbols (pos, frames) and words (token_idx, lo, hi) stand in
    arrays in their own row, so that neither is shuffled."""

    @F.arrow_udf("struct<at:array<int>,from:array<bigint>,to:array<bigint>>")
    def spans(pos: pa.Array, frames: pa.Array, lo: pa.Array, hi: pa.Array) -> pa.Array:
        return _spans(pos, frames, lo, hi)

    told = chunks.select("doc_id", "block_idx", "start", "token_idx", spans("pos", "frames", "lo", "hi").alias("_s"))
    each = told.select("doc_id", "block_idx", "start", "token_idx", F.inline(F.arrays_zip(F.col("_s.at").alias("_at"), F.col("_s.from").alias("_from"), F.col("_s.to").alias("_to"))))
    each = each.toDF("doc_id", "block_idx", "start", "token_idx", "_at", "_from", "_to")
    return each.select("doc_id", "block_idx", F.get("token_idx", F.col("_at")).alias("token_idx"), (F.col("start") + F.col("_from")).alias("start_frame"), (F.col("start") + F.col("_to")).alias("end_frame"))


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of lists, one list after the other, and where in them each list starts."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.append(0, np.cumsum(sizes, dtype=np.int64))


def _spans(pos: pa.Array, frames: pa.Array, lo: pa.Array, hi: pa.Array) -> pa.Array:
    """Which words of each chunk have their symbols in it, and where they start and end, in frames from the chunk's start.

    All chunks of a batch are told at once: a symbol's key is its place, after those of the chunks before.
    """
    (pos, symbols), (frames, _), (lo, words), (hi, _) = (_flat(c) for c in (pos, frames, lo, hi))
    chunks = np.arange(len(words) - 1)
    last = np.maximum(lo, hi - 1)
    least = min(pos.min(initial=0), lo.min(initial=0) + 1)
    wide = max(pos.max(initial=0), last.max(initial=0) + 1) - least + 1
    key = np.repeat(chunks * wide - least, np.diff(symbols)) + pos
    order = np.argsort(key, kind="stable")
    key, end = np.append(key[order], -1), np.append(np.cumsum(frames[order]), 0)
    start = end - np.append(frames[order], 0)
    base = np.repeat(chunks * wide - least + 1, np.diff(words))
    i, j = (np.searchsorted(key[:-1], base + at) for at in (lo, last))
    at = np.flatnonzero((key[i] == base + lo) & (key[j] == base + last))
    chunk = np.searchsorted(words, at, side="right") - 1
    zero, i, j = start[symbols[chunk]], i[at], j[at]
    kept = np.append(0, np.cumsum(np.bincount(chunk, minlength=len(chunks)))).astype(np.int32)
    out = ((at - words[chunk]).astype(np.int32), start[i] - zero, np.where((hi > lo)[at], end[j], start[i]) - zero)
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(kept), pa.array(c)) for c in out], ["at", "from", "to"])


def timing_choice(chunks: DataFrame) -> DataFrame:
    """chunks (modelled, estimated, actual) with source, frames and whether the two differ by more than a frame."""
    has = F.col("modelled").isNotNull()
    return chunks.withColumn("source", F.when(has, "model").otherwise("estimated")).withColumn("frames", F.coalesce("modelled", "actual")).withColumn("mismatch", has & (F.abs(F.col("modelled") - F.col("actual")) > 1))


def frame_energy(samples: DataFrame, keys: list[str], frame: int = SAMPLES_A_FRAME) -> DataFrame:
    """keys, frame, energy: mean absolute amplitude of samples (keys, pos, sample)."""
    return samples.groupBy(*keys, F.floor(F.col("pos") / frame).cast("int").alias("frame")).agg(F.avg(F.abs("sample")).alias("energy"))


def snap_boundaries(boundaries: DataFrame, energy: DataFrame, search: int = 3) -> DataFrame:
    """boundaries (key, n, at) moved to the quietest frame near, if it is below 30 % of the mean there; order is kept."""
    e = energy.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", "energy"))), lambda x: x["energy"]).alias("e"))
    b = boundaries.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "at"))), lambda x: x["at"]).alias("b")).join(e, "key")
    zero = F.struct(F.lit(0).alias("before"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, at: Column) -> Column:
        lo, hi = F.greatest(s["before"] + 1, at - search), F.least(F.size("e") - 1, at + search)
        near = F.slice("e", lo + 1, F.greatest(hi - lo + 1, F.lit(1)))
        low = F.array_min(near)
        mean = F.aggregate(near, F.lit(0.0), lambda a, x: a + x) / F.size(near)
        skip = (at <= s["before"]) | (at >= F.size("e"))
        moved = ~skip & (hi > lo) & (mean > 0) & (low < mean * 0.3)
        to = F.when(moved, lo + F.array_position(near, low).cast("int") - 1).otherwise(at)
        return F.struct(F.when(skip, F.greatest(s["before"], at)).otherwise(to).alias("before"), F.array_append(s["out"], to).alias("out"))

    return b.select("key", F.posexplode(F.aggregate("b", zero, step, lambda s: s["out"])).alias("n", "at"))


def frames_from_boundaries(boundaries: DataFrame, totals: DataFrame) -> DataFrame:
    """key, n, frames between boundaries (key, n, at), one at least, and of the tail up to total."""
    tail = boundaries.groupBy("key").agg(F.max("n").alias("n"), F.max("at").alias("last")).join(totals, "key")
    tail = tail.select("key", (F.col("n") + 1).alias("n"), F.greatest(F.lit(1), F.col("total") - F.col("last")).cast("int").alias("frames"))
    before = F.coalesce(F.lag("at").over(W.partitionBy("key").orderBy("n")), F.lit(0))
    return boundaries.select("key", "n", F.greatest(F.lit(1), F.col("at") - before).cast("int").alias("frames")).unionByName(tail)


def expand_frames(rows: DataFrame, frames: str) -> DataFrame:
    """Each row once for each of its frames, numbered in copy."""
    return rows.where(F.col(frames) > 0).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col(frames).cast("long"))))


def style_lookup(chunks: DataFrame, styles: DataFrame) -> DataFrame:
    """chunks (symbols) with the style row of their length, held inside the table (row, style), whose rows are few."""
    last = styles.agg(F.max("row").alias("last"))
    return chunks.crossJoin(F.broadcast(last)).withColumn("row", F.least(F.greatest(F.col("symbols"), F.lit(0)), F.col("last"))).drop("last").join(styles, "row")


def fit_to_slot(samples: DataFrame, slots: DataFrame) -> DataFrame:
    """key, pos, sample for each position of the slot (key, size): cut, or filled with zeros."""
    at = slots.where("size > 0").select("key", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("pos"))
    return at.join(samples, ["key", "pos"], "left").select("key", "pos", F.coalesce("sample", F.lit(0.0)).alias("sample"))


def refine_words(symbol_frames: DataFrame, boundaries: DataFrame, totals: DataFrame) -> DataFrame:
    """key, pos, frames: each stretch between boundaries (key, n, before, after) scaled from its old to its new length, one
    frame at least, then the exact total restored from the end."""
    group, along = W.partitionBy("key"), W.partitionBy("key").orderBy("pos")
    old = F.sum("frames").over(along.rowsBetween(W.unboundedPreceding, 0)) - F.col("frames")
    edges = boundaries.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("before", "after"))).alias("_b"))
    s = symbol_frames.withColumn("_at", old).join(edges, "key").join(totals, "key").withColumn("_old", F.sum("frames").over(group))
    s = s.withColumn("_k", F.size(F.filter("_b", lambda b: b["before"] <= F.col("_at"))))
    edge = lambda k, side, other: F.coalesce(F.try_element_at(F.col("_b"), k)[side], other)
    low = lambda side: F.when(F.col("_k") == 0, 0).otherwise(edge(F.greatest(F.col("_k"), F.lit(1)), side, F.lit(0)))
    was = edge(F.col("_k") + 1, "before", F.col("_old")) - low("before")
    now = edge(F.col("_k") + 1, "after", F.col("total")) - low("after")
    s = s.withColumn("_f", F.greatest(F.lit(1).cast("long"), half_up(F.col("frames") * now / F.greatest(was, F.lit(1)))))
    s = s.withColumn("_over", F.sum("_f").over(group) - F.col("total"))
    after = F.coalesce(F.sum(F.col("_f") - 1).over(W.partitionBy("key").orderBy(F.desc("pos")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    last = F.row_number().over(W.partitionBy("key").orderBy(F.desc("pos"))) == 1
    less = F.when(F.col("_over") > 0, F.greatest(F.lit(0), F.least(F.col("_f") - 1, F.col("_over") - after))).otherwise(F.when(last, F.col("_over")).otherwise(0))
    return s.select("key", "pos", (F.col("_f") - less).cast("long").alias("frames"))
