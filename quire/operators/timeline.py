"""Lookups on word timelines: as-of, nearest and interval joins."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.operators.windows import as_of

FRAMES_A_SECOND = 40
#: Seconds into a block after which going back means its own start.
RESTART_S = 1.5


def word_at(positions: DataFrame, timeline: DataFrame) -> DataFrame:
    """positions with word_idx, block_idx, start_frame of the last word that has started; the first word before that."""
    return as_of(positions, timeline, ["doc_id"], "t_frame", "start_frame", ["word_idx", "block_idx", "start_frame"], first_if_before=True)


def skip(positions: DataFrame, timeline: DataFrame, delta: int) -> DataFrame:
    """Position moved by delta frames, held inside the document, then snapped to its word's start: snapped."""
    ends = timeline.groupBy("doc_id").agg(F.max("end_frame").alias("duration"))
    moved = positions.join(ends, "doc_id").withColumn("t_frame", F.greatest(F.lit(0), F.least(F.col("duration"), F.col("t_frame") + delta))).drop("duration")
    return word_at(moved, timeline).withColumnRenamed("start_frame", "snapped")


def block_starts(timeline: DataFrame) -> DataFrame:
    """First word of each run of equal block ids: doc_id, block_idx, word_idx, start_frame, ordinal."""
    along = W.partitionBy("doc_id").orderBy("word_idx")
    fresh = F.coalesce(F.lag("block_idx").over(along) != F.col("block_idx"), F.lit(True))
    return timeline.withColumn("fresh", fresh).where("fresh").select("doc_id", "block_idx", "word_idx", "start_frame", (F.row_number().over(along) - 1).alias("ordinal"))


def previous_block(positions: DataFrame, starts: DataFrame) -> DataFrame:
    """The start of the block if the position is well into it (or it is the first), else of the one before: back_to."""
    before = F.lag("start_frame").over(W.partitionBy("doc_id").orderBy("word_idx"))
    found = as_of(positions, starts.withColumn("before", before), ["doc_id"], "t_frame", "start_frame", ["start_frame", "before"], first_if_before=True)
    well_in = (F.col("t_frame") - F.col("start_frame")) > RESTART_S * FRAMES_A_SECOND
    return found.withColumn("back_to", F.when(well_in | F.col("before").isNull(), F.col("start_frame")).otherwise(F.col("before"))).drop("before", "start_frame")


def next_block(positions: DataFrame, starts: DataFrame, durations: DataFrame) -> DataFrame:
    """The next block's start, else the duration: forward_to."""
    after = F.lead("start_frame").over(W.partitionBy("doc_id").orderBy("word_idx"))
    found = as_of(positions, starts.withColumn("after", after), ["doc_id"], "t_frame", "start_frame", ["start_frame", "after"], first_if_before=True)
    return found.join(durations, "doc_id").withColumn("forward_to", F.coalesce("after", "duration")).drop("after", "start_frame", "duration")


def chunk_at(positions: DataFrame, chunks: DataFrame) -> DataFrame:
    """positions with the chunk whose [offset, next offset) holds them, -1 outside; chunks has chunk_idx, offset, end."""
    found = as_of(positions, chunks, ["doc_id"], "t_frame", "offset", ["chunk_idx", "end"])
    return found.withColumn("chunk_idx", F.when(F.col("t_frame") < F.col("end"), F.col("chunk_idx")).otherwise(F.lit(-1))).drop("end")


def is_rendered(positions: DataFrame, chunks: DataFrame, rendered: DataFrame) -> DataFrame:
    """positions with whether the chunk under them is rendered."""
    have = rendered.select("doc_id", "chunk_idx").distinct().withColumn("rendered", F.lit(True))
    return chunk_at(positions, chunks).join(have, ["doc_id", "chunk_idx"], "left").withColumn("rendered", F.coalesce("rendered", F.lit(False)))


def demand_list(positions: DataFrame, chunks: DataFrame, rendered: DataFrame) -> DataFrame:
    """doc_id, chunk_idx under a position and not rendered yet, once each."""
    return is_rendered(positions, chunks, rendered).where("chunk_idx >= 0 and not rendered").select("doc_id", "chunk_idx").distinct()


def word_at_offset(clicks: DataFrame, offsets: DataFrame) -> DataFrame:
    """clicks (doc_id, offset) with the token whose text starts last at or before the offset; the first before all."""
    return as_of(clicks, offsets, ["doc_id"], "offset", "loc", ["block_idx", "token_idx"], first_if_before=True)


#: Clicks of a page that are looked up together; a page has as many rows of them as it needs.
LOT = 4096


def _nearest(cx, cy, token, wx, wy) -> tuple:
    """The token whose middle is nearest to each click and its squared distance, the first token on ties."""
    order = np.argsort(token, kind="stable")
    token, wx, wy = token[order], wx[order], wy[order]
    at, far = np.empty(len(cx), dtype=np.int64), np.empty(len(cx))
    step = max(1, (1 << 20) // len(token))
    for i in range(0, len(cx), step):
        d = (wx - cx[i : i + step, None]) ** 2 + (wy - cy[i : i + step, None]) ** 2
        at[i : i + step] = d.argmin(axis=1)
        far[i : i + step] = d.min(axis=1)
    return token[at], far


def nearest_word(clicks: DataFrame, boxes: DataFrame) -> DataFrame:
    """clicks (click, doc_id, page_index, cx, cy) with the word whose box centre on the page is nearest, the first on ties.

    A page's words are gathered in one row, and its clicks in rows of LOT at most; they meet by document, and then by
    page, so that words which are dealt by document already are not shuffled.
    """

    @F.pandas_udf("struct<token:array<int>,d:array<double>>")
    def found(cx: pd.Series, cy: pd.Series, token: pd.Series, wx: pd.Series, wy: pd.Series) -> pd.DataFrame:
        rows = [_nearest(*(np.asarray(c, dtype=float) for c in row[:2]), np.asarray(row[2]), *(np.asarray(c, dtype=float) for c in row[3:])) for row in zip(cx, cy, token, wx, wy)]
        return pd.DataFrame({"token": [t for t, _ in rows], "d": [d for _, d in rows]}, dtype=object)

    page, told = ["doc_id", "page_index"], ["click", "doc_id", "page_index"]
    word = F.struct("token_idx", (F.col("x") + F.col("width") / 2).alias("wx"), (F.col("y") + F.col("height") / 2).alias("wy"))
    pages = boxes.groupBy(*page).agg(F.collect_list(word).alias("_w"))
    nth = F.row_number().over(W.partitionBy(*page).orderBy("click"))
    lots = clicks.withColumn("_lot", F.floor((nth - 1) / LOT)).groupBy("doc_id", F.col("page_index").alias("_page"), "_lot").agg(F.collect_list(F.struct("click", "cx", "cy")).alias("_c"))
    # a difference, since an equal page as a second key would ask for words dealt by page
    met = pages.join(lots, "doc_id").where(F.col("page_index") - F.col("_page") == 0)
    met = met.select(*page, F.col("_c.click").alias("click"), found("_c.cx", "_c.cy", "_w.token_idx", "_w.wx", "_w.wy").alias("_f"))
    each = met.select(*page, F.inline(F.arrays_zip("click", F.col("_f.token").alias("token_idx"), F.col("_f.d").alias("d")))).toDF(*page, "click", "token_idx", "d")
    return each.groupBy(*told).agg(F.min_by("token_idx", F.struct("d", "token_idx")).alias("token_idx"))


def ranges_at(points: DataFrame, ranges: DataFrame, names: list[str]) -> DataFrame:
    """points (doc_id, offset) that lie in a range (loc, len and names) with its names; ranges of a document do not overlap."""
    found = as_of(points, ranges.withColumn("_end", F.col("loc") + F.col("len")), ["doc_id"], "offset", "loc", [*names, "_end"])
    return found.where(F.col("offset") < F.col("_end")).drop("_end")


def prefetch_window(positions: DataFrame, chunks: DataFrame, available: DataFrame, delivered: DataFrame, behind_s: int = 20, ahead_s: int = 150) -> DataFrame:
    """event_id, doc_id, action, first_chunk, last_chunk, n_chunks.

    Load: each chunk that meets the window, is available and not delivered, a row of its own. Release: the delivered
    chunks before the window and those after it, as one run each: its ends and how many delivered chunks it has. Chunks
    of a document follow each other, so the window and both runs are found by looking up their ends; no position meets
    more chunks than its window has.
    """
    key, nth = ["doc_id", "chunk_idx"], F.row_number().over(W.partitionBy("doc_id").orderBy("offset"))
    c = chunks.withColumn("nth", nth)
    p = positions.withColumn("_low", F.col("t_frame") - behind_s * FRAMES_A_SECOND).withColumn("_high", F.col("t_frame") + ahead_s * FRAMES_A_SECOND - 1)
    # the first chunk whose end lies behind low, the last one that starts before high
    p = as_of(p, c, ["doc_id"], "_low", "end", ["nth"]).withColumn("_first", F.coalesce("nth", F.lit(0)) + 1).drop("nth")
    p = as_of(p, c, ["doc_id"], "_high", "offset", ["nth"]).withColumn("_last", F.coalesce("nth", F.lit(0))).drop("nth")
    run = p.where("_last >= _first").select("event_id", "doc_id", F.explode(F.sequence("_first", "_last")).alias("nth"))
    load = run.join(c.join(available.distinct(), key, "left_semi").join(delivered, key, "left_anti").select("doc_id", "nth", "chunk_idx"), ["doc_id", "nth"])
    whole = W.partitionBy("doc_id").orderBy("nth").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    held = c.join(delivered.distinct(), key, "left_semi").select(
        "doc_id", "nth", "chunk_idx", F.first("chunk_idx").over(whole).alias("head"), F.last("chunk_idx").over(whole).alias("tail"),
        F.row_number().over(W.partitionBy("doc_id").orderBy("nth")).cast("long").alias("upto"), F.count("*").over(whole).alias("all"),
    )
    p = p.select("event_id", "doc_id", (F.col("_first") - 1).alias("_before"), (-F.col("_last") - 1).alias("_after"))
    before = as_of(p, held, ["doc_id"], "_before", "nth", ["chunk_idx", "head", "upto"]).where("chunk_idx is not null")
    after = as_of(p, held.withColumn("_back", -F.col("nth")), ["doc_id"], "_after", "_back", ["chunk_idx", "tail", "upto", "all"]).where("chunk_idx is not null")
    told = lambda rows, action, first, last, n: rows.select("event_id", "doc_id", F.lit(action).alias("action"), F.col(first).alias("first_chunk"), F.col(last).alias("last_chunk"), n.alias("n_chunks"))
    return (
        told(load, "load", "chunk_idx", "chunk_idx", F.lit(1).cast("long")).unionByName(told(before, "release", "head", "chunk_idx", F.col("upto")))
        .unionByName(told(after, "release", "chunk_idx", "tail", F.col("all") - F.col("upto") + 1))
    )


def prefetch_rows(runs: DataFrame, chunks: DataFrame, delivered: DataFrame) -> DataFrame:
    """event_id, doc_id, chunk_idx, action: the runs of prefetch_window with a row for each chunk, so as many as are told.

    A document's delivered chunks are numbered in order, and the numbers of a run's ends are found from its ends.
    """
    key = ["doc_id", "chunk_idx"]
    held = chunks.join(delivered.distinct(), key, "left_semi").select(*key, F.row_number().over(W.partitionBy("doc_id").orderBy("offset")).alias("_n"))
    out = runs.where("action = 'release'").join(held.select("doc_id", F.col("chunk_idx").alias("first_chunk"), "_n"), ["doc_id", "first_chunk"])
    out = out.select("event_id", "doc_id", "action", F.explode(F.sequence(F.col("_n"), (F.col("_n") + F.col("n_chunks") - 1).cast("int"))).alias("_n")).join(held, ["doc_id", "_n"])
    load = runs.where("action = 'load'").select("event_id", "doc_id", F.col("first_chunk").alias("chunk_idx"), "action")
    return load.unionByName(out.select("event_id", *key, "action"))


def timeline_audit(timeline: DataFrame) -> DataFrame:
    """doc_id, n_words, backwards, wide_gaps (over half a second), words_a_second."""
    along = W.partitionBy("doc_id").orderBy("word_idx")
    t = timeline.withColumn("gap", F.col("start_frame") - F.lag("end_frame").over(along)).withColumn("back", F.col("start_frame") < F.lag("start_frame").over(along))
    return t.groupBy("doc_id").agg(
        F.count("*").alias("n_words"), F.count_if("back").alias("backwards"), F.count_if(F.col("gap") > FRAMES_A_SECOND // 2).alias("wide_gaps"),
        F.round(F.count("*") * FRAMES_A_SECOND / F.max("end_frame"), 6).alias("words_a_second"),
    )


def note_interjection(taps: DataFrame, markers: DataFrame, note_ends: DataFrame, timeline: DataFrame) -> DataFrame:
    """taps (event_id, doc_id, t_frame, marker) with the tapped marker's note, that note's duration, and the word at which
    the main stream goes on. markers has doc_id, marker, note; note_ends has doc_id, note, duration."""
    hit = taps.join(markers, ["doc_id", "marker"]).join(note_ends, ["doc_id", "note"])
    return word_at(hit, timeline).select("event_id", "doc_id", "note", "duration", F.col("word_idx").alias("resume_word"))
