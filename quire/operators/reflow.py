"""Provenance and reflow: tokens of blocks, their places in one text per document, and checks of both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.text import tokens, utf16_length


def tokens_of(blocks: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, token_idx, token."""
    return blocks.select(*keys, F.posexplode(tokens(F.col(text))).alias("token_idx", "token"))


def span_violations(blocks: DataFrame, spans: DataFrame) -> DataFrame:
    """Blocks whose token count differs from their number of spans: doc_id, block_idx, role, n_tokens, n_spans."""
    counted = blocks.select("doc_id", "block_idx", "role", F.size(tokens(F.col("text"))).alias("n_tokens"))
    have = spans.groupBy("doc_id", "block_idx").agg(F.count("*").cast("int").alias("n_spans"))
    both = counted.join(have, ["doc_id", "block_idx"], "full").select("doc_id", "block_idx", "role", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"))
    return both.where("n_tokens <> n_spans")


def reflow_offsets(block_tokens: DataFrame) -> DataFrame:
    """Tokens with loc and len in UTF-16 units in the document's text: a blank between tokens, a blank line between blocks."""
    along = W.partitionBy("doc_id").orderBy("block_idx", "token_idx")
    last = F.coalesce(F.lead("block_idx").over(along) != F.col("block_idx"), F.lit(True))
    t = block_tokens.withColumn("len", utf16_length(F.col("token"))).withColumn("step", F.col("len") + F.when(last, 2).otherwise(1))
    return t.withColumn("loc", F.sum("step").over(along.rowsBetween(W.unboundedPreceding, 0)) - F.col("step")).drop("step")


def reflow_text(block_tokens: DataFrame) -> DataFrame:
    """doc_id, text laid out as reflow_offsets has it."""
    lines = block_tokens.groupBy("doc_id", "block_idx").agg(F.array_sort(F.collect_list(F.struct("token_idx", "token"))).alias("t"))
    return text_of_lines(lines.select("doc_id", "block_idx", F.array_join(F.transform("t", lambda x: x["token"]), " ").alias("line")))


def text_of_lines(lines: DataFrame) -> DataFrame:
    """reflow_text of blocks whose tokens stand in a line already (doc_id, block_idx, line)."""
    whole = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("block_idx", "line"))).alias("l"))
    return whole.select("doc_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n\n").alias("text"))


def paragraph_ranges(offsets: DataFrame) -> DataFrame:
    """doc_id, block_idx, loc, len of each block."""
    return offsets.groupBy("doc_id", "block_idx").agg(F.min("loc").alias("loc"), (F.max(F.col("loc") + F.col("len")) - F.min("loc")).alias("len"))


#: Characters of a block of text in which a token is looked for.
_BLOCK = 256


def _units(text):
    """Two characters for each UTF-16 unit, none of them beyond the basic plane, so that places are doubled offsets."""
    return F.decode(F.encode(text, "UTF-16BE"), "ISO-8859-1")


def reflow_check(offsets: DataFrame, texts: DataFrame) -> DataFrame:
    """Tokens that their range does not cut out of the text, ranges in UTF-16 units.

    A text is cut into blocks of _BLOCK characters that stay in its row, and a token is held against those it lies in: time
    is in proportion to the text, and tokens and texts that are dealt by document meet in place. Documents without a text
    are not told.
    """
    # characters are units but in texts with some beyond the basic plane
    text = F.col("text")
    wide = utf16_length(text) != F.length(text)
    blocks = texts.where("text is not null").select("doc_id", wide.alias("_wide"), F.when(wide, _units(text)).otherwise(text).alias("_text"))
    blocks = blocks.select("doc_id", "_wide", F.regexp_extract_all("_text", F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0)).alias("_blocks"))
    token = F.when(F.col("_wide"), _units(F.col("token"))).otherwise(F.col("token"))
    start, n = F.when(F.col("_wide"), F.col("loc") * 2).otherwise(F.col("loc")), F.length(token)
    no, at = F.floor(start / _BLOCK).cast("int"), (start % _BLOCK).cast("int")
    beyond = F.array_join(F.slice("_blocks", no + 1, F.floor((at + n - 1) / _BLOCK).cast("int") + 1), "")
    cut = F.substring(F.when(at + n <= _BLOCK, F.get("_blocks", no)).otherwise(beyond), at + 1, n)
    # texts are never broadcast, however small their files are
    return offsets.join(blocks.hint("merge"), "doc_id").where(F.coalesce(cut, F.lit("")) != token).select("doc_id", "block_idx", "token_idx")


def marker_carrier(blocks: DataFrame) -> DataFrame:
    """doc_id, marker (block_idx of a footnote marker), carrier: the nearest main-stream block before it."""
    along = W.partitionBy("doc_id").orderBy("block_idx").rowsBetween(W.unboundedPreceding, -1)
    main = F.col("role").isin("body", "heading")
    return blocks.withColumn("carrier", F.last(F.when(main, F.col("block_idx")), ignorenulls=True).over(along)).where("role = 'footnoteMarker'").select("doc_id", F.col("block_idx").alias("marker"), "carrier")


def marker_splice(block_tokens: DataFrame, markers: DataFrame) -> DataFrame:
    """Tokens and marker labels with loc and len; a marker (doc_id, block_idx, after_token, label) stands right after its
    token, with nothing between, and moves all that follows."""
    words = block_tokens.select("doc_id", "block_idx", "token_idx", F.lit(0).alias("kind"), F.col("token").alias("text"))
    marks = markers.select("doc_id", "block_idx", F.col("after_token").alias("token_idx"), F.lit(1).alias("kind"), F.col("label").alias("text"))
    along = W.partitionBy("doc_id").orderBy("block_idx", "token_idx", "kind", "text")
    both = words.unionByName(marks).withColumn("len", utf16_length(F.col("text")))
    gap = F.when(F.lead("kind").over(along) == 1, 0).when(F.coalesce(F.lead("block_idx").over(along) != F.col("block_idx"), F.lit(True)), 2).otherwise(1)
    both = both.withColumn("step", F.col("len") + gap)
    return both.withColumn("loc", F.sum("step").over(along.rowsBetween(W.unboundedPreceding, 0)) - F.col("step")).drop("step")


def reading_band_sort(marks: DataFrame) -> DataFrame:
    """Markers (doc_id, page_index, x, mid_y) with their reading rank: by page, bands of 4 points from the top, then x."""
    order = W.partitionBy("doc_id").orderBy("page_index", F.floor(F.col("mid_y") / 4).desc(), "x", "token_idx")
    return marks.withColumn("rank", F.row_number().over(order))


def marker_insertion(marks: DataFrame, words: DataFrame) -> DataFrame:
    """doc_id, page_index, marker, token_idx: the word on the marker's page that overlaps it vertically and ends at or
    before its x + max(1, width), with the greatest right edge (the first on ties); null if there is none."""
    w = words.select("doc_id", "page_index", "col", F.col("token_idx").alias("w_idx"), F.col("y").alias("w_y"), F.col("height").alias("w_h"), (F.col("x") + F.col("width")).alias("w_right"))
    near = marks.join(w, ["doc_id", "page_index", "col"], "left").where(
        F.col("w_idx").isNull() | ((F.col("w_y") < F.col("y") + F.col("height")) & (F.col("w_y") + F.col("w_h") > F.col("y")) & (F.col("w_right") <= F.col("x") + F.greatest(F.lit(1.0), F.col("width"))))
    )
    best = near.groupBy("doc_id", "page_index", "marker").agg(F.max_by("w_idx", F.struct("w_right", -F.col("w_idx"))).alias("token_idx"))
    return marks.select("doc_id", "page_index", "marker").join(best, ["doc_id", "page_index", "marker"], "left")
