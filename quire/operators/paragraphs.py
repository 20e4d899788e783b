"""Paragraphs of a column, words broken over lines, and blocks that go on over a page."""

from __future__ import annotations

from math import inf

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.operators.furniture import HEADING_LINES, HEADING_TOKENS, ends_sentence
from quire.operators.windows import cut_lineage, islands

GAP, INDENT = 1.25, 0.8
_COL = ["doc_id", "page_index", "col"]


def _measured(lines: DataFrame) -> DataFrame:
    """lines with n, em, pitch, slope, intercept and right_edge of their column, by windows: lines are read once and meet
    their column's measures in place."""
    whole = W.partitionBy(*_COL)
    along = whole.orderBy(F.desc("baseline"), "line")
    at = lambda rows, share: F.element_at(F.sort_array(rows), F.floor((F.col("n") - 1) * share).cast("int") + 1)
    l_ = lines.select("*", (F.lag("baseline").over(along) - F.col("baseline")).alias("_d"), F.count("*").over(whole).alias("n"), F.median("height").over(whole).alias("em"), F.collect_list("x0").over(whole).alias("_l"))
    l_ = l_.withColumn("em", F.when(F.coalesce("em", F.lit(0.0)) == 0, 10.0).otherwise(F.col("em"))).withColumn("_low", at(F.col("_l"), 0.2)).drop("_l")
    near = F.abs(F.col("x0") - F.col("_low")) <= F.col("em") * 0.6
    step = (F.col("_d") > F.col("em") * 0.5) & (F.col("_d") < F.col("em") * 3)
    # sums for the least-squares line through the starts of lines on the margin
    on = lambda c: F.avg(F.when(near, c)).over(whole)
    l_ = l_.select(
        "*", F.median(F.when(step, F.col("_d"))).over(whole).alias("_p"), F.count_if(near).over(whole).alias("_k"), on(F.col("baseline")).alias("_my"), on(F.col("x0")).alias("_mx"),
        F.regr_slope(F.when(near, F.col("x0")), F.when(near, F.col("baseline"))).over(whole).alias("_s"),
    )
    slope = F.when(F.col("_k") >= 4, F.greatest(F.lit(-0.025), F.least(F.lit(0.025), F.coalesce("_s", F.lit(0.0))))).otherwise(0.0)
    l_ = l_.withColumn("pitch", F.coalesce("_p", F.col("em") * 1.2)).withColumn("slope", slope)
    l_ = l_.withColumn("intercept", F.when(F.col("_k") >= 4, F.col("_mx") - F.col("slope") * F.col("_my")).otherwise(F.col("_low")))
    l_ = l_.withColumn("_r", F.collect_list(F.col("x1") - F.col("slope") * F.col("baseline")).over(whole)).withColumn("right_edge", at(F.col("_r"), 0.8))
    return l_.select(*lines.columns, "n", "em", "pitch", "slope", "intercept", "right_edge")


def column_metrics(lines: DataFrame) -> DataFrame:
    """doc_id, page_index, col, n, em, pitch, slope, intercept, right_edge of lines (x0, x1, baseline, height, line)."""
    measures = ("n", "em", "pitch", "slope", "intercept", "right_edge")
    return _measured(lines).groupBy(*_COL).agg(*[F.first(c).alias(c) for c in measures])


def paragraph_breaks(lines: DataFrame) -> DataFrame:
    """lines with starts, indented, full: where paragraphs begin in a column, by gap, indent, short lines and size."""
    along = W.partitionBy(*_COL).orderBy(F.desc("baseline"), "line")
    j = _measured(lines)
    j = j.withColumn("inset", F.col("x0") - (F.col("intercept") + F.col("slope") * F.col("baseline"))).withColumn("indented", F.col("inset") > F.col("em") * INDENT)
    width = F.greatest(F.col("em"), F.col("right_edge") - F.col("intercept"))
    j = j.withColumn("short", F.col("x1") < F.col("right_edge") + F.col("slope") * F.col("baseline") - F.greatest(F.col("em") * 1.5, width * 0.06)).withColumn("ends", ends_sentence(F.col("text")))
    j = j.withColumn("i", F.row_number().over(along) - 1)
    inside = F.count_if(F.col("short") & (F.col("i") < F.col("n") - 1) & ~F.col("ends")).over(W.partitionBy(*_COL))
    j = j.withColumn("ragged", (F.col("n") >= 6) & (inside / (F.col("n") - 1) > 0.25))
    for c in ("baseline", "height", "inset", "indented", "short", "ends", "n_runs"):
        j = j.withColumn(f"p_{c}", F.lag(c).over(along))
    gap, could = F.col("p_baseline") - F.col("baseline"), F.col("p_ends") | F.col("p_short")
    expected = F.col("pitch") * F.greatest(F.lit(1.0), F.least("height", "p_height") / F.col("em"))
    ratio = F.col("height") / F.col("p_height")
    long = (F.col("n_runs") >= 3) & (F.col("p_n_runs") >= 3)
    # what does not depend on breaks before
    fixed = (
        (gap > expected * GAP) | (gap <= F.col("em") * 0.3) | (F.col("indented") & ~F.col("p_indented") & could) | (F.col("indented") & F.col("p_indented") & (F.abs(F.col("inset") - F.col("p_inset")) > F.col("em") * INDENT) & could)
        | (~F.col("ragged") & F.col("p_short") & F.col("p_ends") & ~F.col("indented") & ~F.col("p_indented")) | (ratio > 1.3) | (ratio < 0.77) | (((ratio > 1.15) | (ratio < 0.87)) & long)
    )
    j = j.withColumn("fixed", F.coalesce(fixed, F.lit(True))).withColumn("back", F.coalesce(~F.col("indented") & F.col("p_indented") & could, F.lit(False)))
    rest = [c for c in lines.columns if c not in _COL]
    one = F.struct("i", "fixed", "back", "indented", F.coalesce("p_indented", F.lit(False)).alias("p_indented"), (~F.col("short")).alias("full"), F.struct(*rest).alias("x"))
    rows = j.groupBy(*_COL).agg(F.array_sort(F.collect_list(one)).alias("l"))
    zero = F.struct(F.lit(0).alias("run"), F.array().cast("array<boolean>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        starts = x["fixed"] | (x["back"] & (s["run"] >= 2))
        run = F.when(x["indented"], F.when(x["p_indented"] & ~starts, s["run"] + 1).otherwise(1)).otherwise(0)
        return F.struct(run.alias("run"), F.array_append(s["out"], starts).alias("out"))

    out = rows.select(*_COL, F.inline(F.arrays_zip("l", F.aggregate("l", zero, step, lambda s: s["out"]).alias("starts")))).toDF(*_COL, "l", "starts")
    return out.select(*[c if c in _COL else F.col(f"l.x.{c}") for c in lines.columns], "l.indented", "l.full", "starts")


def paragraphs(breaks: DataFrame) -> DataFrame:
    """doc_id, page_index, col, para_id, first, last, n_lines, starts_indented, ends_full of lines with breaks."""
    p = breaks.withColumn("_down", -F.col("baseline"))
    p = islands(p, _COL, ["_down", "line"], F.col("starts"), "para_id")
    return p.groupBy(*_COL, "para_id").agg(
        F.min_by("line", F.struct("_down", "line")).alias("first"), F.max_by("line", F.struct("_down", "line")).alias("last"), F.count("*").alias("n_lines"),
        F.min_by("indented", F.struct("_down", "line")).alias("starts_indented"), F.max_by("full", F.struct("_down", "line")).alias("ends_full"),
    )


def paragraphs_simple(lines: DataFrame) -> DataFrame:
    """lines with para_id: a new one at a wide gap, a step back up, or an indent from the leftmost line."""
    down = W.partitionBy(*_COL).orderBy("_down", "line")
    l_ = lines.withColumn("_down", -F.col("baseline"))
    l_ = l_.withColumn("_gap", F.col("_down") - F.lag("_down").over(down))
    s = l_.groupBy(*_COL).agg(F.median(F.when(F.col("_gap") > 0, F.col("_gap"))).alias("_step"), F.min("x0").alias("_left"))
    l_ = l_.join(s, _COL)
    new = (F.col("_gap") > 1.35 * F.col("_step")) | (F.col("_gap") <= 0) | (F.col("x0") - F.col("_left") > 0.8 * F.col("height"))
    return islands(l_, _COL, ["_down", "line"], F.coalesce(new, F.lit(False)), "para_id").select(*lines.columns, "para_id")


def dehyphenate(tokens: DataFrame) -> DataFrame:
    """doc_id, token_idx, token, n_boxes: a token that ends a line with a hyphen is joined with the next line's first one,
    if that starts in lower case. tokens has doc_id, token_idx, line_key, token."""
    along = W.partitionBy("doc_id").orderBy("token_idx")
    t = tokens.withColumn("_next", F.lead("token").over(along)).withColumn("_line", F.lead("line_key").over(along))
    broken = (F.length("token") > 1) & F.col("token").rlike("[-‐]$") & (F.col("_line") != F.col("line_key")) & F.col("_next").rlike(r"^\p{Ll}")
    t = t.withColumn("_broken", F.coalesce(broken, F.lit(False)))
    t = islands(t, ["doc_id"], ["token_idx"], ~F.lag("_broken").over(along), "_word")
    piece = F.when(F.col("_broken"), F.regexp_replace("token", "[-‐]$", "")).otherwise(F.col("token"))
    parts = F.array_sort(F.collect_list(F.struct("token_idx", piece.alias("t"))))
    return t.groupBy("doc_id", "_word").agg(F.min("token_idx").alias("token_idx"), F.array_join(F.transform(parts, lambda x: x["t"]), "").alias("token"), F.count("*").alias("n_boxes")).drop("_word")


def lift_markers(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs that are no markers, and the markers, of runs with is_marker."""
    return runs.where("not is_marker"), runs.where("is_marker")


CLOSING, OPENING, EITHER = 1, 2, 3
_CLOSING, _OPENING, _EITHER = r"^[,.;:!?)\]}”’»…%]+$", r"^[(\[{“‘«]+$", "^[\"']+$"


#: Places between two words, at which no mark can bind, that a row of attach_punctuation holds.
PLACES = 512


def _attached(token_idx, token, kind, x, right, line_key) -> tuple[list[int], list[str]]:
    """How many tokens each group has and its text, of a stretch of tokens that no mark binds to what is around it.

    What goes forward is carried and judged together with the next mark: alike kinds stay what they are, unlike ones
    become a word of their own. Marks of the document's end fall back, those of its start fall forward.
    """
    order = np.argsort(token_idx, kind="stable")
    token, kind, x, right, line_key = token[order], kind[order], x[order].tolist(), right[order].tolist(), line_key[order].tolist()
    n = len(token)
    heads = kind == 0  # words, for now
    last, carried = -1, None  # the last token that did not go forward; where what does began
    for i in np.flatnonzero(kind).tolist():
        if last < i - 1 and kind[i - 1] == 0:
            last, carried = i - 1, None
        was = carried
        start, k = (i, int(kind[i])) if was is None else (was, was_kind if was_kind == kind[i] else 0)
        left, follows = last >= 0, i + 1 < n
        if k == CLOSING:
            way = -1 if left else 1 if follows else 0
        elif k == OPENING:
            way = 1 if follows else -1 if left else 0
        elif k == EITHER:
            if left and follows:
                to_left = abs(x[start] - right[last]) if line_key[last] == line_key[start] else inf
                to_right = abs(x[i + 1] - right[i]) if line_key[i + 1] == line_key[i] else inf
                way = -1 if to_left <= to_right else 1
            else:
                way = -1 if left else 1 if follows else 0
        else:
            way = 0
        if way == 1:
            carried, was_kind = start, k
            if i + 1 < n and kind[i + 1] == 0:
                heads[start], heads[i + 1] = True, False
        else:
            heads[start] = heads[start] or way == 0
            last, carried = i, None
    heads[:1] = True
    starts = np.flatnonzero(heads)
    sizes = np.diff(np.append(starts, n)).tolist()
    words = token[starts].tolist()
    for g in np.flatnonzero(np.array(sizes) > 1).tolist():
        words[g] = "".join(token[starts[g] : starts[g] + sizes[g]])
    return sizes, words


def attach_punctuation(tokens: DataFrame) -> DataFrame:
    """doc_id, group, token, n_boxes: tokens of punctuation alone join the word they belong to. tokens has x, width and
    line_key.

    A closing mark joins what stands before it, an opening one what comes next, a straight quote the nearer of both (what
    stands before on ties, and across lines); at an end of the document each falls to the other side. No mark binds where
    two words stand side by side, so a document is cut there into rows of bounded size, in which marks are attached.
    """

    @F.pandas_udf("struct<n:array<int>,token:array<string>>")
    def attached(token_idx: pd.Series, token: pd.Series, kind: pd.Series, x: pd.Series, right: pd.Series, line_key: pd.Series) -> pd.DataFrame:
        rows = [_attached(*(np.asarray(c) for c in row)) for row in zip(token_idx, token, kind, x, right, line_key)]
        return pd.DataFrame({"n": [n for n, _ in rows], "token": [t for _, t in rows]}, dtype=object)

    along = W.partitionBy("doc_id").orderBy("token_idx")
    token = F.col("token")
    # a token with a letter or digit in front is a word
    kind = F.when(token.rlike(r"^[A-Za-z0-9]"), 0).when(token.rlike(_CLOSING), CLOSING).when(token.rlike(_OPENING), OPENING).when(token.rlike(_EITHER), EITHER).otherwise(0)
    t = tokens.select("doc_id", "token_idx", "token", F.col("x").cast("double").alias("x"), (F.col("x") + F.col("width")).cast("double").alias("right"), F.col("line_key").cast("double").alias("line_key"), kind.alias("kind"))
    place = (F.col("kind") == 0) & (F.lag("kind").over(along) == 0)
    t = t.withColumn("_place", F.coalesce(place, F.lit(False)).cast("int"))
    t = t.withColumn("_row", F.floor(F.sum("_place").over(along.rowsBetween(W.unboundedPreceding, 0)) / PLACES))
    columns = ("token_idx", "token", "kind", "x", "right", "line_key")
    rows = t.groupBy("doc_id", "_row").agg(F.collect_list(F.struct(*columns)).alias("_t"))
    rows = rows.select("doc_id", "_row", attached(*[F.col(f"_t.{c}") for c in columns]).alias("_g"))
    before = F.sum(F.size("_g.n")).over(W.partitionBy("doc_id").orderBy("_row").rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("_before", F.coalesce(before, F.lit(0)))
    each = rows.select("doc_id", "_before", F.posexplode(F.arrays_zip(F.col("_g.token").alias("token"), F.col("_g.n").alias("n"))).alias("_i", "_z"))
    return each.select("doc_id", (F.col("_before") + F.col("_i")).cast("int").alias("group"), "_z.token", F.col("_z.n").cast("long").alias("n_boxes"))


def document_indents(blocks: DataFrame) -> DataFrame:
    """doc_id, indents: three or more body blocks follow another in their column, and half of them are indented."""
    along = W.partitionBy("doc_id").orderBy("block_idx")
    follows = (F.col("role") == "body") & (F.lag("role").over(along) == "body") & (F.lag("page_index").over(along) == F.col("page_index")) & (F.lag("col").over(along) == F.col("col")) & F.col("starts_indented").isNotNull()
    b = blocks.withColumn("_f", F.coalesce(follows, F.lit(False)))
    n = b.groupBy("doc_id").agg(F.count_if("_f").alias("n"), F.count_if(F.col("_f") & F.col("starts_indented")).alias("k"))
    return n.select("doc_id", ((F.col("n") >= 3) & (F.col("k") >= 0.5 * F.col("n"))).alias("indents"))


def _lower_start(text: Column) -> Column:
    first = F.substring(text, 1, 1)
    return first.rlike(r"\p{L}") & (F.lower(first) == first)


def _folded(blocks: DataFrame, continues, is_main: Column) -> DataFrame:
    """doc_id, block_idx, survivor of each block, by a fold over a document's block heads; texts are not carried along."""
    one = F.struct("block_idx", "role", "page_index", "col", "n_tokens", F.col("_ends").alias("ends"), F.col("_low").alias("low"), F.col("_main").alias("main"), *[c for c in ("ends_full", "starts_indented", "col_width", "indents") if c in blocks.columns])
    b = blocks.withColumn("_ends", ends_sentence(F.col("text"))).withColumn("_low", _lower_start(F.trim("text"))).withColumn("_main", is_main)
    rows = b.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("b"))
    kinds = {f.name: f.dataType for f in rows.schema["b"].dataType.elementType.fields}
    null = lambda c: F.lit(None).cast(kinds[c]).alias(c)
    head = [c for c in kinds if c not in ("low", "indents", "main", "starts_indented")]
    zero = F.struct(F.struct(*[null(c) for c in head], F.lit(0).alias("n_lines")).alias("h"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        h = s["h"]
        joins = F.coalesce(continues(h, x), F.lit(False))
        fresh = F.struct(*[x[c].alias(c) for c in head], F.lit(1).alias("n_lines"))
        # page and column stay the head's; what ends the text is the absorbed block's
        grown = F.struct(*[(x[c] if c in ("ends", "ends_full") else h[c] + x[c] if c == "n_tokens" else h[c]).alias(c) for c in head], (h["n_lines"] + 1).alias("n_lines"))
        now = F.when(joins, grown).when(x["main"], fresh).otherwise(h)
        return F.struct(now.alias("h"), F.array_append(s["out"], F.when(joins, h["block_idx"]).otherwise(x["block_idx"])).alias("out"))

    z = F.explode(F.arrays_zip(F.transform("b", lambda x: x["block_idx"]), F.aggregate("b", zero, step, lambda s: s["out"])).cast("array<struct<block_idx:int,survivor:int>>"))
    return rows.select("doc_id", z.alias("z")).select("doc_id", "z.block_idx", "z.survivor")


def merge_across_pages(blocks: DataFrame) -> DataFrame:
    """doc_id, block_idx, survivor: body blocks that carry on the last main-stream block over a column or page break."""

    def continues(h: Column, x: Column) -> Column:
        later = (x["page_index"] > h["page_index"]) | ((x["page_index"] == h["page_index"]) & (x["col"] > h["col"]))
        alike = (h["col_width"] <= 0) | (x["col_width"] <= 0) | (F.abs(h["col_width"] - x["col_width"]) <= F.greatest(h["col_width"], x["col_width"]) * 0.25)
        heading_like = (h["n_lines"] <= HEADING_LINES) & (h["n_tokens"] <= HEADING_TOKENS)
        flush = x["indents"] & ~x["starts_indented"]
        goes_on = F.when(h["ends"], flush & h["ends_full"]).otherwise(x["low"] | (flush & ~heading_like))
        return (h["role"] == "body") & (x["role"] == "body") & later & alike & (x["n_tokens"] > 0) & goes_on

    b = blocks.join(document_indents(blocks), "doc_id")
    return _folded(b, continues, F.col("role").isin("body", "heading", "caption"))


def merge_pages_simple(blocks: DataFrame) -> DataFrame:
    """doc_id, block_idx, survivor: a body block on a later page carries on the body block right before it, if that does
    not end a sentence and it starts in lower case."""

    def continues(h: Column, x: Column) -> Column:
        return (h["role"] == "body") & (x["role"] == "body") & (x["page_index"] > h["page_index"]) & ~h["ends"] & x["low"] & (x["n_tokens"] > 0)

    return _folded(blocks, continues, F.lit(True))


def resolve_merged_ids(edges: DataFrame) -> DataFrame:
    """doc_id, absorbed, survivor: chains of merges (doc_id, absorbed, survivor) followed to their end.

    Pointers are doubled until none moves, so a chain of n merges takes about log2(n) joins; a cycle never settles and is
    an error.
    """
    now = edges.select("doc_id", "absorbed", "survivor").dropDuplicates(["doc_id", "absorbed"])
    for _ in range(64):
        step = now.select("doc_id", F.col("absorbed").alias("survivor"), F.col("survivor").alias("further"))
        joined = cut_lineage(now.join(step, ["doc_id", "survivor"], "left"))
        now = joined.select("doc_id", "absorbed", F.coalesce("further", "survivor").alias("survivor"))
        if joined.where("further is not null").isEmpty():
            return now
    raise ValueError("merges go round in a cycle")


def interleave_blocks(blocks: DataFrame) -> DataFrame:
    """blocks (doc_id, page_index, block_idx, role) with rank: a page's blocks with their markers, then its notes."""
    note = F.when(F.col("role") == "footnoteBody", 1).otherwise(0)
    return blocks.withColumn("rank", F.row_number().over(W.partitionBy("doc_id").orderBy("page_index", note, "block_idx")) - 1)
