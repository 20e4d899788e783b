"""Lines and columns of a page."""

from __future__ import annotations

from bisect import bisect_left
from math import floor

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.operators.windows import islands

SEGMENT_GAP, LINE_TOLERANCE, SMALL = 1.0, 0.35, 0.8
_PAGE = ["doc_id", "page_index"]


def page_skew(lines: DataFrame) -> DataFrame:
    """doc_id, page_index, slope of baselines along x within lines, held to 1.4 degrees; 0 where it cannot be told."""
    centred = W.partitionBy(*_PAGE, "line_key")
    c = lines.withColumn("_dx", F.col("x") - F.avg("x").over(centred)).withColumn("_dy", F.col("baseline") - F.avg("baseline").over(centred))
    fit = c.groupBy(*_PAGE).agg((F.sum(F.col("_dx") * F.col("_dy")) / F.nullif(F.sum(F.col("_dx") ** 2), F.lit(0.0))).alias("s"))
    return fit.select(*_PAGE, F.greatest(F.lit(-0.025), F.least(F.lit(0.025), F.coalesce("s", F.lit(0.0)))).alias("slope"))


def build_segments(runs: DataFrame) -> DataFrame:
    """doc_id, page_index, seq, segment_id of runs (x, width, baseline, glyph_height, seq): stretches of a line without a
    gap of an em, numbered by page in the order in which they begin.

    The runs of a page are taken from left to right (from the top on ties) and each joins the nearest open segment it
    fits, or opens one. It is held against the last run of each segment, so skew does no harm; a small raised or lowered
    run joins without moving its segment's baseline. Open segments are kept by height on the page, and leave once no run
    can reach them any more, so a run meets few of them, however long the page is.
    """

    @F.pandas_udf("array<int>")
    def numbered(x: pd.Series, width: pd.Series, baseline: pd.Series, height: pd.Series, seq: pd.Series) -> pd.Series:
        return pd.Series([_segments(*row) for row in zip(x, width, baseline, height, seq)], dtype=object)

    run = F.struct(*[F.col(c).cast("double").alias(c) for c in ("x", "width", "baseline", "glyph_height")], "seq")
    pages = runs.groupBy(*_PAGE).agg(F.collect_list(run).alias("_runs"))
    pages = pages.withColumn("_ids", numbered(*[F.col(f"_runs.{c}") for c in ("x", "width", "baseline", "glyph_height", "seq")]))
    return pages.select(*_PAGE, F.inline(F.arrays_zip(F.col("_runs.seq").alias("seq"), F.col("_ids").alias("segment_id")))).toDF(*_PAGE, "seq", "segment_id")


def _segments(x, width, baseline, height, seq) -> list[int]:
    """The number of each run's segment."""
    order = np.lexsort((seq, -baseline, x)).tolist()
    most = float(height.max())
    # what a run may join has its baseline at most so far away
    step = most * 0.75 * 1.0001 if most > 0 else 1.0
    xs, widths, bases, heights = (c.tolist() for c in (x, width, baseline, height))
    rows: dict[int, list] = {}  # open segments: right, baseline, height, number
    ids, n = [0] * len(xs), 0
    for i in order:
        at, base, tall = xs[i], bases[i], heights[i]
        row, best = floor(base / step), None
        for near in (row - 1, row, row + 1):
            here = rows.get(near)
            if not here:
                continue
            gone = False
            for s in here:
                gap, rise, em = at - s[0], abs(base - s[1]), max(tall, s[2])
                if gap > SEGMENT_GAP * most:
                    gone = True
                if rise <= 0.75 * em and -0.5 * em <= gap <= SEGMENT_GAP * em:
                    on_line = rise <= LINE_TOLERANCE * min(tall, s[2])
                    script = tall < s[2] * SMALL and 0.1 * s[2] < rise <= 0.75 * s[2]
                    if on_line or script:
                        found = (rise + (s[2] if script else 0.0) + max(0.0, gap) * 0.01, s[3], not on_line, s, near)
                        best = found if best is None or found[:2] < best[:2] else best
            if gone:
                rows[near] = [s for s in here if at - s[0] <= SEGMENT_GAP * most]
        if best is None:
            rows.setdefault(row, []).append([at + widths[i], base, tall, n])
            ids[i], n = n, n + 1
            continue
        s = best[3]
        ids[i], s[0] = s[3], at + widths[i]
        if not best[2]:
            s[1], s[2] = base, tall
            if best[4] != row:
                rows[best[4]] = [o for o in rows[best[4]] if o is not s]
                rows.setdefault(row, []).append(s)
    return ids


def segments_of(runs: DataFrame) -> DataFrame:
    """doc_id, page_index, segment_id, x0, x1, y0, y1, baseline, height of runs with segment_id."""
    r = runs.withColumn("_y", F.col("baseline") - 0.2 * F.col("glyph_height"))
    return r.groupBy(*_PAGE, "segment_id").agg(
        F.min("x").alias("x0"), F.max(F.col("x") + F.col("width")).alias("x1"), F.min("_y").alias("y0"), F.max(F.col("_y") + F.col("glyph_height")).alias("y1"),
        F.median("baseline").alias("baseline"), F.median("glyph_height").alias("height"),
    )


def _gutter(x0, x1, y0, y1, height):
    """(x, width) of the strip that almost nothing crosses, or None, of segments' edges in arrays of numpy.

    How many lines cross a place changes at their ends only, so that the work grows with segments, not with the width."""
    left, right, em = x0.min(), x1.max(), np.median(height)
    if len(x0) < 6 or not right > left:
        return None
    extent = right - left
    low, high = np.floor(left + extent * 0.25), np.ceil(left + extent * 0.75)
    line = x1 - x0 >= em * 3
    x0, x1, y0, y1 = x0[line], x1[line], y0[line], y1[line]
    a, b = np.maximum(low, np.ceil(x0)), np.minimum(high, np.floor(x1))
    a, b = a[a <= b], b[a <= b] + 1
    at = np.unique(np.concatenate([[low, high + 1], a, b]))
    change = np.bincount(np.searchsorted(at, a), minlength=len(at)) - np.bincount(np.searchsorted(at, b), minlength=len(at))
    crossed = np.cumsum(change)[:-1]
    fewest = crossed.min()
    edge = np.diff(np.concatenate([[0], (crossed == fewest).astype(int), [0]]))
    starts, ends = at[edge == 1], at[edge == -1]
    best = np.argmax(ends - starts)
    strip, x = ends[best] - starts[best], starts[best] + (ends[best] - starts[best]) / 2
    l_, r = x1 <= x, x0 >= x
    if not (fewest <= len(x0) * 0.35 and strip >= max(3.0, em * 0.4) and l_.sum() >= 3 and r.sum() >= 3):
        return None
    wide = x1 - x0
    if not (np.median(wide[l_]) >= extent * 0.22 and np.median(wide[r]) >= extent * 0.22):
        return None
    top_l, top_r, foot_l, foot_r = y1[l_].max(), y1[r].max(), y0[l_].min(), y0[r].min()
    return (x, strip) if min(top_l, top_r) - max(foot_l, foot_r) >= min(top_l - foot_l, top_r - foot_r) * 0.5 else None


def find_gutter(segments: DataFrame, keys: list[str] = _PAGE) -> DataFrame:
    """keys, x, width of the strip that almost nothing crosses, with columns of text on both sides of it. The segments of
    a page are gathered in one row."""

    @F.pandas_udf("struct<x:double,width:double>")
    def gutter(x0: pd.Series, x1: pd.Series, y0: pd.Series, y1: pd.Series, height: pd.Series) -> pd.DataFrame:
        found = [_gutter(*(np.asarray(c, dtype=float) for c in row)) or (None, None) for row in zip(x0, x1, y0, y1, height)]
        return pd.DataFrame(found, columns=["x", "width"], dtype=float)

    edges = ("x0", "x1", "y0", "y1", "height")
    rows = segments.groupBy(*keys).agg(F.collect_list(F.struct(*[F.col(c).cast("double").alias(c) for c in edges])).alias("_s")).where(F.size("_s") >= 6)
    found = rows.select(*keys, gutter(*[F.col(f"_s.{c}") for c in edges]).alias("_g"))
    return found.where("_g.x is not null").select(*keys, F.col("_g.x").alias("x"), F.col("_g.width").cast("long").alias("width"))


def lines_of_region(runs: DataFrame) -> DataFrame:
    """runs (doc_id, page_index, col, seq, baseline, glyph_height, x) with line_id: one line while baselines agree."""
    r = runs.withColumn("_down", -F.col("baseline"))
    step = F.col("_down") - F.lag("_down").over(W.partitionBy(*_PAGE, "col").orderBy("_down", "x", "seq"))
    return islands(r, [*_PAGE, "col"], ["_down", "x", "seq"], step > LINE_TOLERANCE * F.col("glyph_height") + 0.5, "line_id").drop("_down")


def line_aggregate(runs: DataFrame) -> DataFrame:
    """Lines of runs with line_id: box, median baseline and height, text in the order of x."""
    r = runs.withColumn("_y", F.col("baseline") - 0.2 * F.col("glyph_height"))
    words = F.array_sort(F.collect_list(F.struct("x", "seq", "text")))
    return r.groupBy(*_PAGE, "col", "line_id").agg(
        F.min("x").alias("x0"), F.max(F.col("x") + F.col("width")).alias("x1"), F.min("_y").alias("y0"), F.max(F.col("_y") + F.col("glyph_height")).alias("y1"), F.median("baseline").alias("baseline"),
        F.median("glyph_height").alias("height"), F.count("*").alias("n_runs"), F.array_join(F.transform(words, lambda x: x["text"]), " ").alias("text"),
    )


def order_runs(runs: DataFrame) -> DataFrame:
    """runs with order_index: dense over the page, by column, line and x."""
    return runs.withColumn("order_index", F.row_number().over(W.partitionBy(*_PAGE).orderBy("col", "line_id", "x", "seq")) - 1)


def attach_superscripts(lines: DataFrame, marks: DataFrame) -> DataFrame:
    """doc_id, page_index, col, mark, host: the nearest line below a line of marker text, within 0.6 of its height."""
    l_ = lines.select(*_PAGE, "col", F.col("line").alias("host"), F.col("baseline").alias("h_base"), F.col("height").alias("h_height"))
    gap = F.col("baseline") - F.col("h_base")
    near = marks.join(l_, [*_PAGE, "col"]).where((gap > 0) & (gap <= 0.6 * F.col("h_height")) & (F.col("height") < SMALL * F.col("h_height")))
    return near.groupBy(*_PAGE, "col", "mark").agg(F.min_by("host", F.struct(gap, F.col("host"))).alias("host"))


def column_gap_histogram(runs: DataFrame, pages: DataFrame, bin_width: float = 10.0) -> DataFrame:
    """doc_id, page_index, split_x: the middle of the longest run of empty bins of word middles, if it is over 15 % of the
    page's width, central, and the page has twelve words."""
    # a page's different middles are gathered where its words are; pages, not words, are joined
    p = runs.groupBy(*_PAGE).agg(F.count("*").alias("n"), F.collect_set(F.col("x") + F.col("width") / 2).alias("_m")).where("n >= 12").join(pages, _PAGE)
    w, last = F.col("x1") - F.col("x0"), F.ceil((F.col("x1") - F.col("x0")) / bin_width).cast("int") - 1
    bins = F.array_sort(F.array_distinct(F.transform("_m", lambda m: F.floor((m - F.col("x0")) / bin_width).cast("int"))))
    p = p.withColumn("_w", w).withColumn("_last", last).withColumn("_b", F.filter(bins, lambda x: (x >= 0) & (x <= last)))
    empty = F.zip_with(F.concat(F.array(F.lit(-1)), "_b"), F.concat("_b", F.array(F.col("_last") + 1)), lambda x, y: F.struct((y - x - 1).alias("len"), (-x - 1).alias("back"), (F.col("x0") + (x + 1 + (y - x - 1) / 2) * bin_width).alias("split_x")))
    good = F.filter(empty, lambda g: (g["len"] * bin_width > 0.15 * F.col("_w")) & (g["split_x"] - F.col("x0") >= 0.3 * F.col("_w")) & (g["split_x"] - F.col("x0") <= 0.7 * F.col("_w")))
    return p.select(*_PAGE, F.array_max(good).alias("_g")).where("_g is not null").select(*_PAGE, "_g.split_x")


def baseline_lines(runs: DataFrame) -> DataFrame:
    """runs with line_id: from the top, a line holds baselines within max(2, half a glyph) of its first one."""
    heights = runs.groupBy(*_PAGE, "col", "baseline").agg(F.max("glyph_height").alias("h"))
    rows = heights.groupBy(*_PAGE, "col").agg(F.reverse(F.array_sort(F.collect_list(F.struct("baseline", "h")))).alias("b"))
    first = F.element_at("b", 1)
    zero = F.struct(first["baseline"].alias("anchor"), first["h"].alias("h"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("out"))

    def step(s, x):
        new = s["anchor"] - x["baseline"] > F.greatest(F.lit(2.0), 0.5 * s["h"])
        n = F.when(new, s["n"] + 1).otherwise(s["n"])
        return F.struct(F.when(new, x["baseline"]).otherwise(s["anchor"]).alias("anchor"), F.when(new, x["h"]).otherwise(s["h"]).alias("h"), n.alias("n"), F.array_append(s["out"], n).alias("out"))

    at = rows.select(*_PAGE, "col", F.explode(F.arrays_zip(F.transform("b", lambda x: x["baseline"]), F.aggregate("b", zero, step, lambda s: s["out"])).cast("array<struct<baseline:double,line_id:int>>")).alias("z"))
    return runs.join(at.select(*_PAGE, "col", "z.baseline", "z.line_id"), [*_PAGE, "col", "baseline"])


def _spanning(order, side, x0, height, baseline) -> list[bool]:
    """Of a region's segments, from the top down, whether each spans: side 0, or right under a segment that does, on its
    margin and of its size. What is under another comes after it, so one pass finds all that follow from others."""
    near, told = [], []
    for i in order:
        near = [k for k in near if baseline[k] - baseline[i] <= height[k] * 1.6]
        spans = side[i] == 0 or any(abs(x0[i] - x0[k]) <= 2 and abs(height[i] - height[k]) <= height[k] * 0.1 and baseline[k] > baseline[i] for k in near)
        near += [i] if spans else []
        told.append(spans)
    return told


def _blocks(spanning, mids, y0, y1, mid) -> list[list]:
    """Spanning segments from the top down in blocks: upper and lower (the middles of its first and last), its foot and
    its segments. A block ends where one of mids, the middles of columns' segments in order, lies between it and the next."""
    blocks = []
    for i in spanning:
        at = bisect_left(mids, y1[i])
        if not blocks or (at < len(mids) and mids[at] < blocks[-1][2]):
            blocks.append([mid[i], mid[i], y0[i], [i]])
        else:
            last = blocks[-1]
            last[1], last[2] = mid[i], min(last[2], y0[i])
            last[3].append(i)
    return blocks


def _page_regions(x0, x1, y0, y1, baseline, height, depth: int) -> list[str | None]:
    """The regions of a page's segments, as reading_regions tells them."""
    mid, region = (y0 + y1) / 2, [""] * len(x0)
    lists = [c.tolist() for c in (x0, y0, y1, mid, baseline, height)]
    l_x0, l_y0, l_y1, l_mid, l_base, l_height = lists
    for _ in range(depth):
        parts: dict[str, list[int]] = {}
        for i, path in enumerate(region):
            if path is not None and not path.endswith(".3/"):
                parts.setdefault(path, []).append(i)
        for path, own in parts.items():
            found = _gutter(*(c[own] for c in (x0, x1, y0, y1, height)))
            if not found:
                continue
            x, slack = found[0], max(4.0, found[1] / 4)
            side = {i: 0 if x - x0[i] > slack and x1[i] - x > slack else 1 if x1[i] - x <= x - x0[i] else 2 for i in own}
            order = sorted(own, key=lambda i: (-l_base[i], l_x0[i]))
            spans = _spanning(order, side, l_x0, l_height, l_base)
            columns = [i for i, s in zip(order, spans) if not s]
            blocks = _blocks(sorted((i for i, s in zip(order, spans) if s), key=lambda i: -l_y1[i]), sorted(l_mid[i] for i in columns), l_y0, l_y1, l_mid)
            place = lambda band, to: f"{path}{band:05d}.{to}/"  # noqa: B023, E731
            for k, block in enumerate(blocks):
                for i in block[3]:
                    region[i] = place(k, 3)
            uppers = np.array([b[0] for b in blocks])
            for i in columns:
                # the band above block k is left once the middle lies under k's first middle, and the next begins under its last
                band = int(np.count_nonzero(uppers > l_mid[i]))
                region[i] = place(band, side[i]) if band == 0 or l_mid[i] < blocks[band - 1][1] else None
    return region


def reading_regions(segments: DataFrame, depth: int = 3) -> DataFrame:
    """segments with region, a path by which regions sort in reading order.

    Each round splits regions that have a gutter into left, right and spanning segments. A line right under a spanning
    one, on its margin and of its size, spans too, and so do those under it. Spanning segments are gathered in blocks
    with no column text between; blocks cut bands; a band is read left, then right, then the block under it. A part of
    the path has the number of the band, then 1 for left, 2 for right or 3 for the block, which is not split further. A
    column's segment beside a block of several lines, between the middles of its first and last, belongs to no band: its
    region is null. A page's segments are gathered in one row, in which all rounds are done.
    """
    edges = ("x0", "x1", "y0", "y1", "baseline", "height")

    @F.pandas_udf("array<string>")
    def regions(x0: pd.Series, x1: pd.Series, y0: pd.Series, y1: pd.Series, baseline: pd.Series, height: pd.Series) -> pd.Series:
        return pd.Series([_page_regions(*(np.asarray(c, dtype=float) for c in row), depth) for row in zip(x0, x1, y0, y1, baseline, height)], dtype=object)

    rest = [c for c in segments.columns if c not in _PAGE]
    pages = segments.groupBy(*_PAGE).agg(F.collect_list(F.struct(*rest)).alias("_s"))
    told = regions(*[F.col(f"_s.{c}").cast("array<double>") for c in edges])
    pages = pages.withColumn("_region", told).select(*_PAGE, F.inline(F.arrays_zip("_s", "_region")))
    return pages.select(*[c if c in _PAGE else F.col(f"_s.{c}") for c in segments.columns], F.col("_region").alias("region"))
