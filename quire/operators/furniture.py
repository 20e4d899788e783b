"""Page furniture, notes and headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.operators.windows import islands

BAND, REPEATED = 0.08, 0.4
MARKER_HEIGHT, MARKER_LIFT, NOTE_HEIGHT, NOTE_TOP = 0.8, 0.15, 0.85, 0.4
LABEL_TOKENS, LABEL_RUN = 5, 3
HEADING_LINES, HEADING_TOKENS, HEADING_HEIGHT, NUMBERED_HEIGHT = 2, 14, 1.12, 1.06

# fixed values: wording that publishers add to a document
PUBLISHER_PHRASES = (
    "is a not-for-profit service that helps scholars",
    "not-for-profit service that helps scholars, researchers, and students",
    "your use of the jstor archive indicates your acceptance",
    "terms & conditions of use, available at",
    "all use subject to",
    "this content downloaded from",
    "to digitize, preserve and extend access to",
    "range of content in a trusted digital archive",
    "for more information about jstor, please contact",
)


def digit_normal_form(text: Column) -> Column:
    """Lower case, each run of digits as #, other than letters and blanks gone."""
    plain = F.replace(F.lower(text), F.lit("#"), F.lit("."))
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"\p{Nd}+", "#"), r"[^\p{L} #]", ""))


def bare_number(text: Column) -> Column:
    """Digits alone, or a small roman number."""
    core = F.regexp_replace(text, r"^[ .\[\]()\-–—]+|[ .\[\]()\-–—]+$", "")
    return core.rlike(r"^\p{Nd}+$") | core.rlike(r"^[ivxlcdm]{1,7}$")


def repeated_lines(lines: DataFrame) -> DataFrame:
    """doc_id, form, n_pages, page_count of band lines (doc_id, page_index, text, in_band)."""
    count = lines.groupBy("doc_id").agg((F.max("page_index") + 1).alias("page_count"))
    forms = lines.where("in_band").select("doc_id", "page_index", digit_normal_form(F.col("text")).alias("form")).distinct()
    return forms.groupBy("doc_id", "form").agg(F.count("*").alias("n_pages")).join(count, "doc_id")


def furniture_role(lines: DataFrame, share: float = REPEATED) -> DataFrame:
    """Band lines with role: pageNumber, runningHead, or null."""
    band = lines.where("in_band").withColumn("form", digit_normal_form(F.col("text")))
    seen = band.join(repeated_lines(lines), ["doc_id", "form"])
    text = F.trim("text")
    often = (F.col("form") != "") & (F.col("n_pages") / F.col("page_count") >= share)
    role = F.when(text == "", None).when(bare_number(text), "pageNumber").when(often & F.col("form").rlike(r"\p{L}"), "runningHead").when(often, "pageNumber")
    return seen.withColumn("role", role).drop("form", "n_pages", "page_count")


def body_height(lines: DataFrame) -> DataFrame:
    return lines.groupBy("doc_id").agg(F.median("height").alias("body_height"))


def marker_text(text: Column) -> Column:
    core = F.regexp_replace(text, r"^[.,;:)\]]+|[.,;:)\]]+$", "")
    return core.rlike(r"^(\p{Nd}{1,4}|[†‡*§¶‖]{1,4})$")


def note_markers(runs: DataFrame, line: list[str]) -> DataFrame:
    """runs with is_marker: smaller than their line, raised over it, and of marker text."""
    group = W.partitionBy(*line)
    height, base = F.median("glyph_height").over(group), F.median("baseline").over(group)
    r = runs.withColumn("_h", height).withColumn("_b", base)
    mark = (F.col("_h") > 0) & (F.col("glyph_height") < F.col("_h") * MARKER_HEIGHT) & (F.col("baseline") - F.col("_b") > F.col("_h") * MARKER_LIFT) & marker_text(F.col("text"))
    return r.withColumn("is_marker", mark).drop("_h", "_b")


def note_body_lines(lines: DataFrame, body: DataFrame) -> DataFrame:
    """lines (with page y0, y1 as p0, p1) with is_note: from a column's foot up, while lines are small and low."""
    stop = (F.col("height") >= F.col("body_height") * NOTE_HEIGHT) | (F.col("y0") > F.col("p0") + (F.col("p1") - F.col("p0")) * NOTE_TOP)
    along = W.partitionBy("doc_id", "page_index", "col").orderBy("baseline", "line").rowsBetween(W.unboundedPreceding, 0)
    return lines.join(body, "doc_id").withColumn("is_note", (F.col("body_height") > 0) & (F.sum(F.when(stop, 1).otherwise(0)).over(along) == 0)).drop("body_height")


def note_bodies(lines: DataFrame, may_open: Column | None = None) -> DataFrame:
    """doc_id, page_index, note_id, label, text of note lines (seq orders them); a line that opens with a label begins one.

    may_open tells the lines that can, where labels stand apart from text: other lines may open with a number of their own.
    """
    first = F.regexp_replace(F.regexp_extract("text", r"^(\S+)", 1), r"^[.)\]]+|[.)\]]+$", "")
    n = lines.withColumn("_label", F.when(marker_text(first) & (F.lit(True) if may_open is None else may_open), first))
    n = islands(n, ["doc_id", "page_index"], ["seq"], F.col("_label").isNotNull(), "note_id")
    body = F.when(F.col("_label").isNotNull(), F.trim(F.regexp_replace("text", r"^\S+", ""))).otherwise(F.col("text"))
    parts = F.array_sort(F.collect_list(F.struct("seq", body.alias("t"))))
    return n.groupBy("doc_id", "page_index", "note_id").agg(F.max("_label").alias("label"), F.trim(F.array_join(F.transform(parts, lambda x: x["t"]), " ")).alias("text"))


def pair_notes(markers: DataFrame, notes: DataFrame) -> DataFrame:
    """doc_id, page_index, marker, note_id: the page's note of equal label, else the one of the same rank."""
    key = ["doc_id", "page_index"]
    by_label = notes.where("label is not null").groupBy(*key, "label").agg(F.min("note_id").alias("by_label"))
    m = markers.withColumn("_k", F.row_number().over(W.partitionBy(*key).orderBy("marker")) - 1)
    by_rank = notes.select(*key, F.col("note_id").alias("by_rank"), (F.row_number().over(W.partitionBy(*key).orderBy("note_id")) - 1).alias("_k"))
    return m.join(by_label, [*key, "label"], "left").join(by_rank, [*key, "_k"], "left").select(*key, "marker", F.coalesce("by_label", "by_rank").alias("note_id"))


def publisher_boilerplate(text: Column, phrases: tuple[str, ...] = PUBLISHER_PHRASES) -> Column:
    """Whether a text holds any of a few fixed phrases, case and white space aside."""
    flat = F.regexp_replace(F.lower(text), r"(?U)\s+", " ")
    out = F.lit(False)
    for p in phrases:
        out = out | flat.contains(p)
    return out


def ends_sentence(text: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"(?U)\s+$", ""), r"[\p{Nd}*†‡]+$", ""), r"[\"'”’)\]]+$", "")
    return bare.rlike(r"[.!?:;…]$")


def figure_labels(blocks: DataFrame) -> DataFrame:
    """blocks (doc_id, page_index, block_idx, role, text, n_tokens, height, body_height) with is_label_run: three or more
    short blocks of body size in a row on a page that end no sentence and are no list."""
    label = (
        (F.col("role") == "body") & (F.col("n_tokens") <= LABEL_TOKENS) & ((F.col("body_height") <= 0) | (F.col("height") <= F.col("body_height") * 1.05))
        & ~ends_sentence(F.col("text")) & ~F.col("text").rlike(r"^([•·▪◦–—-]|\(?[\p{Nd}ivx]{1,3}[.)])")
    )
    key = ["doc_id", "page_index"]
    b = blocks.withColumn("_label", label)
    b = islands(b, key, ["block_idx"], F.lag("_label").over(W.partitionBy(*key).orderBy("block_idx")) != F.col("_label"), "_run")
    return b.withColumn("is_label_run", F.col("_label") & (F.count("*").over(W.partitionBy(*key, "_run")) >= LABEL_RUN)).drop("_label", "_run")


def unmapped_text(text: Column) -> Column:
    """Whether a text has no letters and digits, or few letters for its length."""
    flat = F.regexp_replace(text, r"(?U)\s+", "")
    letters, digits = F.length(F.regexp_replace(flat, r"[^\p{L}]", "")), F.length(F.regexp_replace(flat, r"[^\p{Nd}]", ""))
    return (letters + digits == 0) | ((F.length(flat) >= 5) & (letters < 0.4 * F.length(flat)))


def section_number(token: Column) -> Column:
    core = F.regexp_replace(token, r"^[.)]+|[.)]+$", "")
    return (F.length(core) <= 8) & ((core.rlike(r"^[0-9.]+$") & core.rlike("[0-9]")) | core.rlike("^[IVXLCDM]+$"))


def headings(blocks: DataFrame) -> DataFrame:
    """blocks (role, text, n_tokens, n_lines, height, body_height) with is_heading."""
    small = (F.col("role") == "body") & (F.col("n_tokens") > 0) & (F.col("n_lines") <= HEADING_LINES) & (F.col("n_tokens") <= HEADING_TOKENS)
    sized = F.col("body_height") > 0
    text = F.trim("text")
    open_end = ~text.rlike(r"[.!?\"”’:;]$")
    numbered = section_number(F.regexp_extract(text, r"^(\S+)", 1))
    return blocks.withColumn("is_heading", small & ((sized & (F.col("height") >= F.col("body_height") * HEADING_HEIGHT)) | (open_end & ((sized & (F.col("height") >= F.col("body_height") * NUMBERED_HEIGHT)) | numbered))))
