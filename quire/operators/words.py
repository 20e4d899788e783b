"""Words from positioned text items, and pages' geometry."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.operators.windows import islands

ROTATION, SHIFT, WORD_GAP, OVERLAP = 0.2, 0.2, 0.15, 0.3
_ACCENT = r"[¨´`ˆ˜¸˚ˇ˘¯˝˙̀-ͯ]"
_PAGE = ["doc_id", "page_index"]


def scan_ocr_words(words: DataFrame) -> DataFrame:
    """Recognized words with boxes as runs: trimmed, none empty, size from the box, baseline a fifth above its foot."""
    w = words.withColumn("text", F.trim("text")).where("text <> ''")
    return w.withColumn("glyph_height", F.col("height")).withColumn("baseline", F.col("y") + 0.2 * F.col("height"))


def char_runs(chars: DataFrame) -> DataFrame:
    """doc_id, page_index, word, text, x0, x1, y0, size from characters with boxes, cut at white space."""
    blank = F.trim("char") == ""
    along = W.partitionBy(*_PAGE).orderBy("seq")
    c = chars.withColumn("_blank", blank).withColumn("word", F.sum(F.when(blank, 1).otherwise(0)).over(along.rowsBetween(W.unboundedPreceding, 0))).where("not _blank")
    boxed = (F.col("width") > 0) & (F.col("height") > 0)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "char"))), lambda x: x["char"]), "")
    out = c.groupBy(*_PAGE, "word").agg(
        text.alias("text"), F.min(F.when(boxed, F.col("x"))).alias("x0"), F.max(F.when(boxed, F.col("x") + F.col("width"))).alias("x1"), F.min(F.when(boxed, F.col("y"))).alias("y0"),
        F.max(F.when(boxed, F.col("height"))).alias("_h"), F.median("point_size").alias("_s"),
    )
    return out.withColumn("size", F.coalesce("_s", "_h")).drop("_s", "_h")


def page_space(boxes: DataFrame) -> DataFrame:
    """boxes (x, y, width, height from 0 to 1, rotation, page_width, page_height) in page coordinates: x0, y0, x1, y1."""
    turn = F.pmod(F.round(F.col("rotation") / 90).cast("int"), F.lit(4))

    def corner(u: Column, w: Column) -> tuple[Column, Column]:
        x = F.when(turn == 0, u).when(turn == 1, F.lit(1.0) - w).when(turn == 2, F.lit(1.0) - u).otherwise(w)
        y = F.when(turn == 0, w).when(turn == 1, u).when(turn == 2, F.lit(1.0) - w).otherwise(F.lit(1.0) - u)
        return x * F.col("page_width"), y * F.col("page_height")

    ends = [corner(u, w) for u in (F.col("x"), F.col("x") + F.col("width")) for w in (F.col("y"), F.col("y") + F.col("height"))]
    xs, ys = [e[0] for e in ends], [e[1] for e in ends]
    return boxes.withColumns({"x0": F.least(*xs), "y0": F.least(*ys), "x1": F.greatest(*xs), "y1": F.greatest(*ys)})


def page_box(pages: DataFrame) -> DataFrame:
    """pages with their rectangle from any two corners: left, bottom, w, h, area."""
    w, h = F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))
    return pages.withColumns({"left": F.least("x0", "x1"), "bottom": F.least("y0", "y1"), "w": w, "h": h, "area": w * h})


def doc_title(docs: DataFrame) -> DataFrame:
    """docs (title, name) with the title that is not blank, else the name without its ending."""
    return docs.withColumn("title", F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.regexp_replace("name", r"(?i)\.pdf$", "")))


def content_hash(files: DataFrame, content: str = "content") -> DataFrame:
    return files.withColumn("hash", F.sha2(F.col(content).cast("binary"), 256))


def drop_rotated(items: DataFrame) -> DataFrame:
    """items without turned ones; break_before tells those that follow a dropped one."""
    turned = F.greatest(F.abs("b"), F.abs("c")) > ROTATION * F.greatest(F.abs("a"), F.abs("d"))
    along = W.partitionBy(*_PAGE).orderBy("item_seq")
    i = items.withColumn("_turned", turned).withColumn("break_before", F.coalesce(F.lag("_turned").over(along), F.lit(False)))
    return i.where("not _turned").drop("_turned")


def split_items(items: DataFrame) -> DataFrame:
    """Pieces of items between white space, with x0 and x1 in proportion to characters, and space before and after.

    White-space items give no piece, but the piece before them gets a space after.
    """
    n = F.length("str")
    # most items hold no white space: they are one piece, and none of what follows is worked out for them
    plain = ~F.col("str").rlike(r"(?U)\s")
    found = F.when(plain, F.array("str")).otherwise(F.regexp_extract_all("str", F.lit(r"(?U)\S+"), F.lit(0)))
    gaps = F.when(plain, F.array(F.lit(0), F.lit(0))).otherwise(F.transform(F.split("str", r"(?U)\S+", -1), F.length))
    blank = ~F.col("str").rlike(r"(?U)\S")
    along = W.partitionBy(*_PAGE).orderBy("item_seq")
    i = items.where(n > 0).withColumn("_blank", blank)
    i = i.withColumn("_blank_next", F.coalesce(F.lead("_blank").over(along), F.lit(False))).where("not _blank").drop("_blank")
    i = i.withColumn("_words", found).withColumn("_gaps", gaps)
    i = i.select("*", F.posexplode("_words").alias("piece", "text"))
    first = F.element_at("_gaps", 1)
    later = F.aggregate(F.slice("_gaps", 1, F.col("piece") + 1), F.lit(0), lambda a, x: a + x) + F.aggregate(F.slice("_words", F.lit(1), F.col("piece")), F.lit(0), lambda a, x: a + F.length(x))
    start = F.when(F.col("piece") == 0, first).otherwise(later)
    unit = F.col("width") / n
    i = i.withColumn("_at", start)
    last = F.col("piece") == F.size("_words") - 1
    after = (F.element_at("_gaps", F.col("piece") + 2) > 0) | (last & (F.col("has_eol") | F.col("_blank_next")))
    return i.withColumns({"x0": F.col("x") + unit * F.col("_at"), "x1": F.col("x") + unit * (F.col("_at") + F.length("text")), "space_before": F.element_at("_gaps", F.col("piece") + 1) > 0, "space_after": after}).drop("_words", "_gaps", "_at", "_blank_next")


def join_pieces(pieces: DataFrame) -> DataFrame:
    """pieces with word_id: neighbours without space, on one line and close enough are one word."""
    order = ["item_seq", "piece"]
    along = W.partitionBy(*_PAGE).orderBy(*order)
    p = pieces
    for c in ("x1", "height", "baseline", "space_after", "text"):
        p = p.withColumn(f"_{c}", F.lag(c).over(along))
    em, gap = F.greatest("height", "_height"), F.col("x0") - F.col("_x1")
    accent = F.col("_text").rlike(f"{_ACCENT}$") | F.col("text").rlike(f"^{_ACCENT}")
    near = (F.abs(F.col("baseline") - F.col("_baseline")) <= SHIFT * F.least("height", "_height")) & (gap <= WORD_GAP * em) & (gap >= F.when(accent, -em).otherwise(-em * OVERLAP))
    joins = ~F.col("_space_after") & ~F.col("space_before") & ~((F.col("piece") == 0) & F.col("break_before")) & near
    return islands(p, _PAGE, order, ~joins, "word_id").drop("_x1", "_height", "_baseline", "_space_after", "_text")


def assemble_word(pieces: DataFrame) -> DataFrame:
    """doc_id, page_index, word_id, text, x, width, y, height, glyph_height, baseline; the longest piece sets the line."""
    one = F.array_sort(F.collect_list(F.struct("item_seq", "piece", "text")))
    main = lambda c: F.max_by(c, F.struct(F.length("text"), -F.col("item_seq"), -F.col("piece")))
    out = pieces.groupBy(*_PAGE, "word_id").agg(
        F.array_join(F.transform(one, lambda x: x["text"]), "").alias("text"), F.min("x0").alias("x"), (F.max("x1") - F.min("x0")).alias("width"), F.max("height").alias("height"),
        main("height").alias("glyph_height"), main("baseline").alias("baseline"),
    )
    return out.withColumn("y", F.col("baseline") - 0.2 * F.col("height"))


# fixed values: ligatures, and spacing accents with their combining forms
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
DOTLESS = {"ı": "i", "ȷ": "j"}
ACCENTS = {"¨": "̈", "´": "́", "`": "̀", "ˆ": "̂", "˜": "̃", "¸": "̧", "˚": "̊", "ˇ": "̌", "˘": "̆", "¯": "̄", "˝": "̋", "˙": "̇"}


_MARK = f"[{''.join(ACCENTS)}]"


@cache
def composed(mark: str) -> tuple[str, str]:
    """Letters of all scripts that have one character with a combining mark, and these characters in the same order."""
    pairs = [(x, y) for x in _letters() if len(y := unicodedata.normalize("NFC", x + mark)) == 1]
    return "".join(x for x, _ in pairs), "".join(y for _, y in pairs)


@cache
def _letters() -> list[str]:
    """Letters in canonical composition."""
    return [x for x in map(chr, range(0x41, 0x30000)) if unicodedata.category(x)[0] == "L" and unicodedata.normalize("NFC", x) == x]


@cache
def _reordered() -> dict[str, str]:
    """Letters that a cedilla takes apart, since it stands before the marks above, with what they become."""
    mark = ACCENTS["¸"]
    found = {x: unicodedata.normalize("NFC", x + mark) for x in _letters()}
    return {x: y for x, y in found.items() if len(y) > 1 and y != x + mark}


@cache
def _unstable() -> dict[str, str]:
    """Letters that canonical composition replaces."""
    letters = [x for x in map(chr, range(0x41, 0x30000)) if unicodedata.category(x)[0] == "L"]
    return {x: y for x in letters if (y := unicodedata.normalize("NFC", x)) != x}


def _looked_up(letter: Column, table: dict[str, str]) -> Column:
    """What table has for a letter, or null."""
    single = {x: y for x, y in table.items() if len(y) == 1}
    several = [F.lit(x) for pair in table.items() if len(pair[1]) > 1 for x in pair]
    one = F.translate(letter, "".join(single), "".join(single.values())) if single else letter
    return F.coalesce(F.try_element_at(F.create_map(*several), letter), F.when(one != letter, one))


def _accented(part: Column) -> Column:
    """A letter and its spacing accents, in any order, as one letter with combining marks.

    The cedilla comes first, since it stands under the letter; marks above compose one by one until one does not, and all
    after it follow as they are. No letter composes with more than three marks, so further ones are only appended."""
    before = part.rlike(rf"^{_MARK}\p{{L}}")  # two of the accents are letters themselves
    letter = F.translate(F.when(before, F.substring(part, 2, 1)).otherwise(F.substring(part, 1, 1)), "".join(DOTLESS), "".join(DOTLESS.values()))
    letter = F.coalesce(_looked_up(letter, _unstable()), letter)
    marks = F.when(before, F.concat(F.substring(part, 1, 1), F.substring(part, F.lit(3), F.length(part)))).otherwise(F.substring(part, F.lit(2), F.length(part)))
    under, over = F.regexp_replace(marks, "[^¸]", ""), F.replace(marks, F.lit("¸"), F.lit(""))
    below, cedilla = F.translate(letter, *composed(ACCENTS["¸"])), F.lit(ACCENTS["¸"])
    apart = F.when(under != "", _looked_up(letter, _reordered()))
    lead = F.coalesce(apart, F.when(under == "", letter).when(below != letter, below).otherwise(F.concat(letter, cedilla)))
    # marks compose with the head; the tail is what follows it
    rest, more = F.substring(lead, F.lit(2), F.length(lead)), F.repeat(cedilla, F.greatest(F.length(under) - 1, F.lit(0)))
    tail = F.when(apart.isNull(), F.concat(rest, more)).otherwise(F.concat(more, rest))
    state = F.struct(F.substring(lead, 1, 1).alias("head"), tail.alias("tail"), apart.isNull().alias("open"))

    def step(s: Column, mark: Column) -> Column:
        whole = F.lit(None).cast("string")
        for spacing in ACCENTS:
            if spacing != "¸":
                whole = F.when(mark == spacing, F.translate(s["head"], *composed(ACCENTS[spacing]))).otherwise(whole)
        goes = s["open"] & (whole != s["head"])
        combining = F.translate(mark, "".join(ACCENTS), "".join(ACCENTS.values()))
        return F.struct(F.when(goes, whole).otherwise(s["head"]).alias("head"), F.when(goes, s["tail"]).otherwise(F.concat(s["tail"], combining)).alias("tail"), goes.alias("open"))

    first = F.regexp_extract_all(F.substring(over, 1, 4), F.lit("."), F.lit(0))
    rest = F.translate(F.substring(over, F.lit(5), F.length(over)), "".join(ACCENTS), "".join(ACCENTS.values()))
    return F.concat(F.aggregate(first, state, step, lambda s: F.concat(s["head"], s["tail"])), rest)


_PLAIN = "A-Za-z" + "".join(DOTLESS)


def _one_mark(part: Column) -> Column:
    """The same as _accented for a plain letter with one accent, before or after it, by which nearly all words are told."""
    before = part.rlike(rf"^{_MARK}")
    letter = F.translate(F.when(before, F.substring(part, 2, 1)).otherwise(F.substring(part, 1, 1)), "".join(DOTLESS), "".join(DOTLESS.values()))
    mark = F.when(before, F.substring(part, 1, 1)).otherwise(F.substring(part, 2, 1))
    out = F.lit(None).cast("string")
    for spacing, combining in ACCENTS.items():
        pairs = [(x, y) for x, y in zip(*composed(combining)) if x.isascii()]
        whole = F.translate(letter, "".join(x for x, _ in pairs), "".join(y for _, y in pairs)) if pairs else letter
        out = F.when(mark == spacing, F.when(whole != letter, whole).otherwise(F.concat(letter, F.lit(combining)))).otherwise(out)
    return out


def clean_word(text: Column) -> Column:
    """Ligatures spelled out, soft hyphens resolved, spacing accents composed with the letter after, else before them.

    An accent in front of a letter belongs to it; other accents belong to the letter they follow, and stay where there is
    none. A word is cut once into accented letters and what lies between, in time proportional to its length."""
    for short, long in LIGATURES.items():
        text = F.replace(text, F.lit(short), F.lit(long))
    text = F.regexp_replace(F.regexp_replace(text, "\u00ad(?=.)", ""), "\u00ad$", "-")
    after = rf"{_MARK}[{''.join(m for m in ACCENTS if not m.isalpha())}]*(?!\p{{L}})"  # marks none of which has a letter next
    parts = F.regexp_extract_all(text, F.lit(rf"(?s){_MARK}\p{{L}}(?:{after})?|\p{{L}}{after}|[^{_MARK[1:-1]}]+(?!{_MARK})|."), F.lit(0))
    plain = rf"^(?:{_MARK}[{_PLAIN}]|[{_PLAIN}]{_MARK})\z"
    cut = F.transform(parts, lambda p: F.when(p.rlike(plain), _one_mark(p)).when(p.rlike(rf"^(?:{_MARK}\p{{L}}|\p{{L}}{_MARK})"), _accented(p)).otherwise(p))
    return F.when(text.rlike(_MARK), F.array_join(cut, "")).otherwise(text)


def dedupe_overstrike(runs: DataFrame) -> DataFrame:
    """runs without those that lie over a kept one of the same text by more than half of the smaller area."""
    box = F.struct("seq", "x", "y", "width", "height")
    rows = runs.groupBy(*_PAGE, "text").agg(F.array_sort(F.collect_list(box)).alias("r"))

    def over(a: Column, b: Column) -> Column:
        w = F.least(a["x"] + a["width"], b["x"] + b["width"]) - F.greatest(a["x"], b["x"])
        h = F.least(a["y"] + a["height"], b["y"] + b["height"]) - F.greatest(a["y"], b["y"])
        small = F.least(a["width"] * a["height"], b["width"] * b["height"])
        return (w > 0) & (h > 0) & (small > 0) & (w * h > small * 0.5)

    kept = F.aggregate("r", F.slice("r", F.lit(1), F.lit(0)), lambda k, x: F.when(F.exists(k, lambda y: over(x, y)), k).otherwise(F.array_append(k, x)))
    return rows.select(*_PAGE, F.explode(kept).alias("k")).select(*_PAGE, "k.seq")
