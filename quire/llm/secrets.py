"""Secret scans with DataFrame operations only: fixed patterns, and sliding-window entropy over candidate strings.

Three base kinds are found by pattern: assign (a value given to a password, token or the like), access (key ids) and hex
(long lower-case hexadecimal runs). The kind entropy adds spans: each run of 20 or more characters of the base64
alphabet is a candidate; a window of 20 characters slides over it and the Shannon entropy of its characters is kept up
by counts, one character in and one out. A window counts if it holds letters and digits and reaches the threshold of
its own class: hex, if all its letters are hexadecimal ones of one case and nothing else stands between, or mixed. So a
hexadecimal secret glued to a name is judged as one. Windows that meet an allow-listed stretch do not count. The windows
that count make one span of the candidate, from the first one's start to the last one's end. The allow list never takes
base spans away.

Places are found from the lengths of matches and of what stands between them, summed along the text. Texts are read once;
time and memory grow in proportion to a text's length, also for one unbroken run of megabytes: no pattern backtracks over
repeated groups, and each character changes two packed counters. Defined results: null or empty text has no spans. Starts
and ends are code points, the end exclusive. Repeated rows, null doc_ids and other columns change nothing; an empty table
gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed patterns of the base kinds
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
LEAST_VALUE = 8

WINDOW = 20
#: Runs of the base64 alphabet.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}+"
#: Bits for each character that a window must reach, by class.
HEX_BITS, MIXED_BITS = 3.0, 3.7
#: Stretches that are no secrets: identifiers of the UUID form, sample strings, and candidates that are paths of small letters.
ALLOWED = (
    r"(?<![0-9A-Za-z])[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![0-9A-Za-z])", r"(?i:example|placeholder|x{4,})",
    r"^/?+[a-z]++(?:[0-9]{0,3}+/[a-z]++)++[0-9]{0,3}+$",
)
KINDS = ("assign", "access", "hex", "entropy")
#: Stands for an allow-listed character.
_MASK = "."
#: Code of a character of the alphabet: its number less this one. Twelve counters of five bits stand in a word.
_FIRST, _CODES, _A_WORD, _BITS = ord("+"), ord("z") - ord("+") + 1, 12, 5
#: Kinds of characters, each a counter: digits, small and capital hexadecimal letters, other letters, signs, masked ones.
_SORTS = ("0123456789", "abcdef", "ABCDEF", "ghijklmnopqrstuvwxyzGHIJKLMNOPQRSTUVWXYZ", "+/_=-", _MASK)


def masked(text: Column, allowed: tuple[str, ...] = ALLOWED) -> Column:
    """text with every character of allow-listed stretches masked."""
    pattern = "|".join(allowed)
    sizes = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    return F.array_join(F.zip_with(F.split(text, pattern, -1), sizes, lambda piece, n: F.concat(piece, F.repeat(F.lit(_MASK), F.coalesce(n, F.lit(0))))), "")


def _units(counts: Column) -> Column:
    """x * log2(x), 0 for 0."""
    return F.when(counts > 1, counts * F.log2(counts)).otherwise(F.lit(0.0))


def entropy_span(text: Column, window: int = WINDOW, hex_bits: float = HEX_BITS, mixed_bits: float = MIXED_BITS) -> Column:
    """first, last: the ends of the first and the last window of text that counts; 0 if none does.

    The sum of x * log2(x) over the window's character counts x follows from the one before by the character that comes
    in and the one that goes out.
    """
    if not 1 < window < 1 << _BITS:
        raise ValueError("a window's counts must fit five bits")
    right = lambda x, n: F.call_function("shiftright", x, n)
    counter = lambda x, n: right(x, n).bitwiseAND(F.lit((1 << _BITS) - 1))
    sort_of = [next((1 << _BITS * k for k, some in enumerate(_SORTS) if chr(_FIRST + c) in some), 0) for c in range(_CODES)]
    sorts = F.array(*[F.lit(x).cast("long") for x in sort_of])
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c) - _FIRST)
    behind = F.slice(F.concat(F.array_repeat(F.lit(-1), window), codes), F.lit(1), F.size(codes))
    zero = F.struct(
        F.array_repeat(F.lit(0).cast("long"), -(-_CODES // _A_WORD)).alias("counts"), F.lit(0).cast("long").alias("sorts"), F.lit(0.0).alias("units"), F.lit(0).alias("i"), F.lit(0).alias("first"), F.lit(0).alias("last"),
    )

    def step(s: Column, p: Column) -> Column:
        i, full = s["i"] + 1, p["out"] >= 0
        moved = p["into"] != p["out"]
        word = lambda c: F.floor(F.greatest(c, F.lit(0)) / _A_WORD).cast("int")
        place = lambda c: (F.greatest(c, F.lit(0)) % _A_WORD) * _BITS
        one = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), place(c))
        held = lambda c: counter(F.element_at(s["counts"], word(c) + 1), place(c))
        new, old = held(p["into"]), held(p["out"])
        counts = F.transform(s["counts"], lambda x, k: x + F.when(k == word(p["into"]), one(p["into"])).otherwise(F.lit(0).cast("long")) - F.when(full & (k == word(p["out"])), one(p["out"])).otherwise(F.lit(0).cast("long")))
        units = s["units"] + _units(new + 1) - _units(new) + F.when(full, _units(old - 1) - _units(old)).otherwise(0.0)
        counts, units = F.when(moved, counts).otherwise(s["counts"]), F.when(moved, units).otherwise(s["units"])
        kinds = s["sorts"] + F.element_at(sorts, p["into"] + 1) - F.when(full, F.element_at(sorts, F.greatest(p["out"], F.lit(0)) + 1)).otherwise(F.lit(0).cast("long"))
        return F.struct(counts.alias("counts"), kinds.alias("sorts"), units.alias("units"), i.alias("i"), s["first"].alias("first"), s["last"].alias("last"))

    # what a step makes is bound to a name before it is judged, so that it is worked out once
    def whole(s: Column, p: Column) -> Column:
        return F.transform(F.array(step(s, p)), lambda t: _judge(t))[0]

    def _judge(t: Column) -> Column:
        digits, small, capital, letters, signs, mask = (counter(t["sorts"], F.lit(_BITS * k)) for k in range(len(_SORTS)))
        bits = F.when((letters == 0) & (signs == 0) & ((small == 0) | (capital == 0)), hex_bits).otherwise(mixed_bits)
        entropy = F.round(F.lit(window * math.log2(window)) - t["units"], 9)
        hit = (t["i"] >= window) & (mask == 0) & (digits > 0) & (small + capital + letters > 0) & (entropy >= bits * window)
        first, last = F.when(hit & (t["first"] == 0), t["i"]).otherwise(t["first"]), F.when(hit, t["i"]).otherwise(t["last"])
        return F.struct(*[t[k].alias(k) for k in ("counts", "sorts", "units", "i")], first.alias("first"), last.alias("last"))

    both = F.zip_with(codes, behind, lambda x, y: F.struct(x.alias("into"), y.alias("out")))
    return F.aggregate(both, zero, whole, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))


def _marks(kind: str, pattern: str) -> Column:
    """Each match and the text before it, in order; the text after the last match comes with no match."""
    between, found = F.split("text", pattern, -1), F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    told = F.zip_with(between, found, lambda b, m: F.struct(F.length(b).alias("before"), F.length(m).alias("size"), m.alias("found")))
    return F.struct(F.lit(kind).alias("kind"), told.alias("marks"))


def spans(docs: DataFrame, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """row, doc_id, kind, start, end of each span; rows of a text with null kind come with it, one at least."""
    rows = docs.withColumn("row", F.monotonically_increasing_id())
    kinds = F.when(_suspect(), F.array(_marks("assign", ASSIGN), _marks("access", ACCESS), _marks("hex", HEX), _marks("entropy", CANDIDATE)))
    each = rows.select("row", "doc_id", F.explode_outer(kinds).alias("k")).select("row", "doc_id", "k.kind", F.posexplode_outer("k.marks").alias("n", "m"))
    along = Window.partitionBy("row", "kind").orderBy("n")
    end = F.sum(F.col("m.before") + F.coalesce("m.size", F.lit(0))).over(along)
    found = each.select("row", "doc_id", "kind", end.alias("end"), F.col("m.size").alias("size"), F.col("m.found").alias("found")).withColumn("start", F.col("end") - F.col("size"))
    text = F.col("found")
    entropic = F.col("kind") == "entropy"
    found = found.withColumn("hot", F.when(entropic & text.rlike("[0-9]") & text.rlike("[A-Za-z]"), entropy_span(masked(text, allowed))))
    value = F.length(F.regexp_extract(text, ASSIGN, 2))
    kept = F.when(F.col("size").isNull(), False).when(F.col("kind") == "assign", value >= LEAST_VALUE).when(entropic, F.coalesce(F.col("hot.last") > 0, F.lit(False))).otherwise(True)
    return found.select(
        "row", "doc_id", F.when(kept, F.col("kind")).alias("kind"),
        F.when(entropic, F.col("start") + F.col("hot.first") - WINDOW).otherwise(F.col("start")).alias("start"), F.when(entropic, F.col("start") + F.col("hot.last")).otherwise(F.col("end")).alias("end"),
    )


def _suspect() -> Column:
    """Whether any kind may match."""
    text = F.coalesce("text", F.lit(""))
    return text.rlike(r"(?i)passw|secret|token|api_?key") | text.contains("AKIA") | text.rlike(CANDIDATE)


def _joined(all_spans: Column) -> Column:
    return F.array_join(F.transform(all_spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["order"]), s["start"], s["end"])), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy of each row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = F.when(F.col("kind").isNotNull(), F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int"))
    one = F.when(F.col("kind").isNotNull(), F.struct(F.col("start").cast("int").alias("start"), order.alias("order"), F.col("end").cast("int").alias("end")))
    hot = spans(docs).groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(one)).alias("all"))
    count = lambda k: F.size(F.filter("all", lambda s: s["order"] == k)).cast("long")
    return hot.select(
        "doc_id", count(1).alias("n_assign"), count(2).alias("n_access"), count(3).alias("n_hex"),
        F.sha2(_joined(F.filter("all", lambda s: s["order"] <= 3)), 256).alias("base_sha256"), _joined(F.col("all")).alias("spans"), count(4).alias("n_entropy"),
    )
