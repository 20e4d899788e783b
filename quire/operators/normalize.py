"""Spoken forms of tokens: affixes, abbreviations, punctuation, numbers, tags and pronunciations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.text import bare
from quire.functions.wordlists import DETERMINERS, HOMOGRAPHS, PREPOSITIONS, SUBJECT_PRONOUNS, UNCONDITIONAL, VERB_CUES
from quire.operators.windows import cut_lineage

#: Most tokens of a lexicon that are broadcast; none of them is long.
FREQUENT = 100_000

_EDGE = r"[^\p{L}\p{N}]"


def token_affixes(tokens: DataFrame) -> DataFrame:
    """tokens with lead, core and trail; a token of punctuation alone is all lead."""
    t = F.col("token")
    lead = F.regexp_extract(t, rf"^({_EDGE}*)", 1)
    rest = F.substring(t, F.length(lead) + 1, F.length(t))
    trail = F.regexp_extract(rest, rf"({_EDGE}*)$", 1)
    return tokens.withColumn("lead", lead).withColumn("trail", trail).withColumn("core", F.substring(rest, F.lit(1), F.length(rest) - F.length(trail)))


def expand_abbreviations(tokens: DataFrame) -> DataFrame:
    """doc_id, token_idx, sub_idx, spoken: one row for each spoken token, with the place of the token it came from.

    Two-token readings (et al., pp. A-B) take the second token with them. Wrapping punctuation stays, periods go.
    """
    t = token_affixes(tokens)
    along = W.partitionBy("doc_id").orderBy("token_idx")
    low, kept = F.lower("core"), F.replace(F.col("trail"), F.lit("."), F.lit(""))
    t = t.select("*", low.alias("low"), kept.alias("kept"))
    for c in ("core", "low", "kept", "lead"):
        t = t.withColumn(f"next_{c}", F.lead(c).over(along))
    pages = F.col("next_core").rlike(r"^\d+[-–—]\d+$")
    et_al, pp = (F.col("low") == "et") & (F.col("next_low") == "al"), (F.col("low") == "pp") & pages
    t = t.withColumn("pair", F.coalesce(et_al | pp, F.lit(False)))
    t = t.withColumn("eaten", F.coalesce(F.lag("pair").over(along), F.lit(False))).where("not eaten")
    one = lambda *words: F.array(*[F.concat(*([F.col("lead")] if i == 0 else []), F.lit(w), *([F.col("kept")] if i == len(words) - 1 else [])) for i, w in enumerate(words)])
    span = lambda i: F.regexp_extract("next_core", r"^(\d+)[-–—](\d+)$", i)
    out = F.when(et_al, F.array(F.lit("et"), F.concat(F.lit("al"), F.col("next_kept"))))
    out = out.when(pp, F.array(F.concat("next_lead", F.lit("pages")), span(1), F.lit("to"), F.concat(span(2), F.col("next_kept"))))
    for word, spoken in {"e.g": ("for", "example"), "i.e": ("that", "is"), "cf": ("compare",), "ibid": ("ibid",)}.items():
        out = out.when(F.col("low") == word, one(*spoken))
    return t.select("doc_id", "token_idx", F.posexplode(out.otherwise(F.array("token"))).alias("sub_idx", "spoken"))


def fold_punctuation(text: Column) -> Column:
    """Curly and CJK punctuation, guillemets, brackets and odd spaces to a plain set; runs of blanks to one."""
    text = F.translate(text, "‘’«»", "''“”")
    text = F.translate(text, "“”", '""')
    text = F.translate(text, "()", "«»")
    for wide, plain in zip("、。！，：；？", (", ", ". ", "! ", ", ", ": ", "; ", "? ")):
        text = F.replace(text, F.lit(wide), F.lit(plain))
    text = F.regexp_replace(text, r"(?U)[^\S \n]", " ")
    return F.regexp_replace(F.regexp_replace(text, " {2,}", " "), r"(?<=\n) +(?=\n)", "")


def expand_titles(text: Column) -> Column:
    """Titles before a capitalized word, and etc. inside a sentence."""
    for find, put in ((r"\bD[Rr]\.(?= [A-Z])", "Doctor"), (r"\b(?:Mr\.|MR\.(?= [A-Z]))", "Mister"), (r"\b(?:Ms\.|MS\.(?= [A-Z]))", "Miss"), (r"\b(?:Mrs\.|MRS\.(?= [A-Z]))", "Mrs"), (r"(?i:\betc\.)(?! [A-Za-z])", "etc")):
        text = F.regexp_replace(text, find, put)
    return text


def read_years_times(token: Column) -> Column:
    """Clock times and years as they are said; other tokens as they are."""
    hour, minute = F.regexp_extract(token, r"^(\d+):(\d\d)$", 1), F.regexp_extract(token, r"^(\d+):(\d\d)$", 2).try_cast("int")
    year, right, s = F.substring(token, 1, 4).try_cast("int"), F.substring(token, 3, 2).try_cast("int"), F.when(token.endswith("s"), "s").otherwise("")
    left = F.substring(token, 1, 2)
    time = F.when(minute == 0, F.concat(hour, F.lit(" o'clock"))).when(minute < 10, F.concat(hour, F.lit(" oh "), minute)).otherwise(F.concat(hour, F.lit(" "), minute))
    hundred = year % 1000 >= 100
    said = F.when((year < 1100) | (year % 1000 < 10), token).when(hundred & (right == 0), F.concat(left, F.lit(" hundred"), s)).when(hundred & (right < 10), F.concat(left, F.lit(" oh "), right, s)).otherwise(F.concat(left, F.lit(" "), right, s))
    return F.when(token.rlike(r"^([1-9]|1[0-2]):[0-5]\d$"), time).when(token.rlike(r"^\d{4}s?$"), said).otherwise(token)


def read_money(token: Column) -> Column:
    """Dollar and pound amounts as they are said."""
    dollar = F.substring(token, 1, 1) == "$"
    unit, amount = F.when(dollar, "dollar").otherwise("pound"), F.substring(token, F.lit(2), F.length(token))
    whole, cents = F.regexp_extract(amount, r"^(\d+)", 1), F.rpad(F.regexp_extract(amount, r"\.(\d+)$", 1), 2, "0").try_cast("int")
    plural = lambda x: F.when(x == "1", "").otherwise("s")
    small = F.when(dollar, F.when(cents == 1, "cent").otherwise("cents")).otherwise(F.when(cents == 1, "penny").otherwise("pence"))
    said = F.when(~amount.contains("."), F.concat(amount, F.lit(" "), unit, plural(amount))).otherwise(F.concat(whole, F.lit(" "), unit, plural(whole), F.lit(" and "), cents, F.lit(" "), small))
    return F.when(token.rlike(r"^[$£]\d+(\.\d+)?$"), said).otherwise(token)


def read_decimals_ranges(token: Column) -> Column:
    """Thousands commas go, decimals are said digit by digit, a hyphen between digits is said as to."""
    token = F.regexp_replace(token, r"(?<=\d),(?=\d)", "")
    digits = F.array_join(F.filter(F.split(F.regexp_extract(token, r"\.(\d+)$", 1), ""), lambda x: x != ""), " ")
    token = F.when(token.rlike(r"^\d*\.\d+$"), F.concat(F.regexp_extract(token, r"^(\d*)", 1), F.lit(" point "), digits)).otherwise(token)
    return F.regexp_replace(token, r"(?<=\d)-(?=\d)", " to ")


# fixed values: names of numbers
ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()


def _names(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def _below_hundred(n: Column) -> Column:
    n = n.cast("int")
    ten = F.element_at(_names(TENS), (F.floor(n / 10) - 1).cast("int"))
    return F.when(n < 20, F.element_at(_names(ONES), n + 1)).when(n % 10 == 0, ten).otherwise(F.concat(ten, F.lit(" "), F.element_at(_names(ONES), n % 10 + 1)))


def _below_thousand(n: Column) -> Column:
    n = n.cast("int")
    h = F.floor(n / 100).cast("int")
    hundred = F.concat(F.element_at(_names(ONES), h + 1), F.lit(" hundred"))
    return F.when(n < 100, _below_hundred(n)).when(n % 100 == 0, hundred).otherwise(F.concat(hundred, F.lit(" "), _below_hundred(n % 100)))


def number_words(token: Column) -> Column:
    """Whole numbers below a thousand million in words, years from 1100 to 2099 in pairs; null for other tokens."""
    n = F.when(token.rlike(r"^\d{1,9}$"), token.try_cast("long"))
    million, thousand, rest = F.floor(n / 1_000_000), F.floor(n / 1000) % 1000, n % 1000
    parts = F.array(F.when(million > 0, F.concat(_below_thousand(million), F.lit(" million"))), F.when(thousand > 0, F.concat(_below_thousand(thousand), F.lit(" thousand"))), F.when((rest > 0) | (n == 0), _below_thousand(rest)))
    plain = F.array_join(F.filter(parts, lambda x: x.isNotNull()), " ")
    left, right = F.floor(n / 100), n % 100
    year = F.when(right == 0, F.concat(_below_hundred(left), F.lit(" hundred"))).when(right < 10, F.concat(_below_hundred(left), F.lit(" oh "), _below_hundred(right))).otherwise(F.concat(_below_hundred(left), F.lit(" "), _below_hundred(right)))
    paired = (F.length(token) == 4) & (n >= 1100) & (n <= 2099) & ~((n >= 2000) & (n < 2010))
    return F.when(n.isNotNull(), F.when(paired, year).otherwise(plain))


_PUNCT = r"(?U)(?:\s*[;:,.!?¡¿—…\"«»“”]+\s*)+"


def split_punctuation(texts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, seg_idx, is_punct, text: spoken and punctuation segments in turn."""
    parts = F.regexp_extract_all("text", F.lit(rf"{_PUNCT}|(?:(?!{_PUNCT})(?s:.))+"), F.lit(0))
    return texts.select(*keys, F.posexplode(parts).alias("seg_idx", "text")).withColumn("is_punct", F.col("text").rlike(rf"^{_PUNCT}$"))


def tag_pos(tokens: DataFrame) -> DataFrame:
    """tokens with tag: noun, verb or other, from the words around."""
    along = W.partitionBy("doc_id").orderBy("token_idx")
    t = tokens.withColumn("word", bare(F.col("token")))
    for name, c in (("one", F.lag("word", 1)), ("two", F.lag("word", 2)), ("after", F.lead("word", 1))):
        t = t.withColumn(name, F.coalesce(c.over(along), F.lit("")))
    tag = (
        F.when(F.col("word") == "", "other").when(F.col("one").isin(DETERMINERS + PREPOSITIONS), "noun").when(F.col("one").isin(VERB_CUES + SUBJECT_PRONOUNS), "verb")
        .when(F.col("two").isin(DETERMINERS), "noun").when((F.col("token_idx") == 0) & F.col("after").isin(DETERMINERS), "verb").otherwise("other")
    )
    return t.withColumn("tag", tag).drop("one", "two", "after", "word")


def homographs(tagged: DataFrame) -> DataFrame:
    """Tagged tokens with phonemes where their spelling has more than one reading: fixed ones first, then by tag."""
    rows = [(w, p, p) for w, p in UNCONDITIONAL.items()] + [(w, n, v) for w, (n, v) in HOMOGRAPHS.items()]
    table = F.broadcast(tagged.sparkSession.createDataFrame(rows, "core string, noun string, verb string"))
    t = tagged.withColumn("core", bare(F.col("token"))).join(table, "core", "left")
    return t.withColumn("phonemes", F.when(F.col("tag") == "verb", F.col("verb")).otherwise(F.col("noun"))).drop("noun", "verb", "core")


def _frequent(counts: DataFrame) -> Column:
    """Which rows of counts (token, n, phonemes) may be broadcast: those of the highest counts, FREQUENT at most, without
    long ones. Counts are told apart by quarters of a doubling, so few numbers reach the driver."""
    step, taken, least = F.floor(F.log2("n") * 4), 0, None
    for row in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("rows"), F.min("n").alias("least")).collect(), reverse=True):
        taken += row["rows"]
        if taken > FREQUENT:
            break
        least = row["least"]
    return F.lit(False) if least is None else (F.col("n") >= least) & (F.length("token") <= 64) & (F.length("phonemes") <= 256)


def pronounce_join(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """tokens with phonemes from a lexicon (word, phonemes), letter by letter for words it lacks, one group for each token.

    Each different token is made bare and looked up once; the row count stays, since words of the lexicon are made
    distinct. Tokens that occur often meet theirs where they stand, so only the others are shuffled.
    """
    once = lexicon.groupBy("word").agg(F.min("phonemes").alias("phonemes"))
    seen = tokens.groupBy("token").agg(F.count("*").alias("n")).where("token is not null").withColumn("word", bare(F.col("token")))
    spelled = F.array_join(F.filter(F.split("word", ""), lambda x: x != ""), "-")
    said = seen.join(once, "word", "left").select("token", "n", F.coalesce("phonemes", spelled).alias("phonemes"), F.col("phonemes").isNull().alias("spelled"))
    said = cut_lineage(said)
    often = _frequent(said)
    frequent, rest = said.where(often).drop("n"), said.where(~often).drop("n")
    near = tokens.join(F.broadcast(frequent), "token")
    far = tokens.join(F.broadcast(frequent.select("token")), "token", "left_anti").join(rest, "token")
    columns = [*tokens.columns, "phonemes", "spelled"]
    return near.select(columns).unionByName(far.select(columns))


def phoneme_postprocess(phonemes: Column, american: bool = True) -> Column:
    """Remaps of the symbols of a letter-to-sound engine to those of the vocabulary."""
    # fixed values: symbol remaps
    for find, put in (("kəkˈoːɹoʊ", "kˈoʊkəɹoʊ"), ("kəkˈɔːɹəʊ", "kˈəʊkəɹəʊ"), ("ʲ", "j"), ("r", "ɹ"), ("x", "k"), ("ɬ", "l")):
        phonemes = F.replace(phonemes, F.lit(find), F.lit(put))
    phonemes = F.regexp_replace(phonemes, "(?<=[a-zɹː])(?=hˈʌndɹɪd)", " ")
    phonemes = F.regexp_replace(phonemes, ' z(?=[;:,.!?¡¿—…"«»“” ]|$)', "z")
    return F.trim(F.regexp_replace(phonemes, "(?<=nˈaɪn)ti(?!ː)", "di") if american else phonemes)
