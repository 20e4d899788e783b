"""Benchmark decontamination by a positional inverted index, with DataFrame operations only.

Training texts are stored as postings (term, row, pos). Windows of test items are looked up from their rarest term on:
its postings give candidate places, the second rarest term's postings, moved by the difference of offsets, thin them
out, and the words around what is left are compared in full. Only postings of terms that test items hold are kept, since
no others can be met, and how often each is found in training texts decides which are the rarest.

Defined results: null or wordless text has no words, no hits and no items. An item without words has no window; one of
fewer than `width` words is one window. Null item_ids count as no item for the list of items, but their words are hit.
Repeated rows are handled each. Terms that are equally rare are taken in their own order, then by offset; that decides where
candidates come from, never the result. A text is read whole: its words go to postings one row each, so one very long
text takes more time, not more memory in one place; an unbroken run is one word. Other columns are ignored; empty tables
give empty results or no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import lower_ascii, sized, staged

WIDTH = 10
#: Words that may stand between those of a window for it to be near.
SLOP = 2
#: Everything in ASCII but digits and letters parts words.
_APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased words of a text as an array; null text has none."""
    plain = F.trim(F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), _APART, " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (a hash of the text), words, row (a number of its own); staged, so that row numbers stay."""
    return staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), words(F.col("text")).alias("words")).withColumn("row", F.monotonically_increasing_id()), "words")


def item_words(items: DataFrame) -> DataFrame:
    """item (a number of its own for each row), item_id, words of items that have any."""
    own = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("words")).where(F.size("words") > 0)
    return staged(own.withColumn("item", F.monotonically_increasing_id()), "items")


def windows(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """item, start, terms: every window of `width` words, or the whole of a shorter item."""
    last = F.greatest(F.size("words") - width, F.lit(0))
    return items.select("item", F.explode(F.sequence(F.lit(0), last)).alias("start"), "words").select("item", "start", F.slice("words", F.col("start") + 1, F.lit(width)).alias("terms"))


def postings(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """term, row, pos of every occurrence of the given terms."""
    return rows.select("row", F.posexplode("words").alias("pos", "term")).join(sized(terms.select("term").distinct()), "term", "left_semi").select("term", "row", "pos")


def term_counts(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """term and how often it occurs in training texts, 0 included."""
    found = rows.select(F.explode("words").alias("term")).join(sized(terms), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
    return terms.join(found, "term", "left").select("term", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def window_anchors(phrases: DataFrame, counts: DataFrame, anchors: int = 2) -> DataFrame:
    """phrases (phrase, terms) with the offsets and terms of their rarest terms: t1, o1, and t2, o2 (null if none)."""
    at = phrases.select("phrase", F.posexplode("terms").alias("offset", "term")).join(sized(counts), "term")
    rank = F.row_number().over(Window.partitionBy("phrase").orderBy("n", "term", "offset"))
    # a second anchor is a different term, so repeated terms count at their first place
    first = at.groupBy("phrase", "term", "n").agg(F.min("offset").alias("offset")).withColumn("rank", rank)
    best = first.where(F.col("rank") <= anchors).groupBy("phrase").agg(
        F.max(F.when(F.col("rank") == 1, F.col("term"))).alias("t1"), F.max(F.when(F.col("rank") == 1, F.col("offset"))).alias("o1"), F.max(F.when(F.col("rank") == 1, F.col("n"))).alias("n1"),
        F.max(F.when(F.col("rank") == 2, F.col("term"))).alias("t2"), F.max(F.when(F.col("rank") == 2, F.col("offset"))).alias("o2"),
    )
    return phrases.join(best, "phrase").where("n1 > 0")


def phrase_matches(rows: DataFrame, phrases: DataFrame) -> DataFrame:
    """row, phrase, place of every occurrence of phrases (phrase, terms) in rows (row, words), exactly."""
    terms = staged(phrases.select(F.explode("terms").alias("term")).distinct(), "terms")
    counts = staged(term_counts(rows, terms), "term_counts")
    anchored = staged(window_anchors(phrases, counts), "anchors")
    lists = postings(rows, staged(anchored.select(F.col("t1").alias("term")).unionByName(anchored.select(F.col("t2").alias("term"))).where("term is not null").distinct(), "anchor_terms"))
    lists = staged(lists, "postings")
    one = lists.join(sized(anchored.select("phrase", F.col("t1").alias("term"), "o1", "t2", "o2")), "term")
    one = one.select("phrase", "row", (F.col("pos") - F.col("o1")).alias("place"), F.col("t2").alias("term"), "o2").where("place >= 0")
    single = one.where("term is null").select("phrase", "row", "place")
    pair = one.where("term is not null").withColumn("pos", F.col("place") + F.col("o2")).join(lists, ["term", "row", "pos"], "left_semi").select("phrase", "row", "place")
    found = staged(single.unionByName(pair), "candidates")
    at = found.groupBy("row").agg(F.collect_list(F.struct("phrase", "place")).alias("places"))
    full = rows.join(sized(staged(at, "places")), "row").select("row", "words", F.explode("places").alias("p")).select("row", "words", "p.*")
    same = full.join(sized(phrases), "phrase").where(F.slice("words", F.col("place") + 1, F.size("terms")) == F.col("terms"))
    return same.select("row", "phrase", "place", F.size("terms").alias("size"))


def proximity_matches(rows: DataFrame, phrases: DataFrame, slop: int) -> DataFrame:
    """row, phrase, place, span: stretches of at most size + slop words that hold all the phrase's terms, in any order.

    Like phrases they are looked up from the rarest term on: where the second rarest stands near enough, the words around
    are looked at in full. Postings meet in ranges of positions, so that frequent terms are not paired over a whole text.
    One stretch, the first, is told for each place of the rarest term.
    """
    terms = staged(phrases.select(F.explode("terms").alias("term")).distinct(), "terms")
    counts = staged(term_counts(rows, terms), "term_counts")
    anchored = staged(window_anchors(phrases, counts).withColumn("reach", F.size("terms") + slop).select("phrase", "t1", "t2", "reach"), "anchors")
    wanted = anchored.select(F.col("t1").alias("term")).unionByName(anchored.select(F.col("t2").alias("term"))).where("term is not null").distinct()
    lists = staged(postings(rows, staged(wanted, "anchor_terms")), "postings")
    one = lists.join(sized(anchored.withColumnRenamed("t1", "term")), "term").select("phrase", "row", F.col("pos").alias("place"), F.col("t2").alias("term"), "reach")
    single = one.where("term is null").select("phrase", "row", "place", "reach")
    nearby = F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda k: F.floor(F.col("place") / F.col("reach")) + k))
    reaches = sized(staged(anchored.where("t2 is not null").select(F.col("t2").alias("term"), "reach").distinct(), "reaches"))
    others = lists.join(reaches, "term").withColumn("range", F.floor(F.col("pos") / F.col("reach")))
    pair = one.where("term is not null").withColumn("range", nearby).join(others, ["term", "row", "reach", "range"]).where(F.abs(F.col("pos") - F.col("place")) < F.col("reach"))
    found = staged(single.unionByName(pair.select("phrase", "row", "place", "reach")).distinct(), "candidates")
    at = found.groupBy("row").agg(F.collect_list(F.struct("phrase", "place", "reach")).alias("places"))
    full = rows.join(sized(staged(at, "places")), "row").select("row", "words", F.explode("places").alias("p")).select("row", "words", "p.*").join(sized(phrases.select("phrase", "terms")), "phrase")
    begins = F.sequence(F.greatest(F.col("place") - F.col("reach") + 1, F.lit(0)), F.col("place"))
    first = F.array_min(F.filter(begins, lambda x: F.size(F.array_except("terms", F.slice("words", x + 1, F.col("reach")))) == 0))
    return full.select("row", "phrase", first.alias("place"), F.least(F.col("reach"), F.size("words") - first).alias("span")).where("place is not null").distinct()


def near_items(docs: DataFrame, items: DataFrame, slop: int = SLOP, width: int = WIDTH) -> DataFrame:
    """doc_id, item_id, n_windows: how many different windows of an item have all their words within width + slop words of
    a document; items of fewer words within their own number and slop."""
    rows, tests = numbered(docs), item_words(items)
    cut = staged(windows(tests, width), "windows")
    phrases = staged(cut.select("terms").distinct().withColumn("phrase", F.monotonically_increasing_id()), "phrases")
    owner = staged(cut.join(sized(phrases), "terms").join(sized(tests.select("item", "item_id")), "item").select("phrase", "item_id").distinct(), "owners")
    hits = proximity_matches(rows, phrases, slop).select("row", "phrase").distinct().join(sized(owner), "phrase").groupBy("row", "item_id").agg(F.count("*").alias("n_windows"))
    return hits.join(rows.select("row", "doc_id"), "row").select("doc_id", "item_id", "n_windows")


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, text_key of each row of docs."""
    rows = numbered(docs)
    tests = item_words(items)
    # equal windows are looked up once
    cut = staged(windows(tests, width), "windows")
    phrases = staged(cut.select("terms").distinct().withColumn("phrase", F.monotonically_increasing_id()), "phrases")
    owner = cut.join(sized(phrases), "terms").join(sized(tests.select("item", "item_id")), "item").select("phrase", "item_id").distinct()
    hits = staged(phrase_matches(rows, phrases), "hits")
    covered = hits.select("row", F.explode(F.sequence(F.col("place"), F.col("place") + F.col("size") - 1)).alias("pos")).distinct().groupBy("row").agg(F.count("*").alias("n_hit"))
    named = hits.select("row", "phrase").distinct().join(sized(staged(owner, "owners")), "phrase").groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    found = staged(covered.join(named, "row", "left"), "found")
    ids = F.coalesce(F.col("ids"), F.array().cast("array<string>"))
    return rows.select("row", "doc_id", "text_key", F.size("words").cast("long").alias("n_words")).join(sized(found), "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), "text_key",
    )
