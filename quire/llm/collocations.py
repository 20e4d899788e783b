"""Phrase collocations by top-order marginalisation.

Each word of a piece opens one window: itself and the words that lead it, up to the longest phrase, padded with 0 where
the piece ends. Only these longest windows are counted. Spark's ROLLUP over (lang, w1 .. w4) then sums ever shorter
prefixes: counts of four words, of three, of two and of one come from the one counting, without an explosion of n-grams
for each length.

A phrase that is frequent has only frequent words and pairs of words in it. So the reading that counts words also counts
pairs in hashed buckets, and a window is opened only by a word, and padded from the first pair on, whose bucket reaches
the threshold: no phrase that counts is cut, and few windows of rare words are left. The buckets are a fixed number of
bits whatever the input; where most of them are full, windows stay longer and the results are the same. Words are 64-bit hashes in windows; different
words with one hash are found exactly over the whole vocabulary and given numbers of their own.

Everything after the ROLLUP works on frequent phrases only: cuts are joined with the counts of their parts, inner
phrases with the most frequent longer one, and ranks are taken in parts first, so no language meets in one task.

Defined results: null texts have no words; a null language is `und`, together with the language of that name; repeated
rows each count; ties of score go to the more frequent, then to the smaller phrase in UTF-8 order; an empty table gives
an empty result; texts are read whole, however long, and an unbroken run is one word; columns beside text and lang are
ignored. The cost of a very long text is in proportion to it, in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.common import mix64, sized, staged

LONGEST = 4
#: Buckets of pairs, a power of two: 2 ** 26 bits are 8 MB.
BUCKET_BITS = 26
#: Rows of buckets that are handed on together as one string of bits.
BLOCK_BITS = 16
#: Windows and pairs that a task holds before it hands on their counts, and rows that it hands on at once.
HELD, AT_ONCE = 400_000, 50_000
#: Rows of a language that are ranked in one task.
RANKED = 40_000
#: Words that may share their hash with others before the run is given up.
CLASHES = 10_000
_BREAKS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", b"..........")


class Words(dict):
    """Word to local number. hashes has each word's xxh3; number 0 is the break between pieces."""

    def __init__(self):
        super().__init__({b".": 0})
        self.hashes = np.zeros(1, np.uint64)

    def __missing__(self, word):
        self[word] = n = len(self)
        return n

    def numbers(self, text: bytes) -> np.ndarray:
        """Numbers of a text's words with a break after each piece."""
        tokens = text.translate(_BREAKS).lower().replace(b".", b" . ").split()
        tokens.append(b".")
        return np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))

    def hashed(self) -> np.ndarray:
        if len(self) > len(self.hashes):
            new = list(self)[len(self.hashes) :]
            self.hashes = np.concatenate([self.hashes, np.fromiter((xxhash.xxh3_64_intdigest(w) for w in new), np.uint64, len(new))])
        return self.hashes


def pair_buckets(left: np.ndarray, right: np.ndarray, lang: np.ndarray) -> np.ndarray:
    """Bucket of each pair of word hashes within a language's hash."""
    return (mix64(left * np.uint64(0x9E3779B97F4A7C15) + mix64(right ^ lang)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, Words, np.ndarray, np.ndarray]]:
    """Languages, words, and the numbers of language and word at each place, HELD places or few more at a time."""
    langs, words, flat, own, size = {}, Words(), [], [], 0
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1)):
            if not text.is_valid:
                continue
            n = words.numbers(text.as_py())
            flat.append(n)
            own.append(np.full(len(n), langs.setdefault(lang.as_py(), len(langs)), np.int64))
            size += len(n)
            if size > HELD:
                yield pa.array(list(langs), pa.string()), words, np.concatenate(own), np.concatenate(flat)
                langs, words, flat, own, size = {}, Words(), [], [], 0
    if size:
        yield pa.array(list(langs), pa.string()), words, np.concatenate(own), np.concatenate(flat)


def _handed(columns: dict[str, pa.Array]) -> Iterator[pa.RecordBatch]:
    whole = pa.record_batch(columns)
    for at in range(0, whole.num_rows, AT_ONCE):
        yield whole.slice(at, AT_ONCE)


def _counted(*columns: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of columns (numbers below 2 ** 31) and how often each comes."""
    key, back = columns[0], []
    for c in columns[1:]:
        seen, key = np.unique(key, return_inverse=True)
        back.append((seen, c))
        key = (key.astype(np.int64) << 32) | c
    seen, n = np.unique(key, return_counts=True)
    out = []
    for former, _ in reversed(back):
        out.append(seen & 0xFFFFFFFF)
        seen = former[seen >> 32]
    return [seen, *reversed(out)], n


def _lang_hashes(langs: pa.Array) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) for x in langs.to_pylist()], np.uint64)


def vocabulary(docs: DataFrame, least: int) -> DataFrame:
    """Two kinds of rows: (lang, word, h, n) for every word, and (bucket, n) for buckets of pairs that reach least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, words, own, flat in _held(batches):
            h, by_lang, names = words.hashed(), _lang_hashes(langs), pa.array(list(words), pa.binary())
            some = flat > 0
            (lang, word), n = _counted(own[some], flat[some])
            yield from _handed({"lang": langs.take(pa.array(lang)), "word": names.take(pa.array(word)), "h": pa.array(h[word].view(np.int64)), "bucket": pa.array(np.full(len(n), -1, np.int32)), "n": pa.array(n)})
            pair = np.flatnonzero(some[:-1] & some[1:])
            bucket, n = np.unique(pair_buckets(h[flat[pair]], h[flat[pair + 1]], by_lang[own[pair]]), return_counts=True)
            none = len(n)
            yield from _handed({"lang": pa.nulls(none, pa.string()), "word": pa.nulls(none, pa.binary()), "h": pa.array(np.zeros(none, np.int64)), "bucket": pa.array(bucket.astype(np.int32)), "n": pa.array(n)})

    rows = docs.mapInArrow(run, "lang string, word binary, h long, bucket int, n long")
    return rows.groupBy("lang", "word", "h", "bucket").agg(F.sum("n").alias("n")).where((F.col("bucket") < 0) | (F.col("n") >= least))


def bucket_bits(buckets: DataFrame) -> np.ndarray:
    """A bit for each bucket of the table; at most 2 ** (BUCKET_BITS - 3) bytes."""
    block = F.shiftright("bucket", BLOCK_BITS)

    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(1 << BLOCK_BITS, np.uint8)
        bits[part["bucket"].to_numpy() & ((1 << BLOCK_BITS) - 1)] = 1
        return pd.DataFrame({"block": [key[0]], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    out = np.zeros(1 << (BUCKET_BITS - 3), np.uint8)
    size = 1 << (BLOCK_BITS - 3)
    for r in buckets.select("bucket").distinct().groupBy(block.alias("block")).applyInPandas(pack, "block int, bits binary").collect():
        out[r["block"] * size : (r["block"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return out


def frequent_buckets(counted: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the frequent words' buckets, which are the low bits of their hashes, and of the frequent pairs'."""
    words = counted.where(F.col("bucket") < 0).where(F.col("n") >= least)
    return bucket_bits(words.select(F.col("h").bitwiseAND((1 << BUCKET_BITS) - 1).cast("int").alias("bucket"))), bucket_bits(counted.where("bucket >= 0"))


def _set(bits: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    return (bits[bucket >> 3] >> (bucket & 7).astype(np.uint8)) & 1 == 1


def clashing_words(counted: DataFrame) -> dict[bytes, int]:
    """Words whose hash is another word's or a small number, each with a small number of its own."""
    names = counted.where("bucket < 0")
    shared = names.groupBy("h").agg(F.min("word").alias("x"), F.max("word").alias("y")).where(f"x <> y OR h BETWEEN 0 AND {CLASHES}").select("h")
    found = names.join(shared, "h", "left_semi").select("word").distinct().limit(CLASHES + 1).collect()
    if len(found) > CLASHES:
        raise ValueError(f"more than {CLASHES} words share their hashes")
    return {bytes(w): i + 1 for i, w in enumerate(sorted(bytes(r["word"]) for r in found))}


def windows(docs: DataFrame, bits: tuple[np.ndarray, np.ndarray], clashes: dict[bytes, int]) -> DataFrame:
    """lang, w1 .. w4, n: padded longest windows and how often a task has met each. Columns are 0 from the padding on."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(bits)  # of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_bits, pair_bits = sent.value
        for langs, words, own, flat in _held(batches):
            h, by_lang = words.hashed(), _lang_hashes(langs)
            keys = h.view(np.int64).copy()
            for word, number in clashes.items():
                if word in words:
                    keys[words[word]] = number
            lead = np.append(flat[1:], 0)
            opens = _set(word_bits, (h & np.uint64((1 << BUCKET_BITS) - 1)).astype(np.int64))[flat] & (flat > 0)
            goes = opens & np.append(opens[1:], False)
            pair = np.flatnonzero(goes)
            goes[pair] = _set(pair_bits, pair_buckets(h[flat[pair]], h[flat[pair + 1]], by_lang[own[pair]]))
            columns = [flat]
            for _ in range(LONGEST - 1):  # the next word leads on while every pair so far is frequent
                columns.append(np.where(goes, lead, 0))
                lead, goes = np.append(lead[1:], 0), goes & np.append(goes[1:], False)
            single = opens & (columns[1] == 0)
            (lang, first), n = _counted(own[single], flat[single])
            zero = pa.array(np.zeros(len(n), np.int64))
            yield from _handed({"lang": langs.take(pa.array(lang)), "w1": pa.array(keys[first]), **{f"w{i}": zero for i in range(2, LONGEST + 1)}, "n": pa.array(n)})
            longer = columns[1] > 0
            (lang, *found), n = _counted(own[longer], *[c[longer] for c in columns])
            yield from _handed({"lang": langs.take(pa.array(lang)), **{f"w{i + 1}": pa.array(keys[c]) for i, c in enumerate(found)}, "n": pa.array(n)})

    return docs.mapInArrow(run, f"lang string, {', '.join(f'w{i} long' for i in range(1, LONGEST + 1))}, n long")


def phrase_counts(docs: DataFrame, bits: tuple[np.ndarray, np.ndarray], clashes: dict[bytes, int], least: int) -> DataFrame:
    """lang, size, w1 .. w4 (0 beyond size), f: phrases that come least times or more."""
    names = [f"w{i}" for i in range(1, LONGEST + 1)]
    rolled = windows(docs, bits, clashes).rollup("lang", *names).agg(F.sum("n").alias("f"), F.grouping_id().alias("g"))
    # the grouping id has a one for every column that is summed over, so 2 ** i - 1 for a prefix that leaves i off
    size = F.lit(LONGEST) - F.round(F.log2(F.col("g") + 1)).cast("int")
    last = F.element_at(F.array(F.lit(1), *names), F.col("size") + 1)
    rolled = rolled.withColumn("size", size).where("size >= 1")
    return rolled.where((F.col("f") >= least) & (last != 0)).select("lang", "size", *[F.coalesce(w, F.lit(0)).alias(w) for w in names], "f")


def _slice(start: int, stop: int) -> list:
    """Columns w1 .. of the words from start (0-based) to stop, padded."""
    return [(F.col(f"w{start + i + 1}") if start + i < stop else F.lit(0).cast("long")).alias(f"p{i + 1}") for i in range(LONGEST)]


def _parts(phrases: DataFrame, size: int) -> list[tuple[int, int]]:
    """Places of the proper parts of a phrase that may be candidates."""
    return [(at, at + n) for n in range(2, size) for at in range(size - n + 1)]


def scored(counts: DataFrame, scale: int) -> DataFrame:
    """lang, size, w1 .. w4, a, l, r, score: candidates by their lowest-scoring cut."""
    names = [f"w{i}" for i in range(1, LONGEST + 1)]
    phrases, cuts = counts.where("size >= 2"), None
    for size in range(2, LONGEST + 1):
        for k in range(1, size):
            left, right = F.array(*_slice(0, k)), F.array(*_slice(k, size))
            one = phrases.where(F.col("size") == size).select("lang", "size", *names, F.col("f").alias("a"), F.lit(k).alias("k"), left.alias("left"), right.alias("right"))
            cuts = one if cuts is None else cuts.unionByName(one)
    whole = sized(counts.where("size >= 1").select("lang", F.array(*names).alias("part"), F.col("f").alias("part_f")))
    cuts = cuts.join(whole.select(F.col("lang"), F.col("part").alias("left"), F.col("part_f").alias("l")), ["lang", "left"])
    cuts = cuts.join(whole.select(F.col("lang"), F.col("part").alias("right"), F.col("part_f").alias("r")), ["lang", "right"])
    score = F.expr(f"cast(a as decimal(20,0)) * {scale} div (cast(l as decimal(20,0)) + r)")
    least = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    return cuts.groupBy("lang", "size", *names, "a").agg(least).select("lang", "size", *names, "a", "cut.l", "cut.r", "cut.score")


def outermost(candidates: DataFrame, counts: DataFrame, share: int) -> DataFrame:
    """candidates but for those that lie in a longer phrase with share percent of their count."""
    names = [f"w{i}" for i in range(1, LONGEST + 1)]
    inner = None
    for size in range(3, LONGEST + 1):
        for start, stop in _parts(counts, size):
            one = counts.where(F.col("size") == size).select("lang", *[c.alias(n) for c, n in zip(_slice(start, stop), names)], F.col("f").alias("longer"))
            inner = one if inner is None else inner.unionByName(one)
    inner = inner.groupBy("lang", *names).agg(F.max("longer").alias("longer"))
    held = candidates.join(inner, ["lang", *names], "left")
    hidden = F.col("longer").cast("decimal(20,0)") * 100 >= F.col("a").cast("decimal(20,0)") * share
    return held.where(~F.coalesce(hidden, F.lit(False))).drop("longer")


def spelled(candidates: DataFrame, counted: DataFrame, clashes: dict[bytes, int], least: int) -> DataFrame:
    """candidates with phrase, their words in place of hashes."""
    spark = candidates.sparkSession
    words = counted.where(F.col("bucket") < 0).where(F.col("n") >= least).groupBy("word", "h").agg(F.count("*").alias("langs")).select("word", "h")
    if clashes:
        own = F.broadcast(spark.createDataFrame([(bytearray(w), i) for w, i in clashes.items()], "word binary, number long"))
        words = words.join(own, "word", "left").select("word", F.coalesce("number", "h").alias("h"))
    words = sized(staged(words, "words"))
    each = candidates.withColumn("id", F.struct("lang", *[f"w{i}" for i in range(1, LONGEST + 1)])).select(
        "id", "size", "a", "l", "r", "score", F.posexplode(F.array(*[f"w{i}" for i in range(1, LONGEST + 1)])).alias("at", "h")
    )
    found = each.where("at < size").join(words, "h").groupBy("id").agg(
        *[F.first(c).alias(c) for c in ("a", "l", "r", "score")], F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w")
    )
    phrase = F.array_join(F.transform("w", lambda x: F.decode(x["word"], "UTF-8")), " ")
    return found.select(F.col("id.lang").alias("lang"), phrase.alias("phrase"), "a", "l", "r", "score")


def ranked(phrases: DataFrame, first: int) -> DataFrame:
    """The first rows of each language with their rank. Parts of a language are ranked alone before they meet."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = phrases.count()
    while rows > RANKED:
        parts = -(-rows // RANKED)
        along = W.partitionBy("lang", "part").orderBy(*order)
        phrases = phrases.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
        phrases = staged(phrases.withColumn("place", F.row_number().over(along)).where(F.col("place") <= first).drop("part", "place"), "ranked")
        left = phrases.count()
        if left == rows:
            break
        rows = left
    return phrases.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first)


def collocations(docs: DataFrame, least: int = 30, first: int = 2000, share: int = 80, scale: int = 2_000_000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases of two to four words."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    counted = staged(vocabulary(rows, least), "words_and_pairs")
    clashes = clashing_words(counted)
    counts = staged(phrase_counts(rows, frequent_buckets(counted, least), clashes, least), "phrases")
    candidates = outermost(scored(counts, scale), counts, share)
    best = ranked(staged(spelled(candidates, counted, clashes, least), "candidates"), first)
    totals = sized(staged(counted.where("bucket < 0").groupBy("lang").agg(F.sum("n").alias("n")), "totals"))
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
