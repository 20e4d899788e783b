"""Quality classifier: supervised subword embeddings, trained by stochastic gradient descent in numpy.

A text is the mean of the learned vectors of its features: its words (case kept), their character n-grams of 3 to 5
bytes with word edges marked, and its pairs of neighbouring words, all hashed into one table; every pair of one word
twice is one feature. A softmax over the mean gives the score. The model is linear in the mean, so scoring needs only
each word's summed logit, worked out once for each different word a task meets.

Training takes at most `SAMPLE` labelled rows, those with the least hash of doc_id. Defined results: null or empty text
scores by the bias alone. Rows with no label, or a quality other than 0 and 1, teach nothing; with no labels at all each
score is 0.5. A null doc_id is scored like any other. Repeated rows are scored each and, of the labelled ones, equal hashes are taken
by doc_id. A text is read whole, in time proportional to its length; an unbroken run is one word with the n-grams it has.
Other columns are kept, but for `score`, `predicted` and `_quality`, which are dropped; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import WordIds, mix64, slices, split_words

BUCKETS, DIMENSIONS = 1 << 18, 8
#: Labelled rows to train on at most.
SAMPLE = 4000
EPOCHS, RATE = 8, 1.0
THRESHOLD = 0.7
_PRIME = np.uint64(0x100000001B3)
_TWICE = 0


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the word, feature) of different words, and each word's hash."""
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    flat = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8).astype(np.uint64) + np.uint64(1)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(ends, sizes) - np.arange(len(flat))
    with np.errstate(over="ignore"):
        powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(int(sizes.max()) if len(sizes) else 0, _PRIME), dtype=np.uint64)])
        whole = mix64(np.add.reduceat(flat * powers[left], starts)) if len(words) else np.zeros(0, np.uint64)
        who, what = [np.arange(len(words))], [whole]
        for n in (3, 4, 5):
            some = np.flatnonzero(left >= n)
            h = np.full(len(some), np.uint64(n))
            for k in range(n):
                h = h * _PRIME + flat[some + k]
            who.append(owner[some])
            what.append(mix64(h))
    who, what = np.concatenate(who), np.concatenate(what)
    order = np.argsort(who, kind="stable")
    return who[order], (what[order] % np.uint64(BUCKETS - 1)).astype(np.int64) + 1, whole


def pair_features(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the text, feature) of neighbouring words of texts that stand one after another."""
    text = np.repeat(np.arange(len(sizes)), sizes)
    inside = text[1:] == text[:-1]
    x, y = hashes[:-1][inside], hashes[1:][inside]
    pair = (mix64(x * np.uint64(0x9E3779B97F4A7C15) + y) % np.uint64(BUCKETS - 1)).astype(np.int64) + 1
    return text[1:][inside], np.where(x == y, _TWICE, pair)


def train(texts: list[str | None], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """The logit of label 1 that each feature adds, divided by the number of features, and the bias."""
    rng = np.random.default_rng(5)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    out = np.zeros((2, DIMENSIONS), np.float32)
    bias = np.zeros(2, np.float32)
    if not len(labels):
        return np.zeros(BUCKETS, np.float32), 0.0
    sets = []
    for text in texts:
        words, sizes = split_words([text], lower=False)
        ids = WordIds()
        at = ids.ids(words)
        who, what, hashes = word_features(list(ids))
        times = np.bincount(at, minlength=len(ids))
        _, pairs = pair_features(hashes[at], sizes)
        what, back = np.unique(np.concatenate([what, pairs]), return_inverse=True)
        weight = np.bincount(back, np.concatenate([times[who], np.ones(len(pairs))]), minlength=len(what)).astype(np.float32)
        sets.append((what.astype(np.int32), weight / max(1.0, float(weight.sum()))))
    steps, step = EPOCHS * len(sets), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(sets)):
            rate = np.float32(RATE * (1 - step / steps))
            step += 1
            what, weight = sets[i]
            mean = weight @ vectors[what]
            logit = out @ mean + bias
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = out.T @ p
            out -= rate * np.outer(p, mean)
            bias -= np.float32(0.1) * rate * p
            vectors[what] -= rate * np.outer(weight, back)
    return vectors @ (out[1] - out[0]), float(bias[1] - bias[0])


class Scorer:
    """Scores of texts; the summed logits of words met are kept."""

    def __init__(self, logits: np.ndarray, bias: float, room: int = 150_000):
        self.logits, self.bias, self.room = logits, bias, room
        self._clear()

    def _clear(self) -> None:
        self.ids, self.hashes, self.sums, self.sizes = WordIds(), np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)

    def __call__(self, texts) -> np.ndarray:
        if len(self.ids) > self.room:
            self._clear()
        words, sizes = split_words(texts, lower=False)
        at = self.ids.ids(words)
        if len(self.ids) > len(self.hashes):
            new = list(self.ids)[len(self.hashes) :]
            who, what, hashes = word_features(new)
            self.hashes = np.concatenate([self.hashes, hashes])
            self.sums = np.concatenate([self.sums, np.bincount(who, self.logits[what], minlength=len(new))])
            self.sizes = np.concatenate([self.sizes, np.bincount(who, minlength=len(new))])
        text = np.repeat(np.arange(len(sizes)), sizes)
        pair_text, pairs = pair_features(self.hashes[at], sizes)
        n = len(sizes)
        total = np.bincount(text, self.sums[at], minlength=n) + np.bincount(pair_text, self.logits[pairs], minlength=n)
        count = np.bincount(text, self.sizes[at], minlength=n) + np.bincount(pair_text, minlength=n)
        return 1 / (1 + np.exp(-(total / np.maximum(count, 1) + self.bias)))


def training_row(doc_id):
    """Whether labels of a row may be learned: the crc32 of its doc_id as text is not 2 modulo 4."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 != 2


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Train on a bounded sample of labelled documents."""
    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    told = told.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & training_row(F.col("doc_id")))
    # of labelled documents that are there; the choice moves ids only
    here = told.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct(), "doc_id", "left_semi")
    chosen = here.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    # at most `sample` rows, so it may be broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    rows = rows.orderBy(F.xxhash64("doc_id", "text"), "doc_id", "text", "quality").limit(sample).select("text", "quality")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(parts)
        texts = [t for part in held for t in part["text"]]
        logits, bias = train(texts, np.concatenate([np.zeros(0, np.int64), *(part["quality"].to_numpy(np.int64) for part in held)]))
        yield pd.DataFrame({"logits": [logits.astype(np.float32).tobytes()], "bias": [bias]})

    # the bounded sample is one partition, on which one task trains; the driver gets a weight for each bucket
    model = rows.coalesce(1).mapInPandas(run, "logits binary, bias double").collect()
    return (np.frombuffer(model[0]["logits"], np.float32), model[0]["bias"]) if model else train([], np.zeros(0, np.int64))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The columns of docs, then score (0 to 1) and predicted (1 if score >= threshold)."""
    told = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    @F.pandas_udf("score double, predicted int")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(*told.value)
        for part in parts:
            found = np.concatenate([np.zeros(0), *(scorer(some) for some in slices([part]))])
            yield pd.DataFrame({"score": found, "predicted": (found >= threshold).astype(np.int32)})

    rest = docs.drop("score", "predicted", "_quality")
    return rest.withColumn("_quality", score("text")).select(*rest.columns, "_quality.score", "_quality.predicted")
