"""Gated recurrent language model with a class-factored softmax, trained and applied on Spark.

Words, their counts and the class totals come from all training documents. The `head` most frequent words are output
words of their own, in classes of near equal summed square-root frequency; every other word belongs to a tail class by
its last bytes, within which it has its smoothed relative count, (c + 1) / (n + v + 1), n and v being the class's
training tokens and distinct words. So a text's probability is a product of P(class | state) and P(word | class, state),
and words never seen in training have a share.

The recurrent weights are fitted by truncated backpropagation in numpy over every token of every training document.
Rows are dealt to rounds; in a round each trainer reads its rows as a stream, a batch of about `BATCH` tokens at a time,
so that it never holds them all, however many are copies. It walks the batch's whole documents in `STREAMS` lanes by
windows of `WINDOW` tokens, the state being carried from window to window and cleared where a document starts. The
trainers' weights are averaged after each round. Scoring walks every whole text in windows and carries the state alike.

Defined results: null text is empty and has its end token only. A null doc_id counts as the empty text for the choice of
training rows. Repeated rows are scored and counted each. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import staged

#: The end token; no word holds white space.
END = b"\n"
HEAD, CLASSES, TAILS, HIDDEN = 4096, 48, 24, 24
#: Most frequent words whose counts go to every task; the counts of others are joined.
LISTED = 200_000
WINDOW, STREAMS = 24, 512
#: Adagrad's rate, and what its sums of squares start from.
RATE, FIRST_SQUARE = 0.1, 1e-7
#: States whose classes are worked out at once, so that what is made of them stays in the processor's cache.
BLOCK = 2048
#: Tokens in a window of scoring, about.
ROWS = 16_384
#: Tokens that a trainer or a scorer holds at once; one longer document is held whole. Lanes of so many end nearly together.
BATCH = 4_000_000
#: Shares, of 16, of the documents in each round of training.
ROUNDS = (1, 4, 11)
DOCS_PER_TRAINER = 10_000
#: Parts in which the trainers' weights are averaged: a task gets 1 / PIECES of each trainer's.
PIECES = 256
#: Steps that a trainer takes at least in all rounds, going over its documents again if they are few.
LEAST_STEPS = 320


def tail_class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % TAILS


def tail_classes(words: pa.Array) -> np.ndarray:
    """tail_class of each word of a binary array; none is empty."""
    if not len(words):
        return np.zeros(0, np.int64)
    _, ends, raw = words.buffers()
    ends = np.frombuffer(ends, np.int32)[words.offset : words.offset + len(words) + 1]
    raw = np.frombuffer(raw, np.uint8)
    last, before = raw[ends[1:] - 1].astype(np.int32), raw[np.maximum(ends[1:] - 2, 0)].astype(np.int32)
    # each pair of bytes, and each single one, is worked out once
    key = np.where(np.diff(ends) > 1, 65536 + 256 * before + last, last)
    found = np.bincount(key)
    for x in np.flatnonzero(found).tolist():
        found[x] = tail_class(bytes([x >> 8 & 255, x & 255]) if x >= 65536 else bytes([x]))
    return found[key]


def arrow_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """As split_words, with lower-cased words as one binary array."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    words = lists.flatten()
    # white space at a text's ends leaves empty words
    some = pc.not_equal(pc.binary_length(words), 0)
    of = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy())
    return words.filter(some).cast(pa.binary()), np.bincount(of[some.to_numpy(zero_copy_only=False)], minlength=len(texts))


def training_row(doc_id):
    """Whether a row is learned from: the crc32 of its doc_id as text is not 2 modulo 7."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 != 2


def word_counts(docs: DataFrame) -> DataFrame:
    """word binary, tail int, c long of all texts, with the end token."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def merged() -> pa.Table:
            return pa.concat_tables(held).group_by("word").aggregate([("c", "sum")]).rename_columns(["word", "c"])

        for part in parts:
            for at in range(0, part.num_rows, 1000):
                words, sizes = arrow_words(part.column("text").slice(at, 1000))
                found = words.value_counts()
                held += [pa.table({"word": found.field("values"), "c": found.field("counts")}), pa.table({"word": pa.array([END], pa.binary()), "c": pa.array([len(sizes)], pa.int64())})]
            if sum(len(t) for t in held) > 1_200_000:
                held = [merged()]
                if len(held[0]) > 600_000:
                    yield from held.pop().to_batches(100_000)
        if held:
            yield from merged().to_batches(100_000)

    # the tail class as tail_class has it
    tail = (F.crc32(F.expr("substring(word, -2, 2)")) % TAILS).cast("int")
    return docs.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")).select("word", tail.alias("tail"), "c")


@dataclass
class Model:
    """Listed words with their counts, classes and weights. Word numbers below `n_head` are output words."""

    words: list[bytes]
    counts: np.ndarray
    #: First word of each head class, and their end.
    bounds: np.ndarray
    #: log10 of n + v + 1 of each tail class.
    tail_log: np.ndarray
    tokens: int
    distinct: int
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @property
    def n_head(self) -> int:
        return int(self.bounds[-1])

    def plain(self) -> dict:
        """What Model takes, as a broadcast needs it."""
        return {k: getattr(self, k) for k in ("words", "counts", "bounds", "tail_log", "tokens", "distinct", "weights")}

    def ready(self) -> "Model":
        """Look-ups that a task makes for itself."""
        self.listed = pa.array(self.words, pa.binary())
        h, base = self.n_head, len(self.bounds) - 1
        tails = np.append(tail_classes(self.listed.slice(h)), np.arange(TAILS))
        self.klass = np.concatenate([np.repeat(np.arange(base), np.diff(self.bounds)), base + tails]).astype(np.int16)
        self.entry = np.concatenate([np.arange(h), h + tails]).astype(np.int16)
        self.end = self.words.index(END) if END in self.words else -1
        self.first = int(self.entry[self.end]) if self.end >= 0 else 0
        self.log_c = np.append(np.log10(self.counts + 1.0), np.zeros(TAILS))
        self.bounded = False
        return self

    def codes(self, words: list[bytes] | pa.Array) -> np.ndarray:
        """Of each word: its number, or the number of words plus its tail class if it is not listed."""
        words = words if isinstance(words, pa.Array) else pa.array(words, pa.binary())
        out = pc.index_in(words, value_set=self.listed).fill_null(-1).to_numpy().copy()
        rare = np.flatnonzero(out < 0)
        out[rare] = len(self.words) + tail_classes(words.take(pa.array(rare)))
        return out

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each token: its code, its class, and its number as an input."""
        codes = self.codes(words)
        return codes, self.klass[codes], self.entry[codes]

    def watch(self) -> None:
        """Note whether no state can make logits whose exponentials, their sums and products overflow, so that no maximum need be taken off them."""
        w = self.weights
        most = [float((np.abs(w[k]).sum(axis=axis) + np.abs(w[b])).max(initial=0)) for k, b, axis in (("c", "cb", 0), ("o", "ob", 1))]
        self.bounded = max(most) < 60

    def class_shares(self) -> np.ndarray:
        """log10 of each tail class's share, which is all there is to say where no word is listed."""
        return self.tail_log - np.log10((10.0**self.tail_log).sum())


def _states(w: dict, entry: np.ndarray, on: np.ndarray | None, h: np.ndarray, lives: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """Walk a window: at step t the first lives[t] lanes take the next inputs of entry. Arrays have a row for each unit and
    a column for each lane, which keeps numpy's loops long.

    on clears the state before inputs that start a document. Returns of each step the states before and after it, its
    gates z and r and new content n one upon another, and the products of the states before and the recurrent weights.
    """
    k, steps, edge = len(h), [], 0
    down, taken = np.ascontiguousarray(w["u"].T), np.take(w["x"].T, entry, axis=0)
    for live in lives:
        at = slice(edge, edge + live)
        edge += live
        before = h[:, :live] if on is None else h[:, :live] * on[at]
        a, g = down @ before, taken[at].T.copy()
        gates, n = g[: 2 * k], g[2 * k :]
        gates += a[: 2 * k]
        np.negative(gates, out=gates)
        np.exp(gates, out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        n += g[k : 2 * k] * a[2 * k :]
        # tanh n, as 1 - 2 / (exp 2n + 1), which takes numpy half as long
        n *= 2
        np.exp(n, out=n)
        n += 1
        np.reciprocal(n, out=n)
        n *= -2
        n += 1
        h = before - n
        h *= g[:k]
        h += n
        steps.append((before, h, g, a))
    return steps


def _softmax_log(e: np.ndarray, target: np.ndarray, bounded: bool) -> tuple[np.ndarray, np.ndarray]:
    """Natural log probability of each column's target, given by its place in e, and the column's sum; logits e become their exponentials."""
    if not bounded:
        e -= e.max(axis=0)
    hit = e.take(target)
    np.exp(e, out=e)
    total = e.sum(axis=0)
    return hit - np.log(total), total


def log_probability(model: Model, h: np.ndarray, ids: np.ndarray, klass: np.ndarray, grads: dict | None = None) -> np.ndarray:
    """Natural log of P(class | state), times P(word | class, state) for head words, of states h, one a row. grads gets the
    loss's gradients.

    States are sorted by class, so that each class has one product, and have a last unit of 1, so that biases are weights.
    Exponentials are not divided by their sums; what has a row for each unit is.
    """
    w, learns, n = model.weights, grads is not None, len(h)
    order = np.argsort(klass, kind="stable")
    ids, klass = ids[order], klass[order]
    states = np.ones((HIDDEN + 1, n), np.float32)
    np.take(h.T, order, axis=1, out=states[:HIDDEN], mode="clip")
    lp, dh = np.empty(n, np.float32), np.empty((HIDDEN, n), np.float32) if learns else None

    def walk(at: slice, out: np.ndarray, target: np.ndarray) -> tuple:
        """Log probabilities of the targets, and the gradients for out and for the states."""
        some = states[:, at]
        e = out @ some
        target = target * np.intp(len(target)) + np.arange(len(target))
        found, total = _softmax_log(e, target, model.bounded)
        if not learns:
            return found, None, None
        e.reshape(-1)[target] -= total
        share = 1 / total
        back = out[:, :HIDDEN].T @ e
        back *= share
        return found, e @ (some * share).T, back

    to_classes = np.ascontiguousarray(np.concatenate([w["c"], w["cb"][None]]).T)
    for lo in range(0, n, BLOCK):
        at = slice(lo, min(lo + BLOCK, n))
        lp[at], more, back = walk(at, to_classes, klass[at])
        if learns:
            grads["c"] += more[:, :HIDDEN].T
            grads["cb"] += more[:, HIDDEN]
            dh[:, at] = back
    edges = np.searchsorted(klass, np.arange(len(model.bounds)))
    to_words = np.concatenate([w["o"], w["ob"][:, None]], axis=1)
    for k in range(len(model.bounds) - 1):
        at, lo, hi = slice(edges[k], edges[k + 1]), model.bounds[k], model.bounds[k + 1]
        if at.start == at.stop or hi - lo == 1:
            continue
        found, more, back = walk(at, to_words[lo:hi], ids[at] - lo)
        lp[at] += found
        if learns:
            grads["o"][lo:hi] += more[:, :HIDDEN]
            grads["ob"][lo:hi] += more[:, HIDDEN]
            dh[:, at] += back
    place = np.empty(n, np.intp)
    place[order] = np.arange(n)
    if learns:
        grads["h"] = np.take(dh, place, axis=1, mode="clip").T
    return lp[place]


def first_weights(model: Model) -> dict[str, np.ndarray]:
    """Weights whose output is the training counts' distribution."""
    rng = np.random.default_rng(7)
    h, k = model.n_head, len(model.bounds) - 1
    counts = np.maximum(model.counts[:h].astype(np.float64), 1)
    sums = np.add.reduceat(counts, model.bounds[:-1]) if h else np.zeros(0)
    tails = np.maximum(10.0**model.tail_log - 1, 1)
    share = np.concatenate([sums, tails])
    return {
        "x": rng.normal(0, 0.3, (3 * HIDDEN, h + TAILS)).astype(np.float32),
        "u": rng.normal(0, 0.2, (HIDDEN, 3 * HIDDEN)).astype(np.float32),
        "c": rng.normal(0, 0.02, (HIDDEN, k + TAILS)).astype(np.float32),
        "cb": np.log(share / share.sum()).astype(np.float32),
        "o": rng.normal(0, 0.02, (h, HIDDEN)).astype(np.float32),
        "ob": np.log(counts / np.repeat(sums, np.diff(model.bounds))).astype(np.float32),
    }


def train(model: Model, segments: list[tuple[np.ndarray, np.ndarray, np.ndarray]], rate: float = RATE, seen: dict | None = None, rest: list | None = None) -> int:
    """Truncated backpropagation over whole documents (ids, classes, inputs), STREAMS lanes of them side by side, by
    Adagrad, whose sums are kept in seen. Returns the steps taken.

    With rest, lanes are walked as far as half of them reach; what is left of the others, and their states, goes to rest
    and comes first in the next call. Without it, or without segments, every lane is walked to its end.
    """
    w = model.weights
    seen = {} if seen is None else seen
    w["x"] = np.asfortranarray(w["x"])  # an input's weights stand together
    for k, v in w.items():
        seen.setdefault(k, np.full_like(v, FIRST_SQUARE, np.float32))
    old = rest or []
    free = max(0, (STREAMS if rest is not None else min(STREAMS, len(segments))) - len(old))
    lanes = [(len(x[0]), i, [x]) for i, (x, _) in enumerate(old)] + [(0, len(old) + i, []) for i in range(free)]
    heapq.heapify(lanes)
    # the longest documents are dealt first, each to the shortest lane; a lane has them in any order
    for i in sorted(range(len(segments)), key=lambda i: -len(segments[i][0])):
        load, k, held = lanes[0]
        carried = np.ones((len(segments[i][0]), 1), np.float32)
        carried[:1] = 0
        held.append((*segments[i], carried))
        heapq.heapreplace(lanes, (load + len(carried), k, held))
    lanes = sorted((x for x in lanes if x[0]), key=lambda x: (-x[0], x[1]))
    if not lanes:
        return 0
    rng = np.random.default_rng(len(segments))
    for _, i, held in lanes:
        first = i < len(old)
        held[first:] = [held[first + j] for j in rng.permutation(len(held) - first)]
    loads = np.array([x[0] for x in lanes])
    ids, klass, entry, carried = (np.concatenate([x[k] for _, _, held in lanes for x in held]) for k in range(4))
    start = np.cumsum(loads) - loads
    h = np.stack([old[i][1] if i < len(old) else np.zeros(HIDDEN, np.float32) for _, i, _ in lanes], axis=1)
    stop = int(loads[0]) if rest is None or not segments else int(loads[len(loads) // 2]) // WINDOW * WINDOW
    k, steps = HIDDEN, 0
    lo, most = 0, seen.get("rows", len(lanes) * WINDOW)
    while lo < stop:
        # where few lanes are left, steps are of more tokens of each
        live = int(np.searchsorted(-loads, -lo))
        times = np.arange(lo, min(lo + WINDOW * max(1, min(16, most // (WINDOW * live))), stop))
        lo += len(times)
        lives = np.searchsorted(-loads, -times)
        edges = np.append(0, np.cumsum(lives))
        rows = np.concatenate([start[:n] + t for t, n in zip(times, lives)])
        used, on = entry[rows], carried[rows, 0]
        walked = _states(w, used, on, h, lives)
        h = walked[-1][1]
        grads = {name: np.zeros_like(v) for name, v in w.items() if name not in ("x", "u")}
        model.watch()
        log_probability(model, np.concatenate([x[1] for x in walked], axis=1).T, ids[rows], klass[rows], grads)
        dh_all = grads.pop("h").T
        grads["u"] = np.zeros_like(w["u"])
        dx, back = [], None
        for t in range(len(times) - 1, -1, -1):
            before, _, g, a = walked[t]
            z, r, n = g[:k], g[k : 2 * k], g[2 * k :]
            dh = dh_all[:, edges[t] : edges[t + 1]]
            if back is not None:
                dh[:, : back.shape[1]] += back
            d = np.empty_like(g)
            dz, dr, dn = d[:k], d[k : 2 * k], d[2 * k :]
            kept = dh * z
            np.subtract(dh, kept, out=dn)  # dh (1 - z)
            np.subtract(before, n, out=dz)
            dz *= z
            dz *= dn
            n *= n
            np.subtract(1, n, out=n)
            dn *= n
            np.subtract(1, r, out=dr)
            dr *= a[2 * k :]
            dr *= r
            dr *= dn
            a[: 2 * k] = d[: 2 * k]
            np.multiply(dn, r, out=a[2 * k :])
            back = w["u"] @ a
            back += kept
            back *= on[edges[t] : edges[t + 1]]
            grads["u"] += before @ a.T
            dx.append(d)
        dx = np.concatenate(dx[::-1], axis=1)
        # each token weighs alike, also where few lanes are left
        seen["rows"] = max(seen.get("rows", 0), len(rows))
        scale = np.float32(1 / seen["rows"])
        for name, g in grads.items():
            g *= scale
            seen[name] += g * g
            w[name] -= rate * g / np.sqrt(seen[name])
        which = np.flatnonzero(np.bincount(used))
        g = np.stack([np.bincount(used, row)[which] for row in dx], axis=1).astype(np.float32) * scale
        squares = seen["x"].T[which] + g * g
        seen["x"].T[which] = squares
        w["x"].T[which] -= rate * g / np.sqrt(squares)
        steps += 1
    if rest is not None:
        rest[:] = [(tuple(x[b + stop : b + n].copy() for x in (ids, klass, entry, carried)), h[:, i].copy()) for i, (b, n) in enumerate(zip(start, loads)) if n > stop]
    return steps


def score_texts(model: Model, ids: np.ndarray, klass: np.ndarray, entry: np.ndarray, sizes: np.ndarray, group: int = STREAMS, window: int = 512) -> np.ndarray:
    """Sum of log_probability over each text, of texts whose tokens stand one after another. Texts follow each other in
    lanes, `group` of them at most and so few that the longest text is no longer than a lane; about ROWS tokens are in a
    window, and the state goes from window to window."""
    starts = np.cumsum(sizes) - sizes
    inputs = np.empty_like(entry)
    inputs[1:] = entry[:-1]
    inputs[starts] = model.first
    on = np.ones(len(ids), np.float32)
    on[starts] = 0
    lanes = [(0, i, []) for i in range(max(1, min(group, len(sizes), int(sizes.sum() // sizes.max(initial=1)))))]
    for i in np.argsort(-sizes, kind="stable").tolist():
        load, k, held = lanes[0]
        held.append(i)
        heapq.heapreplace(lanes, (load + int(sizes[i]), k, held))
    lanes.sort(key=lambda x: (-x[0], x[1]))
    loads = np.array([x[0] for x in lanes])
    first = np.cumsum(loads) - loads
    # where the lanes' tokens stand
    texts = np.array([i for _, _, held in lanes for i in held], np.intp)
    size = sizes[texts]
    at = np.arange(len(ids)) + np.repeat(starts[texts] - (np.cumsum(size) - size), size)
    found = np.empty(len(ids), np.float32)
    model.watch()
    w = model.weights | {"x": np.asfortranarray(model.weights["x"])}
    h = np.zeros((HIDDEN, len(lanes)), np.float32)
    lo, stop = 0, int(loads[0])
    while lo < stop:
        live = int(np.searchsorted(-loads, -lo))
        times = np.arange(lo, min(lo + min(window, -(-ROWS // live)), stop))
        lives = np.searchsorted(-loads, -times)
        rows = at[np.concatenate([first[:n] + t for t, n in zip(times, lives)])]
        walked = _states(w, inputs[rows], on[rows], h, lives)
        h = walked[-1][1]
        found[rows] = log_probability(model, np.concatenate([x[1] for x in walked], axis=1).T, ids[rows], klass[rows])
        lo += len(times)
    return np.bincount(np.repeat(np.arange(len(sizes)), sizes), found, minlength=len(sizes))


def listed_words(counts: DataFrame) -> pd.DataFrame:
    """word, c of the LISTED most frequent words and the end token, most frequent first, then by word.

    Counts are told apart by eighths of a doubling first, then one by one where the last of them fall, and of the words
    that share the last count those of the least hashes are taken: few numbers reach the driver, whatever the vocabulary.
    """

    def upto(groups: list, held: int) -> tuple[int, int]:
        """How many groups go in whole, and what is held then."""
        for i, row in enumerate(groups):
            if held + row["n"] > LISTED:
                return i, held
            held += row["n"]
        return len(groups), held

    octave, h = F.floor(F.log2("c") * 8), F.shiftrightunsigned(F.xxhash64("word"), 48)
    steps = sorted(counts.groupBy(octave.alias("step")).agg(F.count("*").alias("n"), F.min("c").alias("least")).collect(), reverse=True)
    i, held = upto(steps, 0)
    taken = F.col("c") >= (steps[i - 1]["least"] if i else 2**62)
    if i < len(steps):
        step = steps[i]["step"]
        ones = sorted(counts.where(octave == step).groupBy("c").agg(F.count("*").alias("n")).collect(), reverse=True)
        i, held = upto(ones, held)
        last = ones[i]["c"]
        same = sorted(counts.where(F.col("c") == last).groupBy(h.alias("h")).agg(F.count("*").alias("n")).collect())
        i, _ = upto(same, held)
        taken = taken | ((octave == step) & (F.col("c") > last)) | ((F.col("c") == last) & (h < same[i]["h"]))
    top = counts.where(taken | (F.col("word") == F.lit(bytearray(END)))).select("word", "c").toPandas()
    return top.sort_values(["c", "word"], ascending=[False, True])


def build_model(counts: DataFrame) -> Model:
    """Listed words and class totals from staged word counts."""
    size = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = listed_words(counts)
    words, c = [bytes(x) for x in top["word"]], top["c"].to_numpy(np.int64)
    n_head = min(HEAD, len(words))
    share = np.cumsum(np.sqrt(c[:n_head])) if n_head else np.zeros(0)
    klass = np.minimum((share / share[-1] * CLASSES).astype(int), CLASSES - 1) if n_head else np.zeros(0, int)
    bounds = np.append(np.flatnonzero(np.append(True, klass[1:] != klass[:-1])) if n_head else np.zeros(0, int), n_head)
    n, v = np.zeros(TAILS), np.zeros(TAILS)
    for row in counts.groupBy("tail").agg(F.sum("c"), F.count("*")).collect():
        n[row[0]], v[row[0]] = row[1], row[2]
    for word, x in zip(words[:n_head], c):
        n[tail_class(word)] -= x
        v[tail_class(word)] -= 1
    return Model(words, c, bounds, np.log10(n + v + 1), int(size[0]), int(size[1]))


def _batches(model: Model, texts: Iterable[bytes]) -> Iterator[list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Batches of about BATCH tokens of whole documents, given by their codes: codes, classes and inputs, the inputs one
    token behind."""
    held, size = [], 0
    for raw in texts:
        codes = np.frombuffer(raw, np.int32)
        entry = model.entry[codes]
        entry[1:], entry[0] = entry[:-1].copy(), model.first
        held.append((codes, model.klass[codes], entry))
        size += len(codes)
        if size >= BATCH:
            yield held
            held, size = [], 0
    if held:
        yield held


def learn(model: Model, texts: Iterable[bytes], least: int) -> int:
    """Train on every token of texts, again and again until `least` steps are taken. Returns the tokens of one pass."""
    seen: dict[str, np.ndarray] = {}
    rest: list = []
    tokens, steps, again = 0, 0, []
    for batch in _batches(model, texts):
        steps += train(model, batch, seen=seen, rest=rest)
        tokens += sum(len(x[0]) for x in batch)
        # once a pass takes enough steps, nothing is held for another
        again = [*again, batch] if steps < least else []
    steps += train(model, [], seen=seen, rest=rest)
    rng = np.random.default_rng(11)
    while steps < least and again:
        for batch in again:
            if steps >= least:
                break
            steps += train(model, [batch[i] for i in rng.permutation(len(batch))], seen=seen, rest=rest)
        steps += train(model, [], seen=seen, rest=rest)
    return tokens


def turn_of():
    """0 to 15, which says a row's round. By doc_id too, so that copies of a text go to all rounds; of the row alone, so that each is in one."""
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(16))


def round_of():
    """The round of training in which a row has its turn; the one after the last for rows that are not learned from."""
    out, left = F.lit(len(ROUNDS)), F.lit(len(ROUNDS) - 1)
    for i in range(len(ROUNDS) - 2, -1, -1):
        left = F.when(turn_of() < sum(ROUNDS[: i + 1]), i).otherwise(left)
    return F.when(training_row(F.col("doc_id")), left).otherwise(out)


def encoded(docs: DataFrame, model: Model) -> DataFrame:
    """Staged: row, doc_id, round, n_tokens, listed, log_c (the listed tokens' log10(c + 1)), within (the tail tokens'
    share of log10 P(word | class) that their counts do not tell), codes, rare (unlisted words and how often they occur)."""
    told = docs.sparkSession.sparkContext.broadcast(model.plain())

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(**told.value).ready()
        listed, base, end = len(m.words), len(m.bounds) - 1, m.codes([END])[0]
        fixed = -m.tail_log if listed else m.class_shares() - m.tail_log
        for part in (part.slice(at, 1000) for part in parts for at in range(0, part.num_rows, 1000)):
            words, sizes = arrow_words(part.column("text"))
            words = words.dictionary_encode()
            names, which = words.dictionary, words.indices.to_numpy()
            code = m.codes(names)
            edges = np.append(0, np.cumsum(sizes + 1))
            text = np.repeat(np.arange(len(sizes)), sizes + 1)
            inner = np.ones(len(text), bool)
            inner[edges[1:] - 1] = False
            codes = np.full(len(text), end, np.int32)
            codes[inner] = code[which]
            tail = np.flatnonzero(codes >= m.n_head)
            total = lambda at, x: pa.array(np.bincount(text[at], x, minlength=len(sizes)).astype(np.float64))
            within = np.where(codes[tail] < listed, m.log_c[codes[tail]], 0.0) + fixed[m.klass[codes[tail]] - base]
            rare = np.flatnonzero((code >= listed)[which])
            pairs, times = np.unique((text[inner][rare] << 32) | which[rare], return_counts=True)
            at = pa.array(np.searchsorted(pairs >> 32, np.arange(len(sizes) + 1)), pa.int32())
            out = {
                "doc_id": part.column("doc_id"), "round": part.column("round"), "n_tokens": pa.array(sizes + 1, pa.int64()), "listed": pa.array(np.bincount(text[codes < listed], minlength=len(sizes)), pa.int64()),
                "log_c": total(slice(None), m.log_c[codes]), "within": total(tail, within),
                "codes": pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((4 * edges).astype(np.int32)), pa.py_buffer(codes)]),
                "rare": pa.ListArray.from_arrays(at, names.take(pa.array(pairs & 0xFFFFFFFF))), "times": pa.ListArray.from_arrays(at, pa.array(times, pa.int64())),
            }
            yield pa.RecordBatch.from_pydict(out)

    rows = docs.select("doc_id", round_of().cast("int").alias("round"), "text")
    out = rows.mapInArrow(run, "doc_id long, round int, n_tokens long, listed long, log_c double, within double, codes binary, rare array<binary>, times array<long>")
    return staged(out.withColumn("row", F.monotonically_increasing_id()), "encoded", by="round")


def fit(spark, rows: DataFrame, model: Model) -> Model:
    """Train on encoded rows in rounds of parallel trainers whose weights are averaged."""
    model.weights = first_weights(model)
    if not model.words:
        return model
    trainers = max(1, int(model.counts[model.words.index(END)]) // DOCS_PER_TRAINER)  # the end token counts rows
    names = list(model.weights)
    for turn, share in enumerate(ROUNDS):
        now = spark.sparkContext.broadcast(model.plain())

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            m = Model(**now.value).ready()
            m.weights = {k: v.copy() for k, v in m.weights.items()}
            n = learn(m, (raw for part in parts for raw in part["codes"]), -(-LEAST_STEPS * share // sum(ROUNDS)))
            if n:
                flat = np.concatenate([m.weights[k].ravel() for k in names])
                pieces = np.array_split(flat, PIECES)
                yield pd.DataFrame({"piece": range(PIECES), "n": float(n), "raw": [p.tobytes() for p in pieces]})

        def mean(group: pd.DataFrame) -> pd.DataFrame:
            n = group["n"].sum()
            total = sum(np.frombuffer(r, np.float32).astype(np.float64) * k for r, k in zip(group["raw"], group["n"]))
            return pd.DataFrame({"piece": [group["piece"].iloc[0]], "raw": [(total / n).astype(np.float32).tobytes()]})

        # a round of few rows has fewer trainers, since the end of each is walked in few lanes
        few = max(1, trainers * min(ROUNDS[-1], 2 * share) // ROUNDS[-1])
        trained = rows.where(F.col("round") == turn).select("codes").coalesce(few).mapInPandas(run, "piece int, n double, raw binary")
        pieces = trained.groupBy("piece").applyInPandas(mean, "piece int, raw binary").collect()
        if not pieces:
            continue
        flat = np.concatenate([np.frombuffer(r["raw"], np.float32) for r in sorted(pieces)])
        ends = np.cumsum([model.weights[k].size for k in names])
        model.weights = {k: flat[e - model.weights[k].size : e].reshape(model.weights[k].shape) for k, e in zip(names, ends)}
    return model


def language_model_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = staged(word_counts(docs.where(training_row(F.col("doc_id")))), "counts")
    model = build_model(counts)
    rows = encoded(docs, model)
    model = fit(spark, rows, model)
    told = spark.sparkContext.broadcast(model.plain())

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Model(**told.value).ready()

        def out(held: list[pd.DataFrame]) -> pd.DataFrame:
            part = pd.concat(held)
            codes = np.frombuffer(b"".join(part.pop("codes")), np.int32)
            found = score_texts(m, codes, m.klass[codes], m.entry[codes], part["n_tokens"].to_numpy()) / np.log(10) if m.words else 0.0
            return part.assign(model=found)

        held: list[pd.DataFrame] = []
        for part in parts:
            held.append(part)
            if sum(int(x["n_tokens"].sum()) for x in held) >= BATCH:
                yield out(held)
                held = []
        if held:
            yield out(held)

    taken = rows.select("row", "n_tokens", "codes").mapInPandas(run, "row long, n_tokens long, model double").select("row", "model")
    rare = rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row", F.col("r.rare").alias("word"), F.col("r.times").alias("tf")).join(counts.select("word", "c"), "word", "left")
    sums = rare.groupBy("row").agg(F.sum(F.when(F.col("c").isNotNull(), F.col("tf")).otherwise(0)).alias("known"), F.sum(F.col("tf") * F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("rare_log"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    log_all = float(np.log10(model.tokens + model.distinct + 1))
    return rows.select("row", "doc_id", "round", "n_tokens", "listed", "log_c", "within").join(taken, "row").join(sums, "row", "left").select(
        "doc_id", (F.col("round") == len(ROUNDS)).alias("held_out"), "n_tokens", (F.col("listed") + zero("known")).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("log_c") + zero("rare_log") - F.col("n_tokens") * log_all).alias("base_score"), (F.col("model") + F.col("within") + zero("rare_log")).alias("score"),
    )
