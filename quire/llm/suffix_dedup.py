"""Removal of repeated byte strings by suffix arrays built in two stages.

Every window of `length` bytes is dealt to a bucket by the least hash among its 8-byte grams, so equal windows always
meet, wherever they stand. Neighbouring windows of one least gram travel together as one piece of text. Grams that very
many documents share would fill one bucket each: their pieces go by what stands beside the gram, and of those that many
rows have alike only the first is sent at all (see `_cut`). In a bucket,
pieces that share neither side of their gram with another document are dropped and equal pieces become one; over those
that share a side with a different piece a suffix array is built by two-stage sorting: only suffixes smaller than their
successors are sorted directly, the others are induced by scanning the buckets of first bytes in order. Adjacent common
prefixes then show the runs of equal windows, and each run's smallest doc_id.

Defined results: null or empty text has nothing to remove. Matches never cross documents. A row with a null doc_id is
neither smaller nor larger than any other, so nothing is removed from it and it removes nothing. Rows with the same
doc_id, repeated rows too, do not affect each other. A text of megabytes is cut into pieces at its grams; one unbroken run
of a byte is one piece. Columns other than doc_id and text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import mix64, sized, staged

LENGTH = 50
_GRAM = 8
#: Bytes of pieces that a bucket is planned for, and of text that a part of the last step is planned for.
BUCKET_BYTES, PART_BYTES = 6_000_000, 6_000_000
#: Bytes of text that one map batch cuts at once.
BATCH_BYTES = 2_000_000
#: Documents from which common grams are told, the share of them (one in so many) and the number that make a gram common,
#: and how many grams are at most. Like the next ones they only say where work is done.
SAMPLE, COMMON_SHARE, LEAST_COMMON, MOST_COMMON = 10_000, 500, 20, 4096
#: Rows that make a piece at a common gram a repeated one, and how many such pieces are told to all tasks.
LEAST_REPEATED, MOST_REPEATED = 200, 200_000


def grams(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as a big-endian number; past the end, zeros."""
    padded = np.concatenate([data, np.zeros(_GRAM, np.uint8)])
    return np.ndarray(len(data), ">u8", padded, strides=(1,)).astype(np.uint64)


def suffix_array(data: np.ndarray, depth: int, eight: np.ndarray | None = None) -> np.ndarray:
    """Positions of data in the order of their suffixes, exact to `depth` bytes at least (ties in any order).

    A suffix smaller than its successor is sorted directly. Any other follows its successor in the order, so one scan of
    the first-byte buckets from the smallest on induces them: each suffix in place puts its predecessor, if that is one
    of the others, at the next free head of the predecessor's bucket.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    eight = grams(data) if eight is None else eight
    rise = np.full(n, -1, np.int8)
    rise[:-1] = np.sign(data[1:].astype(np.int16) - data[:-1])
    following = np.where(rise != 0, np.arange(n), n)
    following = np.minimum.accumulate(following[::-1])[::-1]
    smaller = rise[following] > 0

    direct = np.flatnonzero(smaller)
    direct = direct[np.argsort(eight[direct], kind="stable")]
    key = eight[direct]
    fresh = np.ones(len(direct), bool)
    fresh[1:] = key[1:] != key[:-1]
    for at in range(_GRAM, depth, _GRAM):
        group = np.cumsum(fresh)
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        rows = np.flatnonzero(tied)
        if not len(rows):
            break
        pos = direct[rows] + at
        word = np.where(pos < n, eight[np.minimum(pos, n - 1)], np.uint64(0))
        order = np.lexsort((word, group[rows]))
        direct[rows] = direct[rows][order]
        word, same = word[order], group[rows]
        apart = np.ones(len(rows), bool)
        apart[1:] = (word[1:] != word[:-1]) | (same[1:] != same[:-1])
        fresh[rows] = apart

    sizes = np.bincount(data, minlength=256)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    out = np.empty(n, np.int64)
    tails = np.bincount(data[direct], minlength=256)
    at = 0
    for c in np.flatnonzero(tails):
        out[ends[c] - tails[c] : ends[c]] = direct[at : at + tails[c]]
        at += tails[c]
    head = starts.copy()
    if not smaller[n - 1]:
        out[head[data[n - 1]]] = n - 1
        head[data[n - 1]] += 1
    for c in np.flatnonzero(sizes):
        front = out[starts[c] : head[c]]
        while len(front):
            before = front[front > 0] - 1
            before = before[data[before] == c]
            out[head[c] : head[c] + len(before)] = before
            head[c] += len(before)
            front = before
        before = out[starts[c] : ends[c]]
        before = before[before > 0] - 1
        first = data[before]
        more = first > c
        before, first = before[more], first[more]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        counts = np.bincount(first, minlength=256)
        rank = np.arange(len(before)) - np.repeat(np.cumsum(counts) - counts, counts)
        out[head[first] + rank] = before
        head += counts
    return out


def common_prefixes(data: np.ndarray, order: np.ndarray, depth: int, eight: np.ndarray | None = None) -> np.ndarray:
    """Bytes that each suffix shares with the one before it in order, up to depth; 0 for the first."""
    n = len(data)
    eight = grams(data) if eight is None else eight
    out = np.zeros(n, np.int64)
    rows = np.arange(1, n)
    for at in range(0, depth, _GRAM):
        x, y = order[rows] + at, order[rows - 1] + at
        inside = np.minimum(n - np.maximum(x, y), _GRAM).clip(0)
        differ = eight[np.minimum(x, n - 1)] ^ eight[np.minimum(y, n - 1)]
        same = np.full(len(rows), _GRAM)
        for k in range(_GRAM):
            same[(same == _GRAM) & ((differ >> np.uint64(8 * (_GRAM - 1 - k))) & np.uint64(255) != 0)] = k
        out[rows] = at + np.minimum(same, inside)
        rows = rows[(same == _GRAM) & (inside == _GRAM)]
        if not len(rows):
            break
    return np.minimum(out, depth)


def pieces(data: np.ndarray, begins: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring windows whose least gram hash stands at one place: text index, first window, last window + 1,
    the gram's offset in the first window, and a hash of the gram.

    data holds the texts one after another, fewer than 2 ** 24 bytes; begins has where each starts, and their end. The
    least hash of a window is the leftmost of the least 40-bit hashes of its grams, so it depends on the window alone.
    """
    width = length - _GRAM + 1
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, np.zeros(0, np.uint64)
    place = np.uint64((1 << 24) - 1)
    eight = grams(data)
    low = (mix64(eight) & ~place) | np.arange(len(data), dtype=np.uint64)
    span, least = 1, low
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    count = len(data) - length + 1
    least = (np.minimum(least[:count], least[width - span : width - span + count]) & place).astype(np.int64)
    text = np.repeat(np.arange(len(begins) - 1), np.diff(begins))[:count]
    valid = np.arange(count) + length <= begins[text + 1]
    edge = np.ones(count, bool)
    edge[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1]) | (valid[1:] != valid[:-1])
    first = np.flatnonzero(edge)
    last = np.append(first[1:], count)
    keep = valid[first]
    first, last = first[keep], last[keep]
    at = least[first]
    return text[first], first, last, at - first, mix64(eight[at] ^ np.uint64(0x2545F4914F6CDD1D))


def _gather(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """data[first:first + size] of each row, one after another."""
    ends = np.cumsum(size)
    return data[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)]


def _runs(flag: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 of runs of set flags that do not go over an edge."""
    starts = flag & (edge | ~np.concatenate([[False], flag[:-1]]))
    stops = flag & np.concatenate([edge[1:] | ~flag[1:], [True]])
    return np.flatnonzero(starts), np.flatnonzero(stops) + 1


_HEAD = np.dtype([("doc", "<i8"), ("crc", "<u4"), ("pos", "<i4"), ("windows", "u1"), ("offset", "u1")])
_SPAN = np.dtype([("doc", "<i8"), ("crc", "<u4"), ("start", "<i4"), ("end", "<i4")])


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers with their fields apart, which compresses better."""
    return zstandard.ZstdCompressor(level=1).compress(b"".join(a[f].tobytes() for a in arrays for f in (a.dtype.names or [...])))


def _fields(raw: bytes, kind: np.dtype, n: int) -> np.ndarray:
    out, at = np.empty(n, kind), 0
    for f in kind.names:
        size = kind[f].itemsize * n
        out[f] = np.frombuffer(raw[at : at + size], kind[f])
        at += size
    return out


def _batches(parts: Iterator[pd.DataFrame], length: int, twins: bool) -> Iterator[list[tuple[int, bytes, int, int]]]:
    """Texts (doc_id, bytes, crc, place in the whole text); a long text comes in slices that share no window."""
    held, size = [], 0
    for part in parts:
        for doc, text in zip(part["doc_id"], part["text"]):
            raw = text.encode("utf-8", "surrogatepass")
            crc = zlib.crc32(raw) if twins else 0
            for at in range(0, len(raw) - length + 1, BATCH_BYTES):
                held.append((doc, raw[at : at + BATCH_BYTES + length - 1], crc, at))
                size += len(held[-1][1])
                if size >= BATCH_BYTES:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def _laid(batch: list[tuple[int, bytes, int, int]], length: int) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
    """The bytes of a batch, where its texts begin, and its pieces."""
    data = np.frombuffer(b"".join(x[1] for x in batch), np.uint8)
    begins = np.concatenate([[0], np.cumsum([len(x[1]) for x in batch])])
    return data, begins, pieces(data, begins, length)


def _words(data: np.ndarray) -> np.ndarray:
    return np.ndarray(max(0, len(data) - _GRAM + 1), "<u8", data, strides=(1,))


def _known(sorted_: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether values are in a sorted array, and where."""
    if not len(sorted_):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)
    return sorted_[at] == values, at


def _common(docs: DataFrame, length: int) -> np.ndarray:
    """Hashes of grams at which pieces of many documents stand, from a sample of documents. What it holds decides only
    where pieces go, not what is found."""
    n = docs.count()
    some = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("common")), F.lit(1 << 40)) < int((1 << 40) * min(1.0, SAMPLE / max(1, n))))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _batches(parts, length, False):
            text, _, _, _, mark = _laid(batch, length)[2]
            order = np.lexsort((text, mark))
            once = np.append(True, (mark[order][1:] != mark[order][:-1]) | (text[order][1:] != text[order][:-1]))[: len(order)]
            found, times = np.unique(mark[order][once], return_counts=True)
            yield pd.DataFrame({"mark": found.view(np.int64), "n": times.astype(np.int64)})

    counts = some.select("doc_id", "text").mapInPandas(run, "mark long, n long").groupBy("mark").agg(F.sum("n").alias("n"))
    top = counts.where(F.col("n") >= max(LEAST_COMMON, min(n, SAMPLE) // COMMON_SHARE)).orderBy(F.desc("n"), "mark").limit(MOST_COMMON).collect()
    return np.sort(np.array([r["mark"] for r in top], np.int64).view(np.uint64))


def _names(words: np.ndarray, first: np.ndarray, last: np.ndarray, mark: np.ndarray, length: int) -> np.ndarray:
    """A hash of each piece and its gram."""
    return mix64(_contents(words, first, last - first + length - 1) ^ mark)


def _repeated(docs: DataFrame, marks: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of pieces at common grams, those that many rows have: their hashes in order, and the smallest doc_id of each."""
    if not len(marks):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    told = docs.sparkSession.sparkContext.broadcast(marks)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _batches(parts, length, False):
            data, _, (text, first, last, _, mark) = _laid(batch, length)
            some = np.flatnonzero(_known(told.value, mark)[0])
            if not len(some):
                continue
            ids = np.array([x[0] for x in batch], np.int64)[text[some]]
            found, back, times = np.unique(_names(_words(data), first[some], last[some], mark[some], length), return_inverse=True, return_counts=True)
            least = np.full(len(found), np.iinfo(np.int64).max)
            np.minimum.at(least, back, ids)
            yield pd.DataFrame({"name": found.view(np.int64), "first": least, "n": times.astype(np.int64)})

    counts = docs.select("doc_id", "text").mapInPandas(run, "name long, first long, n long").groupBy("name").agg(F.min("first").alias("first"), F.sum("n").alias("n"))
    top = counts.where(F.col("n") >= LEAST_REPEATED).orderBy(F.desc("n"), "name").limit(MOST_REPEATED).select("name", "first").toPandas()
    names, first = top["name"].to_numpy(np.int64).view(np.uint64), top["first"].to_numpy(np.int64)
    order = np.argsort(names)
    return names[order], first[order]


def _cut(docs: DataFrame, buckets: int, parts: int, length: int, twins: bool) -> DataFrame:
    """bucket, n, body: the pieces of some texts that go to a bucket; of bucket -1 - part, spans that are settled already.

    Pieces go by their gram. At a common gram, copies of what many rows have are settled on the spot, since the smallest
    doc_id that has it is known; the others go by each of their sides, of which pieces that share a window share one.
    """
    if not _GRAM < length < 256:
        raise ValueError("length must be from 9 to 255 bytes")
    marks = _common(docs, length)
    told = docs.sparkSession.sparkContext.broadcast((marks, *_repeated(docs, marks, length)))
    reach = (length - _GRAM) // 2

    def run(slices_: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        marks, names, least = told.value
        for batch in _batches(slices_, length, twins):
            data, begins, (text, first, last, offset, mark) = _laid(batch, length)
            ids, crc, place = (np.array([x[k] for x in batch], kind) for k, kind in ((0, np.int64), (2, np.uint32), (3, np.int64)))
            head = np.empty(len(text), _HEAD)
            head["doc"], head["crc"], head["pos"] = ids[text], crc[text], first - begins[text] + place[text]
            head["windows"], head["offset"] = last - first, offset
            size = last - first + length - 1
            bucket_of = lambda x: ((x >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
            rows, piece, bucket = [], np.arange(len(text)), bucket_of(mark)
            common = np.flatnonzero(_known(marks, mark)[0])
            if len(common):
                words = _words(data)
                known, at = _known(names, _names(words, first[common], last[common], mark[common], length))
                settled = known & (ids[text[common]] > (least[at] if len(least) else 0))
                spans = _whole(head[common[settled]], length)
                part = _part(spans["doc"], spans["crc"], parts)
                order = np.argsort(part, kind="stable")
                found, x = np.unique(part[order], return_index=True)
                rows += [(-1 - p, j - i, _pack(spans[order[i:j]])) for p, i, j in zip(found, x, np.append(x[1:], len(order)))]
                open_ = common[~settled]
                sides = _sides(words, first[open_], size[open_], offset[open_], reach)
                cold = np.ones(len(text), bool)
                cold[common] = False
                piece = np.concatenate([piece[cold], *(open_[side != 0] for side in sides)])
                bucket = np.concatenate([bucket[cold], *(bucket_of(side[side != 0]) for side in sides)])
            order = np.argsort(bucket, kind="stable")
            piece, bucket = piece[order], bucket[order]
            body = _gather(data, first[piece], size[piece])
            stops = np.cumsum(size[piece])
            found, at = np.unique(bucket, return_index=True)
            for b, x, y in zip(found, at, np.append(at[1:], len(bucket))):
                rows.append((b, y - x, _pack(head[piece[x:y]], body[stops[x] - size[piece[x]] : stops[y - 1]])))
            yield pd.DataFrame(rows, columns=["bucket", "n", "body"])

    return docs.select("doc_id", "text").mapInPandas(run, "bucket long, n int, body binary")


def _several(marks: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Rows whose mark stands with more than one value between low and high."""
    order = np.argsort(marks, kind="stable")
    sorted_ = marks[order]
    at = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1]))
    out = np.zeros(len(marks), bool)
    out[order] = np.repeat(np.minimum.reduceat(low[order], at) < np.maximum.reduceat(high[order], at), np.diff(np.append(at, len(marks))))
    return out


def _sides(words: np.ndarray, start: np.ndarray, size: np.ndarray, offset: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the gram with `reach` bytes before it, and after it; 0 where the piece does not hold them.

    A window holds the gram and length - 8 more bytes, so at least `reach`, half of them, on one side; pieces that share
    a window share a hash.
    """
    gram, rows = start + offset, len(start)
    left, right = np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
    for out, has, first in ((left, offset >= reach, gram - reach), (right, size - offset - _GRAM >= reach, gram)):
        some, first = np.flatnonzero(has), first[has]
        h = np.full(len(some), len(out) and (1 if out is left else 2), np.uint64)
        for at in [*range(0, reach, _GRAM), reach]:
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + words[first + at])
        out[some] = h
    return left, right


def _contents(words: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each piece."""
    h = size.astype(np.uint64)
    for at in range(0, int(size.max()) if len(size) else 0, _GRAM):
        some = np.flatnonzero(size > at)
        h[some] = mix64(h[some] * np.uint64(0x9E3779B97F4A7C15) + words[start[some] + np.minimum(at, size[some] - _GRAM)])
    return h


def repeated_windows(head: np.ndarray, body: np.ndarray, length: int) -> np.ndarray:
    """The spans (doc, crc, start, end) that windows of smaller documents cover, of the pieces of one bucket."""
    reach = (length - _GRAM) // 2
    size = head["windows"].astype(np.int64) + length - 1
    start = np.cumsum(size) - size
    words = _words(body)
    for again in range(2):  # first by documents; then, of different pieces, by pieces
        left, right = _sides(words, start, size, head["offset"].astype(np.int64), reach)
        if again:
            break
        doc = head["doc"]
        shared = np.zeros(len(head), bool)
        for side in (left, right):
            some = np.flatnonzero(side)
            if len(some):
                shared[some] |= _several(side[some], doc[some], doc[some])
        head, start, size = head[shared], start[shared], size[shared]
        if not len(head):
            return np.zeros(0, _SPAN)
        _, one, piece = np.unique(_contents(words, start, size), return_index=True, return_inverse=True)
        least = np.full(len(one), np.iinfo(np.int64).max)
        np.minimum.at(least, piece, head["doc"])
        spans = [_whole(head[head["doc"] > least[piece]], length)]
        # from here on, a row for each different piece
        firsts = np.flatnonzero(head["doc"] == least[piece])
        of = piece[firsts]
        head_of_firsts = head[firsts]
        own, start, size = head[one].copy(), start[one], size[one]
        own["doc"] = least
        head = own
    mixed = np.zeros(len(head), bool)
    number = np.arange(len(head))
    for side in (left, right):
        some = np.flatnonzero(side)
        if len(some):
            mixed[some] |= _several(side[some], number[some], number[some])
    rows = np.flatnonzero(mixed)
    if not len(rows):
        return np.concatenate(spans)
    size = size[rows]
    text = _gather(body, start[rows], size)
    eight = grams(text)
    suffixes = suffix_array(text, length, eight)
    new = common_prefixes(text, suffixes, length, eight) < length
    group = np.empty(len(text), np.int64)
    group[suffixes] = np.cumsum(new) - 1
    del suffixes, eight
    at = np.repeat(np.arange(len(rows)), size)
    inside = np.arange(len(text)) - np.repeat(np.cumsum(size) - size, size)
    window = inside < head["windows"][rows][at]
    doc = head["doc"][rows][at]
    lowest = np.full(int(group.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(lowest, group[window], doc[window])
    begin, end = _runs(window & (lowest[group] < doc), inside == 0)
    # the runs of each different piece go to every row that is the first with it (several rows may share a doc_id)
    run_of = rows[at[begin]]
    order = np.argsort(of, kind="stable")
    lo, hi = np.searchsorted(of[order], run_of, "left"), np.searchsorted(of[order], run_of, "right")
    run = np.repeat(np.arange(len(begin)), hi - lo)
    row = head_of_firsts[order[np.repeat(lo - np.cumsum(hi - lo) + (hi - lo), hi - lo) + np.arange(len(run))]]
    out = np.empty(len(run), _SPAN)
    out["doc"], out["crc"] = row["doc"], row["crc"]
    out["start"] = row["pos"] + inside[begin[run]]
    out["end"] = out["start"] + (end - begin)[run] + length - 1
    return np.concatenate([*spans, out])


def _whole(head: np.ndarray, length: int) -> np.ndarray:
    out = np.empty(len(head), _SPAN)
    out["doc"], out["crc"], out["start"] = head["doc"], head["crc"], head["pos"]
    out["end"] = head["pos"] + head["windows"] + (length - 1)
    return out


def _find(cut: DataFrame, parts: int, length: int) -> DataFrame:
    """part, n, spans: what is repeated in some documents of a part."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        if len(group) and group["bucket"].iloc[0] < 0:
            return pd.DataFrame({"part": -1 - group["bucket"], "n": group["n"], "spans": group["body"]})
        heads, bodies = [], []
        for n, packed in zip(group["n"], group["body"]):
            raw = zstandard.ZstdDecompressor().decompress(packed)
            heads.append(_fields(raw, _HEAD, n))
            bodies.append(np.frombuffer(raw[n * _HEAD.itemsize :], np.uint8))
        spans = repeated_windows(np.concatenate(heads), np.concatenate(bodies), length)
        part = _part(spans["doc"], spans["crc"], parts)
        order = np.argsort(part, kind="stable")
        spans, part = spans[order], part[order]
        found, at = np.unique(part, return_index=True)
        rows = [(p, y - x, _pack(spans[x:y])) for p, x, y in zip(found, at, np.append(at[1:], len(part)))]
        return pd.DataFrame(rows, columns=["part", "n", "spans"])

    return cut.groupBy("bucket").applyInPandas(run, "part long, n int, spans binary")


def _part(doc: np.ndarray, crc: np.ndarray, parts: int) -> np.ndarray:
    return (mix64(doc.astype(np.int64).view(np.uint64) ^ (crc.astype(np.uint64) << np.uint64(32))) >> np.uint64(1)).astype(np.int64) % parts


def _shrink(docs: DataFrame, parts: int, twins: bool) -> DataFrame:
    """part, doc_id, crc, packed: the texts, compressed to be moved."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            raws = [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in batch["text"]]
            crc = np.array([zlib.crc32(r) if twins else 0 for r in raws], np.uint32)
            doc = np.array([-1 if d is None else int(d) for d in batch["doc_id"]], np.int64)
            yield pd.DataFrame({"part": _part(doc, crc, parts), "doc_id": batch["doc_id"].array, "crc": crc.astype(np.int64), "packed": [press.compress(r) for r in raws]})

    # ids pass Python as text, since pandas has no whole numbers with nulls
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, "part long, doc_id string, crc long, packed binary")


def _keep(texts: pd.DataFrame, spans: pd.DataFrame, with_text: bool) -> pd.DataFrame:
    found = [_fields(zstandard.ZstdDecompressor().decompress(s), _SPAN, n) for n, s in zip(spans["n"], spans["spans"])]
    all_spans = np.concatenate(found) if found else np.zeros(0, _SPAN)
    all_spans = all_spans[np.lexsort((all_spans["start"], all_spans["crc"], all_spans["doc"]))]
    edge = np.append(True, (all_spans["doc"][1:] != all_spans["doc"][:-1]) | (all_spans["crc"][1:] != all_spans["crc"][:-1])) if len(all_spans) else []
    at = np.flatnonzero(edge)
    of = {(int(all_spans["doc"][x]), int(all_spans["crc"][x])): all_spans[x:y] for x, y in zip(at, np.append(at[1:], len(all_spans)))}
    open_ = zstandard.ZstdDecompressor()
    rows = []
    for doc, crc, packed in zip(texts["doc_id"], texts["crc"], texts["packed"]):
        raw = open_.decompress(packed) if packed else b""
        mine = None if doc is None else of.get((int(doc), int(crc)))
        rows.append(_cleaned(doc, raw, mine, with_text))
    return pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def _cleaned(doc, raw: bytes, spans: np.ndarray | None, with_text: bool) -> tuple:
    kept, n_spans = raw, 0
    if spans is not None:
        depth = np.zeros(len(raw) + 1, np.int64)
        np.add.at(depth, spans["start"], 1)
        np.add.at(depth, spans["end"], -1)
        gone = np.cumsum(depth)[:-1] > 0
        n_spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
    return doc, len(raw), len(raw) - len(kept), n_spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay, if asked for) of each row.

    A byte goes if a window of `length` bytes over it also starts in a document with a smaller doc_id. Copies of a whole
    text are settled first, on hashes alone, so that only the first of them is cut up.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    named = docs.withColumn("name", F.md5("text"))
    first = staged(named.where("doc_id is not null and text is not null").groupBy("name").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("name", "first"), "copies")
    marked = named.join(sized(first), "name", "left").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)) & (F.octet_length("text") >= length))
    single = marked.where("not copy")
    total = single.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(12, total // PART_BYTES)
    # rows that share a doc_id are told apart by their texts' checksums, which are sent only then
    twins = not docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    cut = _cut(single.where("doc_id is not null and text is not null"), max(12, 33 * total // (10 * BUCKET_BYTES)), parts, length, twins)
    spans = staged(_find(cut, parts, length), "spans")
    schema = "doc_id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    kept = _shrink(single, parts, twins).groupBy("part").cogroup(spans.groupBy("part")).applyInPandas(lambda t, s: _keep(t, s, with_text), schema)
    kept = kept.withColumn("doc_id", F.col("doc_id").cast("long"))
    gone = F.octet_length("text").cast("long")
    nothing = F.lit(b"")
    return kept.unionByName(
        marked.where("copy").select("doc_id", gone.alias("n_bytes"), gone.alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(nothing, 256).alias("kept_sha256"), (nothing if with_text else F.lit(None).cast("binary")).alias("kept"))
    )
