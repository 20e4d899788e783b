"""MinHash near-duplicates with tensored banding.

Two small collections of M band hashes, of R minhashes each, are computed per set; every pair (a_i, b_j) of them keys
one of M * M tables. So M * M tables of 2 * R minhashes take 2 * M * R minhash functions instead of 2 * M * M * R.
Sets that share a table key are gathered in coarse clusters, and every pair of different sets of a cluster is confirmed
on the full sets, block against block, so no link between different sets is lost once they share a key.

Defined results: null or white text has an empty set and links with nothing. Fewer than five words are one shingle.
Rows with equal sets share one node, so copies are never compared. A row with a null doc_id belongs to the component of
its set, but never names it and is not kept; a set that only such rows have links with nothing and has a null
component_id. `representative` is kept, and true for rows of a null component_id too. Repeated rows give repeated
results. Of equal band hashes the node of the smaller name leads, which decides no result. A text is read whole; its set is
one cell in the comparison. Columns other than doc_id and text are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import WordIds, mix64, sized, slices, split_words, staged
from quire.llm.graph import components

WIDTH = 5
#: Band hashes in each collection, and minhashes in each band hash. A link of similarity 0.85 shares no table key with
#: probability below 2 * (1 - 0.85 ** 3) ** 12, or 1 in 45,000.
M, R = 12, 3
#: Nodes in a block; a coarse cluster of more nodes is compared block against block.
BLOCK = 512
_STEP = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93], dtype=np.uint64)
_FUNCTIONS = mix64(np.arange(1, 4 * M * R + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(2, 2 * M * R, 1)


class Shingles:
    """Sorted distinct 64-bit shingle hashes of texts."""

    def __init__(self, width: int = WIDTH, room: int = 150_000):
        self.width, self.room = width, room
        self.ids, self.hashes = WordIds(), np.zeros(0, np.uint64)

    def __call__(self, texts) -> list[np.ndarray]:
        if len(self.ids) > self.room:
            self.ids, self.hashes = WordIds(), np.zeros(0, np.uint64)
        words, sizes = split_words(texts)
        ids = self.ids.ids(words)
        if len(self.ids) > len(self.hashes):
            new = list(self.ids)[len(self.hashes) :]
            self.hashes = np.concatenate([self.hashes, np.fromiter((xxhash.xxh3_64_intdigest(w) for w in new), np.uint64, len(new))])
        h = self.hashes[ids]
        k, n = self.width, len(h)
        at = np.zeros(max(0, n - k + 1), np.uint64)
        step = [_STEP[i % 5] + np.uint64(2 * (i // 5)) for i in range(k)]
        for i in range(k if n >= k else 0):
            at += h[i : n - k + 1 + i] * step[i]
        at = mix64(at)
        out, start = [], 0
        for size in sizes:
            if size >= k:
                out.append(np.unique(at[start : start + size - k + 1]))
            elif size:
                one = np.uint64(size)
                for i in range(size):
                    one = np.uint64((int(one) + int(h[start + i]) * int(step[i])) & (2**64 - 1))
                out.append(mix64(np.array([one ^ np.uint64(0x5851F42D4C957F2D)])))
            else:
                out.append(np.zeros(0, np.uint64))
            start += size
        return out


def _bands(s: np.ndarray) -> np.ndarray:
    """2 * M band hashes of a set."""
    low = np.full(2 * M * R, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 2048):
        np.minimum(low, ((s[None, at : at + 2048] ^ _FUNCTIONS[0]) * (_FUNCTIONS[1] | np.uint64(1))).min(axis=1), out=low)
    low = mix64(low).reshape(2 * M, R)
    out = low[:, 0]
    for i in range(1, R):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + low[:, i])
    return out.view(np.int64)


def _name(s: np.ndarray) -> tuple[int, int]:
    """A set's 128-bit fingerprint."""
    twin = np.array([s.sum(dtype=np.uint64), mix64(s ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)], np.uint64).view(np.int64)
    return int(twin[0]), int(twin[1])


def sketches(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, text_key (a hash of the text), n_shingles, fp1, fp2 (the set's fingerprint), a, b (its band hashes; null
    for an empty set)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingles(width)
        for part in slices(parts):
            rows = []
            for s in shingles(part["text"]):
                bands = _bands(s) if len(s) else None
                rows.append((len(s), *_name(s), None if bands is None else bands[:M], None if bands is None else bands[M:]))
            out = pd.DataFrame(rows, columns=["n_shingles", "fp1", "fp2", "a", "b"])
            out.insert(0, "doc_id", part["doc_id"].array)
            out.insert(1, "text_key", part["text_key"].array)
            yield out

    # ids pass Python as text, since pandas has no whole numbers with nulls
    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    found = rows.mapInPandas(run, "doc_id string, text_key long, n_shingles long, fp1 long, fp2 long, a array<long>, b array<long>")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def coarse_clusters(nodes: DataFrame) -> DataFrame:
    """(node, cluster) of nodes that share a table key with another, from nodes (node, a, b).

    Only nodes that share a hash of each collection with some other node can share a pair of them, so the others leave
    before the M * M keys are formed.
    """
    half = None
    for side in ("a", "b"):
        keys = nodes.select("node", F.posexplode(side).alias("i", "h"))
        shared = keys.groupBy("i", "h").agg(F.count("*").alias("n")).where("n > 1").select("i", "h")
        some = keys.join(shared, ["i", "h"]).select("node").distinct()
        half = some if half is None else half.join(some, "node")
    near = nodes.join(half, "node")
    keys = staged(
        near.select("node", F.explode(F.expr("flatten(transform(a, (x, i) -> transform(b, (y, j) -> xxhash64(i, j, x, y))))")).alias("key")), "keys"
    )
    heads = keys.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("last")).where("head <> last").select("key", "head")
    edges = keys.join(heads, "key").select(F.col("node").alias("u"), F.col("head").alias("v")).distinct()
    return components(edges).withColumnRenamed("component", "cluster")


def _links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs (i, j), i from left and j from right, of sets whose similarity reaches percent.

    Shared shingles are counted through an inverted list, some rows of left at a time.
    """
    size = np.array([len(s) for s in sets])
    flat = np.concatenate([sets[j] for j in right])
    owner = np.repeat(np.arange(len(right)), size[right])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    found = []
    for i in left:
        lo, hi = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
        some = hi > lo
        if not some.any():
            continue
        lo, n = lo[some], (hi - lo)[some]
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=len(right))
        hit = np.flatnonzero(100 * both >= percent * (size[i] + size[right] - both))
        found += [(int(i), int(right[j])) for j in hit if right[j] != i]
    return found


def _forest(pairs: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """The pairs that join what was apart; the others add nothing to components."""
    up = list(range(n))
    kept = []
    for x, y in pairs:
        a, b = x, y
        while up[a] != a:
            up[a] = a = up[up[a]]
        while up[b] != b:
            up[b] = b = up[up[b]]
        if a != b:
            up[max(a, b)] = min(a, b)
            kept.append((x, y))
    return kept


def confirmed_links(docs: DataFrame, nodes: DataFrame, clusters: DataFrame, percent: int, width: int = WIDTH) -> DataFrame:
    """Links (u, v) between nodes of a cluster, enough of them to join all that links connect."""
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("n"))
    members = staged(
        clusters.join(sizes, "cluster").join(nodes.select("node", "doc_id", "fp1", "fp2"), "node").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")), "members"
    )
    wanted = sized(members.select("doc_id", "fp1", "fp2", "node", "cluster", "blocks"))

    def sets(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingles(width)
        for part in slices(parts):
            found = shingles(part["text"])
            mine = [_name(s) == (a, b) for s, a, b in zip(found, part["fp1"], part["fp2"])]
            out = part.loc[mine, ["node", "cluster", "blocks"]].copy()
            out["shingles"] = [s.tobytes() for s, m in zip(found, mine) if m]
            yield out

    one = docs.select(F.col("doc_id").cast("long"), "text").join(wanted, "doc_id")
    full = one.select("node", "cluster", "blocks", "fp1", "fp2", "text").mapInPandas(sets, "node long, cluster long, blocks int, shingles binary")
    packs = max(64, members.count() // 256)
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = full.withColumn("own", own).withColumn("other", other).select(
        "node", "cluster", "shingles", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"),
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("cluster"), F.lit(packs))).otherwise(F.xxhash64("cluster")).alias("pack"),
    )

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for _, group in part.drop_duplicates(["node"]).groupby("cluster"):
            s = [np.frombuffer(x, np.uint64) for x in group["shingles"]]
            ids, own = group["node"].to_numpy(), group["own"].to_numpy()
            x, y = group["x"].iloc[0], group["y"].iloc[0]
            left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
            if len(left) and len(right):
                rows += [(ids[i], ids[j]) for i, j in _forest(_links(s, left, right, percent), len(s))]
        return pd.DataFrame(rows, columns=["u", "v"])

    return dealt.groupBy("pack", "x", "y").applyInPandas(compare, "u long, v long")


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_key: components of documents whose shingle sets reach percent of similarity."""
    rows = staged(sketches(docs, width), "sketches")
    # a node is a distinct set; its name is the least doc_id that has it
    same = rows.where("n_shingles > 0").groupBy("fp1", "fp2").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("a").alias("a"), F.first("b").alias("b"))
    nodes = staged(same.where("doc_id is not null").withColumn("node", F.xxhash64("fp1", "fp2")), "nodes")
    clusters = staged(coarse_clusters(nodes), "clusters")
    links = staged(confirmed_links(docs, nodes, clusters, percent, width), "links")
    joined = components(links)
    named = joined.join(nodes.select("node", "doc_id"), "node")
    least = named.groupBy("component").agg(F.min("doc_id").alias("least"))
    moved = named.join(least, "component").select("node", "least")
    final = staged(
        nodes.where("copies > 1").select("fp1", "fp2", "node", "doc_id").unionByName(nodes.where("copies = 1").join(moved, "node", "left_semi").select("fp1", "fp2", "node", "doc_id"))
        .join(moved, "node", "left").select("fp1", "fp2", F.coalesce("least", "doc_id").alias("least")), "components",
    )
    out = rows.select("doc_id", "text_key", "n_shingles", "fp1", "fp2").join(sized(final), ["fp1", "fp2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("least", "doc_id")).otherwise(F.col("doc_id"))
    kept = F.col("doc_id") == F.col("component_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), "text_key").select(
        "doc_id", "n_shingles", "component_id", F.coalesce(kept, F.lit(False)).alias("kept"), "text_key", F.coalesce(kept, F.col("component_id").isNull()).alias("representative")
    )
