"""Sentences and budgeted chunks of encoded words."""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.wordlists import ABBREVIATIONS
from quire.operators.windows import as_of, islands

TARGET, OPENING_TARGET, LEAST, LONG_SENTENCE, BUDGET = 250, 110, 60, 340, 510
CLAUSE = r"[,;:—–][\"'”’)\]]*$"
_BLOCK = ["doc_id", "block_idx"]


def sentence_end(token: Column) -> Column:
    """Whether a token ends a sentence: ! and ? do; a period does, but after initials, abbreviations and inner periods."""
    bare = F.regexp_replace(token, r"[\"'”’)\]}]+$", "")
    core = F.regexp_replace(bare, r"\.$", "")
    period = (F.length(core) > 1) & ~core.contains(".") & ~F.lower(core).isin(ABBREVIATIONS)
    ends = F.when(bare.rlike(r"[!?]$"), True).when(bare.rlike(r"\.$"), period).otherwise(False)
    # most tokens have none of these marks, and are told without the patterns
    return F.when(token.contains(".") | token.contains("!") | token.contains("?"), ends).otherwise(False)


def word_symbol_ranges(words: DataFrame) -> DataFrame:
    """words (doc_id, block_idx, token_idx, symbols, joined) with lo and hi in the block's symbol sequence.

    A separator stands before a word that is not joined, has symbols and has a word with symbols before it.
    """
    along = W.partitionBy(*_BLOCK).orderBy("token_idx")
    before = F.coalesce(F.sum("symbols").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    w = words.withColumn("_sep", F.when((F.col("symbols") > 0) & ~F.col("joined") & (before > 0), 1).otherwise(0))
    hi = F.sum(F.col("symbols") + F.col("_sep")).over(along.rowsBetween(W.unboundedPreceding, 0))
    return w.withColumn("hi", hi.cast("int")).withColumn("lo", (F.col("hi") - F.col("symbols")).cast("int")).drop("_sep")


def sentences(words: DataFrame) -> DataFrame:
    """words (with is_end, joined) with sentence_id; a sentence does not end before a joined word."""
    before = F.lag("is_end").over(W.partitionBy(*_BLOCK).orderBy("token_idx"))
    return islands(words, _BLOCK, ["token_idx"], before & ~F.col("joined"), "sentence_id")


def _greedy(words: tuple, a: int, b: int, target: int, cut_anywhere: bool) -> list[int]:
    """Places in words (lists of lo, hi, clause, joined) at which a new run starts, between a and b.

    A run is cut at the last place that may be cut once it grows over target, and before the word that would pass the
    budget if there is no such place.
    """
    lo, hi, clause, joined = words
    at, start, cut, is_open, out = a, lo[a], -1, False, []
    for i in range(a, b):
        # the word before may have been a place to cut, now that this word is known
        if is_open and not joined[i]:
            cut = i
        if cut > at and hi[i] - start > target:
            out.append(cut)
            at, start = cut, lo[cut]
            if i > at and hi[i] - start > BUDGET:
                out.append(i)
                at, start = i, lo[i]
        elif i > at and hi[i] - start > BUDGET and cut <= at:
            out.append(i)
            at, start = i, lo[i]
        is_open = cut_anywhere or clause[i]
    return out


def _runs(words: tuple, fresh: list[int], target: int) -> list[int]:
    """Where the pieces of a block's words start: sentences, those over the long limit cut at clauses to the target, and
    what is still too long cut evenly at any word. fresh tells where sentences start."""
    lo, hi = words[:2]
    starts, n = [], len(lo)
    for a, b in zip(fresh, fresh[1:] + [n]):
        if hi[b - 1] - lo[a] <= LONG_SENTENCE:
            starts.append(a)
            continue
        parts = [a] + _greedy(words, a, b, target, False)
        for c, d in zip(parts, parts[1:] + [b]):
            size = hi[d - 1] - lo[c]
            starts.append(c)
            if size > LONG_SENTENCE:
                starts += _greedy(words, c, d, ceil(size / ceil(size / target)), True)
    return starts


def split_long(words: DataFrame) -> DataFrame:
    """words (with lo, hi, sentence_id, target, and clause or token) with piece_id: sentences over the long limit are cut
    at clauses to the target, and what is still too long is cut evenly at any word.

    A block's words are gathered once and cut in place, so that nothing is joined back.
    """

    @F.pandas_udf("struct<at:array<int>,piece:array<int>>")
    def cut(token_idx: pd.Series, lo: pd.Series, hi: pd.Series, clause: pd.Series, joined: pd.Series, sentence: pd.Series, target: pd.Series) -> pd.DataFrame:
        at, piece = [], []
        for idx, *row in zip(token_idx, lo, hi, clause, joined, sentence, target):
            order = np.argsort(idx, kind="stable")
            low, high, clauses, joins, told = (c[order] for c in row[:5])
            fresh = np.flatnonzero(np.diff(told, prepend=told[0] - 1)).tolist()
            starts = _runs((low.tolist(), high.tolist(), clauses.tolist(), joins.tolist()), fresh, int(row[5][order[0]]))
            mark = np.zeros(len(low), dtype=np.int32)
            mark[starts] = 1
            at.append(order)
            piece.append(np.cumsum(mark) - 1)
        return pd.DataFrame({"at": at, "piece": piece}, dtype=object)

    clause = F.col("clause") if "clause" in words.columns else F.col("token").rlike(CLAUSE)
    rest = [c for c in words.columns if c not in _BLOCK]
    rows = words.withColumn("_clause", clause).groupBy(*_BLOCK).agg(F.collect_list(F.struct(*rest, "_clause")).alias("t"))
    rows = rows.select(*_BLOCK, "t", cut(*[F.col(f"t.{c}") for c in ("token_idx", "lo", "hi", "_clause", "joined", "sentence_id", "target")]).alias("c"))
    each = rows.select(*_BLOCK, "t", F.inline(F.arrays_zip(F.col("c.at").alias("at"), F.col("c.piece").alias("piece_id"))))
    each = each.select(*_BLOCK, F.get("t", F.col("at")).alias("t"), "piece_id")
    return each.select(*[c if c in _BLOCK else F.col(f"t.{c}") for c in words.columns], "piece_id")


def _bounds(starts: Column, end: Column) -> Column:
    """(a, b) of runs that start at `starts`, each up to the next one, the last up to end."""
    following = F.concat(F.slice(starts, F.lit(2), F.greatest(F.size(starts) - 1, F.lit(0))), F.array(end))
    return F.zip_with(starts, following, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def pieces(words: DataFrame) -> DataFrame:
    """doc_id, block_idx, piece_id, lo, hi, first, last, target of words with piece_id."""
    return words.groupBy(*_BLOCK, "piece_id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("token_idx").alias("first"), F.max("token_idx").alias("last"), F.max("target").alias("target"))


def _packed(parts: Column) -> Column:
    """The chunks (a, b) of a block's pieces (lo, hi, target), by place."""
    zero = F.struct(F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, p: Column) -> Column:
        both, least = p["hi"] - s["lo"], F.least(F.lit(LEAST), p["target"] / 2)
        joins = (s["i"] > 0) & ((both <= p["target"]) | ((s["hi"] - s["lo"] < least) & (both <= BUDGET)))
        return F.struct(F.when(joins, s["lo"]).otherwise(p["lo"]).alias("lo"), p["hi"].alias("hi"), (s["i"] + 1).alias("i"), F.when(joins, s["out"]).otherwise(F.array_append(s["out"], s["i"])).alias("out"))

    return _bounds(F.aggregate(parts, zero, step, lambda s: s["out"]), F.size(parts))


def pack_chunks(parts: DataFrame) -> DataFrame:
    """pieces with chunk_idx: whole pieces are packed up to the target, a short chunk takes the next one regardless."""
    rest = [c for c in parts.columns if c not in (*_BLOCK, "piece_id")]
    rows = parts.groupBy(*_BLOCK).agg(F.array_sort(F.collect_list(F.struct("piece_id", F.struct(*rest).alias("x")))).alias("p"))
    runs = _packed(F.transform("p", lambda p: p["x"]))
    packed = rows.select(*_BLOCK, "p", F.posexplode(runs).alias("chunk_idx", "run")).select(*_BLOCK, "chunk_idx", F.explode(F.slice("p", F.col("run.a") + 1, F.col("run.b") - F.col("run.a"))).alias("p"))
    return packed.select(*[c if c in _BLOCK else F.col("p.piece_id") if c == "piece_id" else F.col(f"p.x.{c}") for c in parts.columns], "chunk_idx")


def chunks_of(packed: DataFrame) -> DataFrame:
    """doc_id, block_idx, chunk_idx, lo, hi, first, last, target of packed pieces."""
    return packed.groupBy(*_BLOCK, "chunk_idx").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("first").alias("first"), F.max("last").alias("last"), F.max("target").alias("target"))


def _short(lo: Column, hi: Column, target: Column, before: Column) -> Column:
    """Whether a block's last chunk joins the one that starts at before."""
    return (hi - lo < F.least(F.lit(LEAST), target / 2)) & (hi - before <= BUDGET)


def tail_merge(chunks: DataFrame) -> DataFrame:
    """chunks with a short last one joined to the one before, if both fit the budget."""
    along = W.partitionBy(*_BLOCK).orderBy("chunk_idx")
    last, before = F.lead("chunk_idx").over(along).isNull(), F.lag("lo").over(along)
    short = last & before.isNotNull() & _short(F.col("lo"), F.col("hi"), F.col("target"), before)
    merged = chunks.withColumn("chunk_idx", F.when(F.coalesce(short, F.lit(False)), F.col("chunk_idx") - 1).otherwise(F.col("chunk_idx")))
    return chunks_of(merged)


def cut_oversize(words: DataFrame, chunks: DataFrame) -> DataFrame:
    """words of chunks with their ranges inside the chunk, cut at the budget: chunk_idx, lo, hi."""
    c = chunks.select(*_BLOCK, "chunk_idx", F.col("lo").alias("c_lo"), "first", "last")
    held = as_of(words, c, _BLOCK, "token_idx", "first", ["chunk_idx", "c_lo", "last"]).where(F.col("token_idx") <= F.col("last"))
    lo = F.least(F.col("lo") - F.col("c_lo"), F.lit(BUDGET))
    return held.select(*_BLOCK, "token_idx", "chunk_idx", lo.alias("lo"), F.greatest(lo, F.least(F.col("hi") - F.col("c_lo"), F.lit(BUDGET))).alias("hi"))


def aimed(blocks: DataFrame) -> DataFrame:
    """blocks with target: the first two main-stream blocks of a document are cut finer."""
    main = F.col("role").isin("body", "heading")
    nth = F.sum(F.when(main, 1).otherwise(0)).over(W.partitionBy("doc_id").orderBy("block_idx").rowsBetween(W.unboundedPreceding, 0))
    return blocks.withColumn("target", F.when(main & (nth <= 2), OPENING_TARGET).otherwise(TARGET))


def opening_target(blocks: DataFrame) -> DataFrame:
    """doc_id, block_idx, target of blocks."""
    return aimed(blocks).select("doc_id", "block_idx", "target")


def _packed_in_place(parts: list[tuple]) -> list[tuple]:
    """Chunks (lo, hi, first, last, target) of a block's pieces (the same), packed and with a short tail merged."""
    out: list[list] = []
    for lo, hi, first, last, target in parts:
        if out:
            c = out[-1]
            both = hi - c[0]
            if both <= target or (c[1] - c[0] < min(LEAST, target / 2) and both <= BUDGET):
                c[1], c[3] = hi, last
                continue
        out.append([lo, hi, first, last, target])
    if len(out) > 1:
        before, tail = out[-2:]
        if tail[1] - tail[0] < min(LEAST, tail[4] / 2) and tail[1] - before[0] <= BUDGET:
            out[-2:] = [[before[0], tail[1], before[2], tail[3], before[4]]]
    return [tuple(c) for c in out]


def chunk_documents(block_tokens: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Chunks of blocks: every token has its letters as symbols, and no token is joined to the next.

    The same as tail_merge(chunks_of(pack_chunks(pieces(split_long(words))))), but a block's words are gathered once,
    without their text, and stay in its row until its chunks are told. Targets may stand in the tokens' own column target,
    so that no words are shuffled to meet them.
    """

    @F.pandas_udf("array<struct<lo:int,hi:int,first:int,last:int,target:int>>")
    def chunked(token_idx: pd.Series, symbols: pd.Series, is_end: pd.Series, clause: pd.Series, target: pd.Series) -> pd.Series:
        out = []
        for idx, size, ends, clauses, goal in zip(token_idx, symbols, is_end, clause, target):
            order = np.argsort(idx, kind="stable")
            idx, size = idx[order], size[order].astype(np.int64)
            # a separator stands before a word with symbols that has one before it
            before = np.cumsum(size) - size
            hi = np.cumsum(size + ((size > 0) & (before > 0)))
            lo = hi - size
            fresh = [0] + (np.flatnonzero(ends[order][:-1]) + 1).tolist()
            low, high, at = lo.tolist(), hi.tolist(), idx.tolist()
            starts = _runs((low, high, clauses[order].tolist(), [False] * len(at)), fresh, int(goal))
            parts = [(low[a], high[b - 1], at[a], at[b - 1], int(goal)) for a, b in zip(starts, starts[1:] + [len(at)])]
            out.append([dict(zip(("lo", "hi", "first", "last", "target"), c)) for c in _packed_in_place(parts)])
        return pd.Series(out, dtype=object)

    word = F.struct("token_idx", F.length("token").alias("symbols"), sentence_end(F.col("token")).alias("is_end"), F.col("token").rlike(CLAUSE).alias("clause"))
    own = [] if targets is not None else [F.first("target").alias("target")]
    rows = block_tokens.groupBy(*_BLOCK).agg(F.collect_list(word).alias("t"), *own)
    rows = rows if targets is None else rows.join(targets, _BLOCK)
    rows = rows.select(*_BLOCK, chunked("t.token_idx", "t.symbols", "t.is_end", "t.clause", "target").alias("c"))
    return rows.select(*_BLOCK, F.posexplode("c").alias("chunk_idx", "c")).select(*_BLOCK, "chunk_idx", "c.lo", "c.hi", "c.first", "c.last", "c.target")


def passages(tokens: DataFrame, limit: int = 120) -> DataFrame:
    """tokens with passage_id: at most `limit` tokens, cut after the last sentence end, else clause end, of the final two
    thirds, else hard."""
    ends = F.transform("t", lambda x: x["e"])
    rows = tokens.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("token_idx", F.when(F.col("token").rlike(r"[.!?…][\"'”’)\]]*$"), 2).when(F.col("token").rlike(CLAUSE), 1).otherwise(0).alias("e")))).alias("t"))
    rows = rows.select("doc_id", ends.alias("e"), F.size("t").alias("n"))
    least = limit - limit // 3
    zero = F.struct(F.lit(0).alias("at"), F.array(F.lit(0)).alias("out"))

    def step(s: Column, _: Column) -> Column:
        window = F.slice("e", s["at"] + limit // 3 + 1, F.lit(least))
        best = lambda k: F.array_max(F.transform(window, lambda x, i: F.when(x == k, i + limit // 3 + 1)))
        cut = s["at"] + F.coalesce(best(2), best(1), F.lit(limit))
        done = F.col("n") - s["at"] <= limit
        return F.struct(F.when(done, s["at"]).otherwise(cut).alias("at"), F.when(done, s["out"]).otherwise(F.array_append(s["out"], cut)).alias("out"))

    steps = F.sequence(F.lit(0), F.ceil(F.col("n") / (limit // 3)).cast("int"))
    starts = rows.select("doc_id", F.explode(F.aggregate(steps, zero, step, lambda s: s["out"])).alias("token_idx")).withColumn("_s", F.lit(1))
    along = W.partitionBy("doc_id").orderBy("token_idx").rowsBetween(W.unboundedPreceding, 0)
    return tokens.join(starts, ["doc_id", "token_idx"], "left").withColumn("passage_id", (F.sum(F.coalesce("_s", F.lit(0))).over(along) - 1).cast("int")).drop("_s")


def encode_symbols(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """doc_id, token_idx, pos, symbol, id of each symbol; id is null where the vocabulary (symbol, id) lacks it."""
    each = tokens.select("doc_id", "token_idx", F.posexplode(F.filter(F.split("token", ""), lambda x: x != "")).alias("pos", "symbol"))
    return each.join(F.broadcast(vocabulary), "symbol", "left").select("doc_id", "token_idx", "pos", "symbol", "id")


def unknown_symbols(encoded: DataFrame, top: int = 8) -> DataFrame:
    """The most frequent symbols without an id."""
    return encoded.where("id is null").groupBy("symbol").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "symbol").limit(top)


def vocab_audit(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """symbol, problem, n: symbols of tokens that the vocabulary (symbol, id) lacks, and those of it that no token has."""
    symbols = tokens.select(F.explode(F.filter(F.split("token", ""), lambda x: x != "")).alias("symbol")).groupBy("symbol").agg(F.count("*").alias("n"))
    both = symbols.join(vocabulary.select("symbol", F.lit(True).alias("known")), "symbol", "full")
    problem = F.when(F.col("known").isNull(), "not in the vocabulary").when(F.col("n").isNull(), "in no text")
    return both.select("symbol", problem.alias("problem"), F.coalesce("n", F.lit(0)).alias("n")).where("problem is not null")


def route_streams(chunks: DataFrame, blocks: DataFrame) -> DataFrame:
    """chunks with stream (the block of a footnote, else main) and over (whether they pass the budget)."""
    c = chunks.join(blocks.select(*_BLOCK, "role"), _BLOCK)
    return c.withColumn("stream", F.when(F.col("role") == "footnoteBody", F.concat(F.lit("note-"), F.col("block_idx"))).otherwise("main")).withColumn("over", F.col("hi") - F.col("lo") > BUDGET)


def uniform_chunks(words: DataFrame, budget: int = BUDGET) -> DataFrame:
    """words (lo, hi, is_end) with chunk_idx: blocks over the budget are cut to an even target, backing off to a sentence
    end in its last quarter."""

    @F.pandas_udf("struct<at:array<int>,chunk:array<int>>")
    def cut(token_idx: pd.Series, lo: pd.Series, hi: pd.Series, is_end: pd.Series) -> pd.DataFrame:
        at, chunk = [], []
        for idx, *row in zip(token_idx, lo, hi, is_end):
            order = np.argsort(idx, kind="stable")
            mark = np.zeros(len(order), dtype=np.int32)
            mark[_even(*(c[order].tolist() for c in row), budget)] = 1
            at.append(order)
            chunk.append(np.cumsum(mark) - 1)
        return pd.DataFrame({"at": at, "chunk": chunk}, dtype=object)

    rest = [c for c in words.columns if c not in _BLOCK]
    rows = words.groupBy(*_BLOCK).agg(F.collect_list(F.struct(*rest)).alias("t"))
    rows = rows.select(*_BLOCK, "t", cut("t.token_idx", "t.lo", "t.hi", "t.is_end").alias("c"))
    each = rows.select(*_BLOCK, "t", F.inline(F.arrays_zip(F.col("c.at").alias("at"), F.col("c.chunk").alias("chunk_idx"))))
    each = each.select(*_BLOCK, F.get("t", F.col("at")).alias("t"), "chunk_idx")
    return each.select(*[c if c in _BLOCK else F.col(f"t.{c}") for c in words.columns], "chunk_idx")


def _even(lo: list, hi: list, is_end: list, budget: int) -> list[int]:
    """Places at which even chunks of a block's words start."""
    size = max(hi)
    if size <= 0:
        return [0]
    goal = ceil(size / ceil(size / budget))
    at, start, cut, is_open, out = 0, 0, -1, False, [0]
    for i in range(len(lo)):
        if is_open:
            cut = i
        if hi[i] - start > goal and i > at:
            at = cut if cut > at else i
            start = lo[at]
            out.append(at)
        is_open = is_end[i] and hi[i] - start >= goal * 0.75
    return out
