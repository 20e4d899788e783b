"""Small cases with known answers, and plain computations of what SQL does not tell."""

import random
import re

from pyspark.sql import functions as F

from quire.functions.wordlists import ABBREVIATIONS
from quire.operators import chunking, furniture, layout, library, normalize, paragraphs, quality, reflow, timeline, timing, words
from quire.operators.windows import as_of, islands
from quire.streaming import progress


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_islands_and_as_of(spark):
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate([1, 1, 2, 2, 1])] + [("b", 0, 5)], "k string, i int, x int")
    from pyspark.sql import Window as W

    out = islands(df, ["k"], ["i"], F.lag("x").over(W.partitionBy("k").orderBy("i")) != F.col("x"), "n")
    assert rows(out, "k", "i", "n") == [("a", 0, 0), ("a", 1, 0), ("a", 2, 1), ("a", 3, 1), ("a", 4, 2), ("b", 0, 0)]
    left = spark.createDataFrame([("a", 1), ("a", 5), ("a", 9), ("c", 3)], "k string, t int")
    right = spark.createDataFrame([("a", 4, "x"), ("a", 8, "y")], "k string, s int, name string")
    assert sorted(map(repr, rows(as_of(left, right, ["k"], "t", "s", ["name"]), "k", "t", F.coalesce("name", F.lit("-"))))) == sorted(map(repr, [("a", 1, "-"), ("a", 5, "x"), ("a", 9, "y"), ("c", 3, "-")]))
    assert ("a", 1, "x") in rows(as_of(left, right, ["k"], "t", "s", ["name"], True).where("k = 'a'"), "k", "t", "name")


def test_word_timeline_lookups(spark):
    words_ = spark.createDataFrame([(1, i, 0 if i < 120 else 1, 20 * i, 20 * i + 16) for i in range(200)], "doc_id long, word_idx int, block_idx int, start_frame long, end_frame long")
    at = spark.createDataFrame([(k, 1, t) for k, t in enumerate([-5, 0, 19, 20, 2399, 2400, 2470, 99999])], "event_id int, doc_id long, t_frame long")
    assert rows(timeline.word_at(at, words_), "event_id", "word_idx") == [(0, 0), (1, 0), (2, 0), (3, 1), (4, 119), (5, 120), (6, 123), (7, 199)]
    starts = timeline.block_starts(words_)
    assert rows(starts, "block_idx", "start_frame") == [(0, 0), (1, 2400)]
    assert rows(timeline.previous_block(at, starts), "event_id", "back_to") == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 0), (5, 0), (6, 2400), (7, 2400)]
    ends = words_.groupBy("doc_id").agg(F.max("end_frame").alias("duration"))
    assert rows(timeline.next_block(at, starts, ends), "event_id", "forward_to")[4:6] == [(4, 2400), (5, 3996)]
    assert rows(timeline.skip(at, words_, 40), "event_id", "snapped")[:2] == [(0, 20), (1, 40)]


def test_progress_of_ten_chunks(spark):
    events = spark.createDataFrame([(1, i, c, "rendered", 40, 10) for i, c in enumerate([0, 9, 2, 1, 1])], "doc_id long, seq long, chunk_index int, status string, frames long, total_chunks long")
    assert rows(progress.render_progress(events), "prefix", "frames", "seconds", "complete") == [(3, 120, 3.0, False)]
    assert rows(progress.priming(events, 100), "ready_at") == [(3,)]
    bad = spark.createDataFrame([(1, i, s) for i, s in enumerate("rffrfffr")] + [(2, i, s) for i, s in enumerate("frfrf")], "doc_id long, seq long, s string")
    assert rows(progress.failure_breaker(bad.withColumn("status", F.when(F.col("s") == "f", "failed").otherwise("rendered"))), "doc_id", "failed_at") == [(1, 6)]


def test_progress_stream_agrees_with_the_batch_form(spark, tmp_path):
    rng = random.Random(1)
    data = [(i % 3, i, rng.randrange(8), rng.choice(["rendered", "rendered", "failed"]), 40, 8) for i in range(60)]
    schema = "doc_id long, seq long, chunk_index int, status string, frames long, total_chunks long"
    for n in range(3):
        spark.createDataFrame(data[n * 20 : n * 20 + 20], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    query = progress.progress_stream(stream).writeStream.outputMode("update").format("memory").queryName("progress_out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    last = {}
    for r in spark.table("progress_out").collect():
        last[r["doc_id"]] = max(last.get(r["doc_id"], (0, 0)), (r["prefix"], r["frames"]))
    want = {r["doc_id"]: (r["prefix"], r["frames"]) for r in progress.render_progress(spark.createDataFrame(data, schema)).collect()}
    assert last == want
    once = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in").withColumn("ts", F.timestamp_seconds(F.col("seq") + 1_000_000)).withWatermark("ts", "1 hour")
    query = progress.dedupe_requests(once).writeStream.outputMode("append").format("memory").queryName("requests_out").option("checkpointLocation", f"{tmp_path}/state2").trigger(availableNow=True).start()
    query.awaitTermination()
    assert rows(spark.table("requests_out"), "doc_id", "chunk_index") == sorted({(d, c) for d, _, c, *_ in data})


def split(tokens, lens, target):
    """Sentences, pieces and chunks of one block, by plain loops."""
    lo, at = [], 0
    for i, n in enumerate(lens):
        lo.append(at + (1 if i else 0))
        at = lo[-1] + n
    hi = [a + n for a, n in zip(lo, lens)]
    size = lambda a, b: hi[b - 1] - lo[a]

    def is_end(t):
        t = re.sub(r"[\"'”’)\]}]+$", "", t)
        if t[-1:] in "!?" and t:
            return True
        core = t[:-1]
        return t[-1:] == "." and len(core) > 1 and "." not in core and core.lower() not in ABBREVIATIONS

    def pack(a, b, cut_at, goal):
        out, start = [], a
        while start < b:
            end, cut = b, -1
            for w in range(start, b):
                n = size(start, w + 1)
                if w > start and n > 510:
                    end = cut if cut > start else w
                    break
                if n > goal and cut > start:
                    end = cut
                    break
                if w + 1 < b and cut_at(w):
                    cut = w + 1
            out.append((start, end))
            start = end
        return out

    pieces, a = [], 0
    for w in range(len(tokens)):
        if w == len(tokens) - 1 or is_end(tokens[w]):
            for c, e in [(a, w + 1)] if size(a, w + 1) <= 340 else pack(a, w + 1, lambda i: re.search(r"[,;:—–][\"'”’)\]]*$", tokens[i]), target):
                if size(c, e) <= 340:
                    pieces.append((c, e))
                else:
                    n = -(-size(c, e) // target)
                    pieces += pack(c, e, lambda i: True, -(-size(c, e) // n))
            a = w + 1
    chunks = []
    for c, e in pieces:
        if chunks and (size(chunks[-1][0], e) <= target or (size(*chunks[-1]) < min(60, target / 2) and size(chunks[-1][0], e) <= 510)):
            chunks[-1][1] = e
        else:
            chunks.append([c, e])
    if len(chunks) > 1 and size(*chunks[-1]) < min(60, target / 2) and size(chunks[-2][0], chunks[-1][1]) <= 510:
        last = chunks.pop()
        chunks[-1][1] = last[1]
    return pieces, [tuple(c) for c in chunks]


def test_chunks_of_documents(spark):
    rng = random.Random(7)
    blocks, expected_pieces, expected_chunks = [], [], []
    for b in range(40):
        ends = rng.choice([["."], ["", ","], [""], [".", ",", ""], ["", "", "", "", ".", ","]])
        tokens = ["x" * rng.choice([1, 3, 5, 9, 30, 600 if b % 10 == 0 else 7]) + rng.choice(ends) for _ in range(rng.randrange(1, 220))]
        target = 110 if b < 2 else 250
        pieces, chunks = split(tokens, [len(t) for t in tokens], target)
        blocks += [(1, b, i, t) for i, t in enumerate(tokens)]
        expected_pieces += [(b, i, n) for n, (x, y) in enumerate(pieces) for i in range(x, y)]
        expected_chunks += [(b, x, y - 1) for x, y in chunks]
    t = spark.createDataFrame(blocks, "doc_id long, block_idx int, token_idx int, token string")
    targets = spark.createDataFrame([(1, b, 110 if b < 2 else 250) for b in range(40)], "doc_id long, block_idx int, target int")
    w = t.withColumn("symbols", F.length("token")).withColumn("joined", F.lit(False)).withColumn("is_end", chunking.sentence_end(F.col("token")))
    said = chunking.sentences(chunking.word_symbol_ranges(w)).join(targets, ["doc_id", "block_idx"])
    assert rows(chunking.split_long(said), "block_idx", "token_idx", "piece_id") == sorted(expected_pieces)
    assert rows(chunking.chunk_documents(t, targets), "block_idx", "first", "last") == sorted(expected_chunks)


def test_passages(spark):
    rng = random.Random(9)
    docs, expected = [], []
    for d in range(20):
        tokens = ["w" + rng.choice(["", "", "", "", "", ".", ","] if d % 3 else [""]) for _ in range(rng.randrange(1, 500))]
        docs += [(d, i, t) for i, t in enumerate(tokens)]
        at, n = 0, 0
        while at < len(tokens):
            end = len(tokens)
            if end - at > 120:
                cut = next((i + 1 for p in (r"[.!?…]$", r"[,;:—–]$") for i in range(at + 119, at + 39, -1) if re.search(p, tokens[i])), at + 120)
                end = cut
            expected += [(d, i, n) for i in range(at, end)]
            at, n = end, n + 1
    out = chunking.passages(spark.createDataFrame(docs, "doc_id long, token_idx int, token string"))
    assert rows(out, "doc_id", "token_idx", "passage_id") == sorted(expected)


def test_frame_splits_are_exact(spark):
    rng = random.Random(3)
    data = [(g, i, rng.choice([2, 3, 5, 6, 10, 20]), total) for g, total in enumerate([37, 100, 512, 4321, 5]) for i in range(122 if g < 4 else 5)]
    out = timing.distribute_frames(spark.createDataFrame(data, "g int, i int, weight2 long, total long"), ["g"], "i", "total")
    sums = out.groupBy("g").agg(F.sum("frames").alias("s"), F.min("frames").alias("m"))
    assert rows(sums, "g", "s") == [(0, 122), (1, 122), (2, 512), (3, 4321), (4, 5)] and all(r["m"] >= 1 for r in sums.collect())
    even = timing.distribute_frames(spark.createDataFrame([(0, i, 0, 7) for i in range(3)], "g int, i int, weight2 long, total long"), ["g"], "i", "total")
    assert rows(even, "i", "frames") == [(0, 3), (1, 2), (2, 2)]


def test_layout_commit_and_boundaries(spark):
    c = spark.createDataFrame([(1, "main", 0, 1, 38), (1, "main", 1, 2, 26)], "doc_id long, stream string, n int, block_idx int, frames long")
    laid = timing.stream_layout(timing.silence_between(c))
    assert rows(laid, "n", "silence", "start", "offset") == [(0, 0, 0, 0), (1, 16, 54, 38)]
    real = spark.createDataFrame([(1, "main", 0, 50)], "doc_id long, stream string, n int, real long")
    assert rows(timing.commit_lengths(timing.silence_between(c), real), "n", "start", "exact") == [(0, 0, False), (1, 66, False)]
    b = spark.createDataFrame([(1, 0, 5), (1, 1, 11), (1, 2, 18)], "key long, n int, at int")
    assert rows(timing.frames_from_boundaries(b, spark.createDataFrame([(1, 30)], "key long, total int")), "n", "frames") == [(0, 5), (1, 6), (2, 7), (3, 12)]
    energy = spark.createDataFrame([(1, f, 0.0 if f == 10 else 0.5) for f in range(20)], "key long, frame int, energy double")
    assert rows(timing.snap_boundaries(spark.createDataFrame([(1, 0, 3), (1, 1, 12)], "key long, n int, at int"), energy), "n", "at") == [(0, 3), (1, 10)]
    frames = spark.createDataFrame([(1, i, 2) for i in range(10)], "key long, pos int, frames long")
    edges = spark.createDataFrame([(1, 0, 10, 15)], "key long, n int, before int, after int")
    fine = timing.refine_words(frames, edges, spark.createDataFrame([(1, 22)], "key long, total long"))
    assert rows(fine, "pos", "frames") == [(i, 3) for i in range(5)] + [(5, 1), (6, 1), (7, 1), (8, 1), (9, 3)]


def test_number_words_and_others(spark):
    told = {"0": "zero", "17": "seventeen", "342": "three hundred forty two", "70015": "seventy thousand fifteen", "1234567": "one million two hundred thirty four thousand five hundred sixty seven", "1993": "nineteen ninety three", "1900": "nineteen hundred", "1905": "nineteen oh five", "x1": None}
    df = spark.createDataFrame([(k,) for k in told], "t string")
    assert {r[0]: r[1] for r in df.select("t", normalize.number_words(F.col("t"))).collect()} == told
    s = spark.createDataFrame([(1, "Well, yes... (no) ”end” x")], "id int, text string")
    parts = normalize.split_punctuation(s, ["id"]).orderBy("seg_idx").collect()
    assert "".join(p["text"] for p in parts) == "Well, yes... (no) ”end” x" and [p["is_punct"] for p in parts[:4]] == [False, True, False, True]
    titles = spark.createDataFrame([("Dr. Who met Mrs. Dr. x etc. and etc. Then",)], "t string").select(normalize.expand_titles(F.col("t"))).first()[0]
    assert titles == "Doctor Who met Mrs Dr. x etc. and etc. Then"
    said = spark.createDataFrame([("kəkˈoːɹoʊ",), ("nˈaɪnti",), ("xrʲ",), ("dˈɔɡ z,",)], "p string").select(normalize.phoneme_postprocess(F.col("p"))).collect()
    assert [r[0] for r in said] == ["kˈoʊkəɹoʊ", "nˈaɪndi", "kɹj", "dˈɔɡz,"]
    clean = spark.createDataFrame([("of­ﬁce­",), ("caf´e",), ("na¨ıve",), ("¨uber",), ("a ¨",)], "w string").select(words.clean_word(F.col("w"))).collect()
    assert [r[0] for r in clean] == ["office-", "café", "naïve", "über", "a ¨"]


def lines_of_text(rng, n):
    """Lines of one column from the top, some indented, short or large."""
    out, y = [], 700.0
    for i in range(n):
        y -= rng.choice([12, 12, 12, 12, 20])
        x0 = 72.0 + rng.choice([0, 0, 0, 12])
        out.append((1, 0, 0, i, x0, rng.choice([300.0, 300.0, 300.0, 180.0]), y, rng.choice([10.0, 10.0, 10.0, 10.0, 14.0]), 5, rng.choice(["a b c d e", "a b c d e."])))
    return out


def plain_breaks(ls):
    from statistics import median

    n = len(ls)
    x0, x1, base, h = [r[4] for r in ls], [r[5] for r in ls], [r[6] for r in ls], [r[7] for r in ls]
    em = median(h)
    steps = [a - b for a, b in zip(base, base[1:]) if em * 0.5 < a - b < em * 3]
    pitch = median(steps) if steps else em * 1.2
    low = sorted(x0)[int((n - 1) * 0.2)]
    on = [i for i in range(n) if abs(x0[i] - low) <= em * 0.6]
    slope, cut = 0.0, low
    if len(on) >= 4:
        my, mx = sum(base[i] for i in on) / len(on), sum(x0[i] for i in on) / len(on)
        den = sum((base[i] - my) ** 2 for i in on)
        slope = max(-0.025, min(0.025, sum((base[i] - my) * (x0[i] - mx) for i in on) / den)) if den else 0.0
        cut = mx - slope * my
    right = sorted(x1[i] - slope * base[i] for i in range(n))[int((n - 1) * 0.8)]
    width = max(em, right - cut)
    inset = [x0[i] - cut - slope * base[i] for i in range(n)]
    ind = [x > em * 0.8 for x in inset]
    short = [x1[i] < right + slope * base[i] - max(em * 1.5, width * 0.06) for i in range(n)]
    ends = [r[9].endswith(".") for r in ls]
    ragged = n >= 6 and sum(short[i] and not ends[i] for i in range(n - 1)) / (n - 1) > 0.25
    out, run = [True], 1 if ind[0] else 0
    for i in range(1, n):
        gap, could, ratio = base[i - 1] - base[i], ends[i - 1] or short[i - 1], h[i] / h[i - 1]
        s = (
            gap > pitch * max(1, min(h[i], h[i - 1]) / em) * 1.25 or gap <= em * 0.3 or (ind[i] and not ind[i - 1] and could) or (not ind[i] and ind[i - 1] and run >= 2 and could)
            or (ind[i] and ind[i - 1] and abs(inset[i] - inset[i - 1]) > em * 0.8 and could) or (not ragged and short[i - 1] and ends[i - 1] and not ind[i] and not ind[i - 1]) or ratio > 1.3 or ratio < 0.77 or ratio > 1.15 or ratio < 0.87
        )
        out.append(s)
        run = (run + 1 if ind[i - 1] and not s else 1) if ind[i] else 0
    return out


def test_paragraph_breaks(spark):
    rng = random.Random(5)
    every, expected = [], []
    for page in range(12):
        ls = [(1, page, *r[2:]) for r in lines_of_text(rng, rng.randrange(1, 30))]
        every += ls
        expected += [(page, i, b) for i, b in enumerate(plain_breaks(ls))]
    df = spark.createDataFrame(every, "doc_id long, page_index int, col int, line int, x0 double, x1 double, baseline double, height double, n_runs long, text string")
    out = paragraphs.paragraph_breaks(df)
    assert rows(out, "page_index", "line", "starts") == sorted(expected)
    assert sum(r["n_lines"] for r in paragraphs.paragraphs(out).collect()) == len(every)


def test_merge_across_pages(spark):
    rng = random.Random(8)
    data, expected = [], []
    for d in range(30):
        blocks = []
        for i in range(25):
            blocks.append((d, i, rng.choice(["body"] * 6 + ["heading", "runningHead"]), i // 4, i % 4 // 2, rng.choice(["Start here.", "goes on and", "More of it", "end it."]), 20 if i % 3 else 3, bool(rng.random() < (0.8 if d % 2 else 0.2)), rng.random() < 0.5, rng.choice([240.0, 240.0, 240.0, 500.0])))
        data += blocks
        follow = [(a, b) for a, b in zip(blocks, blocks[1:]) if a[2] == b[2] == "body" and a[3:5] == b[3:5]]
        indents = len(follow) >= 3 and sum(b[7] for _, b in follow) >= 0.5 * len(follow)
        head = None
        for b in blocks:
            low, joined = b[5][0].islower(), False
            if head and head["role"] == b[2] == "body" and (b[3] > head["page"] or (b[3] == head["page"] and b[4] > head["col"])) and abs(head["width"] - b[9]) <= max(head["width"], b[9]) * 0.25:
                flush, like = indents and not b[7], head["lines"] <= 2 and head["n"] <= 14
                joined = (flush and head["full"]) if head["ends"] else (low or (flush and not like))
            ends = b[5].endswith(".")
            if joined:
                head |= {"ends": ends, "full": b[8], "n": head["n"] + b[6], "lines": head["lines"] + 1}
                expected.append((d, b[1], head["id"]))
            else:
                if b[2] in ("body", "heading"):
                    head = {"id": b[1], "role": b[2], "page": b[3], "col": b[4], "width": b[9], "ends": ends, "full": b[8], "n": b[6], "lines": 1}
                expected.append((d, b[1], b[1]))
    df = spark.createDataFrame(data, "doc_id long, block_idx int, role string, page_index int, col int, text string, n_tokens int, starts_indented boolean, ends_full boolean, col_width double")
    assert rows(paragraphs.merge_across_pages(df), "doc_id", "block_idx", "survivor") == sorted(expected)
    assert sum(a != b for _, a, b in expected) > 20


def test_regions_of_a_page(spark):
    seg = [(1, 0, 0, 72.0, 540.0, 740.0, 750.0, 742.0, 10.0)]
    n = 1
    for k in range(8):
        for x in (72.0, 320.0):
            seg.append((1, 0, n, x, x + 220, 700.0 - 14 * k, 710.0 - 14 * k, 702.0 - 14 * k, 10.0))
            n += 1
    df = spark.createDataFrame(seg, "doc_id long, page_index int, segment_id int, x0 double, x1 double, y0 double, y1 double, baseline double, height double")
    order = [r["segment_id"] for r in layout.reading_regions(df).orderBy("region", F.desc("baseline")).collect()]
    assert order == [0, *range(1, 17, 2), *range(2, 17, 2)]
    assert layout.find_gutter(df).count() == 1


def test_strikes_notes_and_eviction(spark):
    runs = spark.createDataFrame([(1, 0, 0, "a", 0.0, 0.0, 10.0, 10.0), (1, 0, 1, "a", 4.0, 0.0, 10.0, 10.0), (1, 0, 2, "a", 8.0, 0.0, 10.0, 10.0), (1, 0, 3, "b", 0.0, 0.0, 10.0, 10.0)], "doc_id long, page_index int, seq int, text string, x double, y double, width double, height double")
    # the third lies over the second alone, which is gone
    assert rows(words.dedupe_overstrike(runs), "seq") == [(0,), (2,), (3,)]
    lib = spark.createDataFrame([(k, k, 10) for k in range(6)], "hash long, opened long, bytes long")
    assert rows(library.lru_evict(lib, 25, 1), "hash") == [(0,), (2,), (3,), (4,)]
    notes = spark.createDataFrame([(1, 0, 0, "1. First"), (1, 0, 1, "goes on"), (1, 0, 2, "* Second")], "doc_id long, page_index int, seq int, text string")
    assert rows(furniture.note_bodies(notes), "label", "text") == [("*", "Second"), ("1", "First goes on")]
    docs = spark.createDataFrame([(1, 3), (2, 80), (3, 0)], "doc_id long, page_count long")
    assert rows(quality.sample_pages(docs), "doc_id", "page") == [(1, 0), (1, 1), (1, 2)] + [(2, 5 + 10 * i) for i in range(8)]


def test_markers_are_spliced(spark):
    t = spark.createDataFrame([(1, 0, 0, "ab"), (1, 0, 1, "c"), (1, 1, 0, "d")], "doc_id long, block_idx int, token_idx int, token string")
    m = spark.createDataFrame([(1, 0, 0, "12")], "doc_id long, block_idx int, after_token int, label string")
    assert rows(reflow.marker_splice(t, m), "loc", "text") == [(0, "ab"), (2, "12"), (5, "c"), (8, "d")]
    assert reflow.reflow_text(t).first()["text"] == "ab c\n\nd"
