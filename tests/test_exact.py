"""Folds over a page or a document against plain loops, on skewed, overlapping and mixed input, and long texts."""

import random
import re
import statistics
import time
import unicodedata

from pyspark.sql import functions as F

from quire.operators import layout, paragraphs, reflow, timeline, words


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def letters(s):
    return any(unicodedata.category(c)[0] == "L" for c in s)


def plain_clean(t):
    for short, long in words.LIGATURES.items():
        t = t.replace(short, long)
    left, out = list(re.sub("­$", "-", re.sub("­(?=.)", "", t))), []
    join = lambda letter, mark: unicodedata.normalize("NFC", words.DOTLESS.get(letter, letter) + words.ACCENTS[mark])
    while left:
        c = left.pop(0)
        if c in words.ACCENTS and left and letters(left[0]):
            out.append(join(left.pop(0), c))
        elif c in words.ACCENTS and out and letters(out[-1]):
            out[-1] = join(out[-1], c)
        else:
            out.append(c)
    return "".join(out)


def test_clean_word_in_all_scripts(spark):
    rng = random.Random(1)
    pool = [*"aeiouyAEOcsznbxııȷ1. -", *"éêüạâơư", *"αωιυΑάϋ", *"ийгкИ", *"क़שׁ日한ﬁﬃ­άΩ"]
    told = {"´ω": "ώ", "ω´": "ώ", "˘и": "й", "¨ι´": "ΐ", "ˆạ": "ậ", "ˆa´": "ấ", "´ı": "í", "e¸´": "ȩ́", "ﬁn­": "fin-", "x´": "x́", "´": "´", "1´": "1´", "a´b": "ab́"}
    texts = [*told, *("".join(rng.choice(pool) if rng.random() < 0.55 else rng.choice([*words.ACCENTS]) for _ in range(rng.randrange(9))) for _ in range(1500)), "", "´" * 4000, "a" * 200_000 + "´"]
    got = dict(spark.createDataFrame([(t,) for t in texts], "t string").select("t", words.clean_word(F.col("t"))).collect())
    assert {t: got[t] for t in told} == told
    assert got == {t: plain_clean(t) for t in texts}
    assert spark.createDataFrame([(None,)], "t string").select(words.clean_word(F.col("t"))).first()[0] is None


def plain_segments(runs):
    open_, out = [], {}
    for seq, x, w, base, h in sorted(runs, key=lambda r: (r[1], -r[3], r[0])):
        fits = []
        for i, s in enumerate(open_):
            em, gap, rise = max(h, s["h"]), x - s["right"], abs(base - s["base"])
            line, script = rise <= 0.35 * min(h, s["h"]), h < 0.8 * s["h"] and 0.1 * s["h"] < rise <= 0.75 * s["h"]
            if -0.5 * em <= gap <= em and (line or script):
                fits.append((rise + (s["h"] if script else 0) + 0.01 * max(0, gap), i, line))
        if not fits:
            open_.append({})
        _, i, line = min(fits) if fits else (0, len(open_) - 1, True)
        open_[i]["right"] = x + w
        if line:
            open_[i] |= {"base": base, "h": h}
        out[seq] = i
    return out


def test_segments_of_skewed_and_overlapping_lines(spark):
    rng, data, want = random.Random(3), [], {}
    for page in range(30):
        slope, runs = rng.uniform(-0.03, 0.03), []
        for line in range(rng.randrange(1, 12)):
            base, x = 700 - line * rng.choice([6.0, 9.0, 12.0]), float(rng.choice([50, 60, 300]))
            for _ in range(rng.randrange(1, 12)):
                w, h = rng.uniform(3, 40), rng.choice([10, 10, 10, 6, 8, 14])
                runs.append((len(runs), round(x, 3), round(w, 3), round(base + slope * x + rng.uniform(-1, 1) + (3.5 if h == 6 else 0), 3), float(h)))
                x += w + rng.choice([2, 3, 4, -3, 9, 14])
        data += [(1, page, *r) for r in runs]
        want |= {(page, seq): i for seq, i in plain_segments(runs).items()}
    table = spark.createDataFrame(data, "doc_id long, page_index int, seq int, x double, width double, baseline double, glyph_height double").repartition(3)
    assert {(r["page_index"], r["seq"]): r["segment_id"] for r in layout.build_segments(table).collect()} == want


def plain_marks(tokens):
    kinds = {"closing": r"[,.;:!?)\]}”’»…%]+", "opening": r"[(\[{“‘«]+", "either": "[\"']+"}
    left, out = [{"text": t, "boxes": [(x, w, line)]} for t, x, w, line in tokens], []

    def gap(a, b):
        (x, w, line), (y, _, other) = a["boxes"][-1], b["boxes"][0]
        return abs(y - (x + w)) if line == other else float("inf")

    while left:
        t = left.pop(0)
        kind = next((k for k, p in kinds.items() if re.fullmatch(p, t["text"])), None)
        ways = [w for w, there in (("back", out), ("forward", left)) if there]
        if kind == "opening":
            ways = ways[::-1]
        if kind == "either" and len(ways) == 2 and gap(out[-1], t) > gap(t, left[0]):
            ways = ["forward"]
        if kind is None or not ways:
            out.append(t)
        elif ways[0] == "back":
            out[-1]["text"] += t["text"]
            out[-1]["boxes"] += t["boxes"]
        else:
            left[0] = {"text": t["text"] + left[0]["text"], "boxes": t["boxes"] + left[0]["boxes"]}
    return [(i, t["text"], len(t["boxes"])) for i, t in enumerate(out)]


def test_chains_of_mixed_marks(spark):
    rng, data, want = random.Random(4), [], []
    for doc in range(300):
        tokens, x, line = [], 0.0, 0
        for k in range(rng.randrange(1, 25)):
            w = rng.choice([1.0, 2.0, 5.0])
            tokens.append((rng.choice(['"', "'", "(", "“", ",", ".", "»", "w", "word", "a.", '"(']) if rng.random() < 0.8 else f"x{k}", x, w, line))
            x += w + rng.choice([0.0, 1.0, 2.0, 3.0])
            if rng.random() < 0.15:
                x, line = 0.0, line + 1
        data += [(doc, i, *t) for i, t in enumerate(tokens)]
        want += [(doc, *g) for g in plain_marks(tokens)]
    table = spark.createDataFrame(data, "doc_id long, token_idx int, token string, x double, width double, line_key int").repartition(3)
    assert rows(paragraphs.attach_punctuation(table), "doc_id", "group", "token", "n_boxes") == sorted(want)


def plain_gutter(segments):
    if len(segments) < 6:
        return None
    left, right, em = min(s["x0"] for s in segments), max(s["x1"] for s in segments), statistics.median(s["height"] for s in segments)
    extent = right - left
    grid = range(int((left + extent / 4) // 1), -int(-(left + extent * 0.75) // 1) + 1)
    lines = [s for s in segments if s["x1"] - s["x0"] >= 3 * em]
    crossed = [sum(s["x0"] <= at <= s["x1"] for s in lines) for at in grid]
    if extent <= 0 or min(crossed) > 0.35 * len(lines):
        return None
    stretches = [m.span() for m in re.finditer("x+", "".join("x" if c == min(crossed) else "." for c in crossed))]
    start, stop = max(stretches, key=lambda s: s[1] - s[0])
    x, strip = grid[start] + (stop - start) / 2, stop - start
    sides = [s for s in lines if s["x1"] <= x], [s for s in lines if s["x0"] >= x]
    if strip < max(3, 0.4 * em) or min(map(len, sides)) < 3 or min(statistics.median(s["x1"] - s["x0"] for s in side) for side in sides) < 0.22 * extent:
        return None
    spans = [(min(s["y0"] for s in side), max(s["y1"] for s in side)) for side in sides]
    beside = min(s[1] for s in spans) - max(s[0] for s in spans)
    return (x, strip) if beside >= 0.5 * min(b - a for a, b in spans) else None


def plain_regions(segments, path="", depth=0):
    gutter = plain_gutter(segments) if depth < 3 else None
    if not gutter:
        return {s["n"]: path for s in segments}
    x, slack = gutter[0], max(4, gutter[1] / 4)
    side = {s["n"]: 0 if x - s["x0"] > slack and s["x1"] - x > slack else 1 if s["x1"] - x <= x - s["x0"] else 2 for s in segments}
    grew = True
    while grew:
        grew = False
        for a in segments:
            for s in segments:
                under = 0 < a["baseline"] - s["baseline"] <= 1.6 * a["height"]
                if side[a["n"]] == 0 and side[s["n"]] and under and abs(s["x0"] - a["x0"]) <= 2 and abs(s["height"] - a["height"]) <= 0.1 * a["height"]:
                    side[s["n"]], grew = 0, True
    mid = lambda s: (s["y0"] + s["y1"]) / 2
    rest, blocks = [s for s in segments if side[s["n"]]], []
    for s in sorted((s for s in segments if side[s["n"]] == 0), key=lambda s: (-s["y1"], -s["baseline"], s["x0"])):
        floor = min((b["y0"] for b in blocks[-1]), default=None) if blocks else None
        if blocks and not any(s["y1"] <= mid(c) < floor for c in rest):
            blocks[-1].append(s)
        else:
            blocks.append([s])
    out, upper = {}, float("inf")
    for k, block in enumerate([*blocks, None]):
        lower = mid(block[0]) if block else float("-inf")
        for which in (1, 2):
            out |= plain_regions([s for s in rest if side[s["n"]] == which and lower <= mid(s) < upper], f"{path}{k:05d}.{which}/", depth + 1)
        if block:
            out |= {s["n"]: f"{path}{k:05d}.3/" for s in block}
            upper = mid(block[-1])
    return {s["n"]: out.get(s["n"]) for s in segments}


def test_regions_of_pages_with_spanning_blocks(spark):
    rng, data, want, paths = random.Random(6), [], {}, set()
    for page in range(14):
        segments, y = [], 760.0
        columns = rng.choice([[(50, 280), (310, 540)], [(50, 200), (220, 370), (390, 540)], [(50, 540)], [(50, 160), (172, 280), (310, 420), (432, 540)]])

        def put(x0, x1, base, h):
            segments.append({"n": len(segments), "x0": float(x0), "x1": float(x1), "y0": base - 0.2 * h, "y1": base + 0.8 * h, "baseline": base, "height": float(h)})

        for _ in range(rng.randrange(1, 4)):
            if rng.random() < 0.7:  # a title of a few lines, whose last is short, or a full-width paragraph
                h = rng.choice([10, 14])
                for last in [False] * rng.randrange(1, 3) + [True] * rng.randrange(2):
                    put(50, 150 if last else 540, y, h)
                    y -= rng.choice([12.0, 15.0])
            for _ in range(rng.randrange(3, 14)):
                for x0, x1 in columns:
                    if rng.random() < 0.93:
                        put(x0 + rng.choice([0, 0, 12]), x1 - rng.choice([0, 0, 0, 40]), y + rng.uniform(-0.5, 0.5), 10)
                y -= 12.0
        data += [(1, page, *s.values()) for s in segments]
        told = plain_regions(segments)
        want |= {(page, n): path for n, path in told.items()}
        paths |= set(told.values())
    assert any(p and p.endswith(".3/") for p in paths) and any(p and p.count("/") == 2 for p in paths)
    table = spark.createDataFrame(data, "doc_id long, page_index int, n int, x0 double, x1 double, y0 double, y1 double, baseline double, height double").repartition(3)
    assert {(r["page_index"], r["n"]): r["region"] for r in layout.reading_regions(table).collect()} == want


def test_reflow_check_finds_what_is_moved(spark):
    t = spark.createDataFrame([(1, b, i, w) for b, line in enumerate(["ab 😀 cd", "é x" + "y" * 3000, "end"]) for i, w in enumerate(line.split())], "doc_id long, block_idx int, token_idx int, token string")
    offsets, text = reflow.reflow_offsets(t), reflow.reflow_text(t)
    assert reflow.reflow_check(offsets, text).count() == 0
    # the 3001-letter word loses its last letter, so all after it stand one place further on
    moved = text.withColumn("text", F.regexp_replace("text", "y\n", "\n"))
    assert rows(reflow.reflow_check(offsets, moved), "block_idx", "token_idx") == [(1, 1), (2, 0)]
    assert reflow.reflow_check(offsets, text.withColumn("text", F.lit(""))).count() == 6
    assert reflow.reflow_check(offsets, text.where("doc_id = 2")).count() == 0


def test_reflow_check_takes_time_in_proportion(spark):
    n = 200_000
    t = spark.range(n).select(F.lit(1).alias("doc_id"), (F.col("id") / 50).cast("int").alias("block_idx"), (F.col("id") % 50).cast("int").alias("token_idx"), F.concat(F.lit("wörd"), "id").alias("token"))
    began = time.time()
    assert reflow.reflow_check(reflow.reflow_offsets(t), reflow.reflow_text(t)).count() == 0
    assert time.time() - began < 90  # 11.6 s for a tenth of it where each token walks the text


def test_prefetch_runs(spark):
    rng = random.Random(2)
    chunks, delivered, at = [], [], 0
    for i in range(60):
        n = rng.randrange(50, 900)
        chunks.append((1, i, at, at + n))
        at += n
        if rng.random() < 0.5:
            delivered.append((1, i))
    positions = [(k, 1, rng.randrange(-2000, at + 3000)) for k in range(40)] + [(99, 2, 5)]
    available = [(1, i) for i in range(0, 60, 2)]
    table = lambda data, schema: spark.createDataFrame(data, schema)
    got = rows(
        timeline.prefetch_window(
            table(positions, "event_id int, doc_id long, t_frame int"), table(chunks, "doc_id long, chunk_idx int, offset int, end int"), table(available, "doc_id long, chunk_idx int"),
            table(delivered, "doc_id long, chunk_idx int"),
        ), "event_id", "action", "first_chunk", "last_chunk", "n_chunks",
    )
    want = []
    for event, doc, t in positions:
        mine = [(i, o, e) for d, i, o, e in chunks if d == doc]
        meets = [i for i, o, e in mine if o < t + 6000 and e > t - 800]
        want += [(event, "load", i, i, 1) for i in meets if (doc, i) in available and (doc, i) not in delivered]
        for out in ([i for i, _, e in mine if e <= t - 800], [i for i, o, _ in mine if o >= t + 6000]):
            held = [i for i in out if (doc, i) in delivered]
            want += [(event, "release", held[0], held[-1], len(held))] if held else []
    assert got == sorted(want)
