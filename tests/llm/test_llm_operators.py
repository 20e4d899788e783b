"""Each operator on a small table with nulls, empty and long texts, ties, repeated rows and clashing columns, held
against a plain computation of the same."""

import hashlib
import math
import random
import re
import struct
import time
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from quire.llm import decontam, line_dedup, lm, mixing, near_dup, quality, secrets, sharding, suffix_dedup, tiff

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, row long, place string, number int, words string"


def corpus():
    rng = random.Random(4)
    words = ["w%d" % i for i in range(400)] + ["Été", "naïve", "STOP", "a,b", "x.y"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage = text(120), text(40)
    rows = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "one two three four"), (6, "ONE two\tthree  four"), (7, text(9000)), (None, base), (None, text(30))]
    rows += [(10 + i, text(rng.randrange(5, 200))) for i in range(40)]
    for i in range(30):
        cut = base.split()
        for _ in range(rng.choice([0, 1, 1, 2, 3, 8])):
            cut[rng.randrange(len(cut))] = rng.choice(words)
        rows.append((100 + i, " ".join(cut)))
    rows += [(200 + i, f"{text(20)} {passage} {text(20)}") for i in range(8)]
    rows += [(300, "ab" * 400), (301, "ab" * 300), (302, "zz" + "ab" * 60)]
    rows += [(50, base), (50, base), (51, text(50)), (51, passage)]
    rng.shuffle(rows)
    return rows


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i == 11 else "en", None if i == 12 else f"s{(i or 0) % 5}", None, 7, 0.5, 3, "p", 1, "w") for i, t in ROWS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def got(df, *columns):
    return sorted(map(repr, (tuple(r) for r in df.select(*columns).collect())))


def want(rows):
    return sorted(map(repr, rows))


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_near_duplicates():
    sets = {}
    for i, t in ROWS:
        s = frozenset(shingles(t))
        if s:
            sets.setdefault(s, []).append(i)
    nodes = [s for s, ids in sets.items() if any(i is not None for i in ids)]
    up = {s: s for s in sets}

    def find(s):
        while up[s] != s:
            s = up[s]
        return s

    for a in nodes:
        for b in nodes:
            if 100 * len(a & b) >= 85 * len(a | b):
                up[find(a)] = find(b)
    least = defaultdict(list)
    for s, ids in sets.items():
        least[find(s)] += [i for i in ids if i is not None]
    expected = []
    for i, t in ROWS:
        s = frozenset(shingles(t))
        c = min(least[find(s)], default=None) if s else i
        expected.append((i, len(s), c, i is not None and i == c))
    return expected


def test_near_duplicates(spark, docs):
    expected = plain_near_duplicates()
    out = near_dup.near_duplicates(docs, percent=85)
    assert got(out, "doc_id", "n_shingles", "component_id", "kept") == want(expected)
    assert len({r[2] for r in expected}) <= len(expected) - 20


@pytest.mark.parametrize("n", range(6))
def test_shingles_of_one_short_text(n):
    alone = near_dup.Shingles()([" ".join("abcde"[:n])])
    among = near_dup.Shingles()([" ".join("abcde"[:n]), "one two three four five six seven"])
    assert len(alone) == 1 and len(alone[0]) == min(n, 1) and alone[0].tolist() == among[0].tolist()


def test_near_duplicates_in_blocks(spark, docs, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 3)
    assert got(near_dup.near_duplicates(docs, percent=85), "doc_id", "component_id") == want([(i, c) for i, _, c, _ in plain_near_duplicates()])


def test_remove_repeats(spark, docs):
    starts = defaultdict(set)
    for i, t in ROWS:
        b = (t or "").encode()
        if i is not None:
            for k in range(len(b) - 49):
                starts[b[k : k + 50]].add(i)
    least = {w: min(ids) for w, ids in starts.items()}
    expected = []
    for i, t in ROWS:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if i is not None and least[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        expected.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    assert got(suffix_dedup.remove_repeats(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want(expected)


def test_suffix_array_against_sorting():
    import numpy as np

    rng = random.Random(1)
    for letters in (b"a", b"ab", b"abc", bytes(range(256))):
        for n in (1, 2, 7, 100, 700):
            raw = bytes(rng.choice(letters) for _ in range(n))
            data = np.frombuffer(raw, np.uint8)
            order = suffix_dedup.suffix_array(data, 1000)
            assert order.tolist() == sorted(range(n), key=lambda i: raw[i:]) or letters == bytes(range(256)) and 0 in raw
            shared = suffix_dedup.common_prefixes(data, order, 50)
            for x, y, c in zip(order, order[1:], shared[1:]):
                k = 0
                while k < 50 and max(x, y) + k < n and raw[x + k] == raw[y + k]:
                    k += 1
                assert c == k


def test_contamination(spark, docs):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    texts = [t for _, t in ROWS if t and len(t.split()) > 30]
    items = [(1, " ".join(texts[0].split()[3:18])), (2, "Été W1"), (3, None), (4, "..."), (10, texts[5][:300].upper()), (11, "nothing of it here at all, is there any word"), (1, texts[7]), (None, texts[9])]
    windows = defaultdict(set)
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - 9)) if w else ():
            windows[tuple(w[k : k + 10])].add(None if i is None else str(i))
    expected = []
    for i, t in ROWS:
        w, hit, found = split(t), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    found |= windows[tuple(w[k : k + n])]
                    hit |= set(range(k, k + n))
        names = sorted(found - {None})
        expected.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit(1))
    assert got(decontam.contamination(docs, bench), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == want(expected)


def test_proximity(spark):
    rng = random.Random(2)
    texts = [[rng.choice("abcdefgh") for _ in range(rng.randrange(0, 25))] for _ in range(40)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row long, words array<string>")
    phrases = [(0, ["a", "b"]), (1, ["c", "d", "e"]), (2, ["f", "f"]), (3, ["z", "a"])]
    out = decontam.proximity_matches(rows, spark.createDataFrame(phrases, "phrase long, terms array<string>"), slop=1)
    found = {(r["row"], r["phrase"]) for r in out.collect()}
    expected = set()
    for i, t in enumerate(texts):
        for p, terms in phrases:
            if any(set(terms) <= set(t[k : k + n]) for k in range(len(t)) for n in range(1, len(terms) + 2)):
                expected.add((i, p))
    assert found == expected
    for r in out.collect():
        assert set(phrases[r["phrase"]][1]) <= set(texts[r["row"]][r["place"] : r["place"] + r["span"]])


def secret_rows():
    key = "AKIA" + "Q7Z2" * 4
    return [
        (1, f'Password = "hunter22222" and token:abc token: secret: abcdefghijk {key} AKIA123'), (2, None), (3, ""), (4, "é" * 5 + " API_KEY='ab.cd/ef+gh==' " + "deadbeef" * 5),
        (5, "x9Fq2Lw8Zr4Tk7Vb1Nm6Qs3 plain wordsthatarelongbutplainandplain"), (6, "12345678901234567890123456789"), (7, "id 123e4567-e89b-12d3-a456-426614174000 token==abcdefgh"),
        (8, "0123456789abcdef" * 2 + "g" + "a1" * 30), (9, "secret=secret=abcdefghij, passwd : q w e r"), (10, "token:abcdefgh " * 50), (10, "token:abcdefgh " * 50), (None, "secret: ſecretſ Kelvin toKen=abcdefghij"),
    ]


ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def hot_windows(run):
    """Starts of windows of 20 characters that count, each judged by itself."""
    shut = [any(m.start() <= i < m.end() for m in re.finditer("|".join(secrets.ALLOWED), run)) for i in range(len(run))] if len(run) < 3000 else [False] * len(run)
    for k in range(len(run) - 19):
        w = run[k : k + 20]
        if any(shut[k : k + 20]) or not re.search("[0-9]", w) or not re.search("[A-Za-z]", w):
            continue
        bits = secrets.HEX_BITS if re.fullmatch("[0-9a-f]+|[0-9A-F]+", w) else secrets.MIXED_BITS
        if round(20 * -sum(c / 20 * math.log2(c / 20) for c in Counter(w).values()), 9) >= bits * 20:
            yield k


def plain_scan(i, t):
    t = t or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[1]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    count = Counter(k for _, k, _ in spans)
    text = lambda some: ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(some))
    base = text(spans)
    for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", t):
        hot = list(hot_windows(m[0]))
        if hot:
            spans.append((m.start() + hot[0], 3, m.start() + hot[-1] + 20))
    return i, count[0], count[1], count[2], hashlib.sha256(base.encode()).hexdigest(), text(spans)


def test_secret_scan(spark):
    expected = [plain_scan(i, t) for i, t in secret_rows()]
    assert any("entropy" in e[5] for e in expected)
    out = secrets.scan(spark.createDataFrame(secret_rows(), "doc_id long, text string").withColumn("kind", F.lit(1)))
    assert got(out, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans") == want(expected)


def test_secret_windows_are_judged_by_their_own_class(spark):
    rng = random.Random(8)
    hexes = ["sig=" + "".join(rng.choice("0123456789ABCDEF") for _ in range(32)) for _ in range(20)]
    rows = [*enumerate(hexes), (30, "example/" + "Zq8Lw2Rk7Vb1Nm6Qs3Tx9Yc4"), (31, "Zq8Lw2Rk7Vb1Nm6Qs3Tx9Yc4/example/Gh5Jd0Pf"), (32, "usr/lib/python3/dist/packages/one"), (33, "/usr/share/doc/12/abcdefghijklmnop")]
    out = {r["doc_id"]: r["spans"] for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum("entropy" in out[i] for i in range(20)) >= 19
    assert out[30] == "entropy:7:32" and out[31] == "entropy:0:25" and not out[32]
    assert all(out[i] == plain_scan(i, t)[5] for i, t in rows)


def test_secret_scan_of_very_long_texts(spark):
    rng = random.Random(5)
    n = 1_000_000
    rows = [(1, "a/" * (n // 2) + "1"), (2, "z" * n), (3, "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=n))), (4, "0123456789abcdef" * (n // 16)),
            (5, "token" * 1000 + " " * 100_000), (6, "example" * 20_000 + "Zq8Lw2Rk7Vb1Nm6Qs3Tx9Yc4"), (7, "token:abcdefgh " * 20_000), (8, "xxxx1" * 40_000)]
    began = time.time()
    out = {r["doc_id"]: r["spans"] for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert time.time() - began < 120
    assert out[1] == "" and out[2] == "" and out[5] == "" and out[8] == "" and out[6] == "entropy:140000:140024"
    assert out[4] == f"hex:0:{n},entropy:0:{n}"
    hot = list(hot_windows(rows[2][1]))
    assert out[3].endswith(f"entropy:{hot[0]}:{hot[-1] + 20}") and out[7].count("assign") == 20_000


def draw(key, name, weight):
    seed = 42 if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
    bits = xxhash.xxh64_intdigest(name.encode(), seed) >> 12
    return math.log((bits + 0.5) / 2.0**52) / weight


def descend(key, node):
    while node.children:
        live = [c for c in node.children if c.weight > 0]
        node = live[0] if len(live) == 1 else max(live, key=lambda c: draw(key, c.name, c.weight))
    return node.shard


def test_shards(spark, docs):
    rows = sharding.shard_rows(docs, 40).collect()
    slots = defaultdict(list)
    for r in rows:
        b = (r["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(b) + 16, zlib.crc32(b), "key")
        assert r["shard"] == descend(r["doc_id"], sharding.plan(40)) and r["grown_shard"] == descend(r["doc_id"], sharding.plan(41, 40))
        assert r["grown_shard"] in (r["shard"], 40)
        slots[r["shard"]].append(r["slot"])
    assert len(rows) == len(ROWS) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_slots_have_no_gap_however_many_parts(spark, docs, monkeypatch):
    monkeypatch.setattr(sharding, "PART_ROWS", 1)
    monkeypatch.setattr(sharding, "SLOT_PARTS", 2)
    held = defaultdict(list)
    for r in sharding.shard_rows(docs, 3).collect():
        held[r["shard"]].append(r["slot"])
    assert len(held) == 3 and all(sorted(x) == list(range(len(x))) for x in held.values())


def test_weights_move_rows_of_their_subtree_only(spark):
    ids = spark.range(3000)
    tree = sharding.plan(16)
    heavier = sharding.reweighted(tree, {3: 2.0})
    moved = [(r[0], r[1]) for r in ids.select(sharding.shard_of(F.col("id"), tree), sharding.shard_of(F.col("id"), heavier)).collect() if r[0] != r[1]]
    assert moved and all(b < 8 for _, b in moved) and sum(b == 3 for _, b in moved) > len(moved) / 4


def test_mix(spark, docs):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    source = {(i, t): None if i == 12 else f"s{(i or 0) % 5}" for i, t in ROWS}
    total = Counter()
    for i, t in ROWS:
        total[source[i, t]] += size(t)
    names = sorted(total, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    goal, open_ = {}, set(names)
    while True:
        left = sum(total.values()) - sum(goal.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * total[s]}
        if not full:
            break
        goal |= {s: 3.0 * total[s] for s in full}
        open_ -= full
    goal |= share
    out = mixing.mix(docs).collect()
    taken = Counter()
    for r in out:
        s = source[r["doc_id"], r["text"]]
        assert r["size"] == size(r["text"]) and r["source_size"] == total[s] and abs(r["target"] - goal[s]) < 1e-6 and 0 <= r["taken"] <= 3 * r["size"]
        assert (r["position"] is None) == (r["taken"] == 0)
        taken[s] += r["taken"]
    assert len(out) == len(ROWS) and all(abs(taken[s] - goal[s]) <= 1 for s in names)
    positions = [r["position"] for r in mixing.in_order(mixing.mix(docs)).collect()]
    assert positions == sorted(positions, key=lambda p: (p is None, p))


def test_inverse_demand(spark):
    for schedule in mixing.SCHEDULES:
        area = lambda t: sum((lambda a, b, wa, wb: (b - a) * (wa + (wa + (wb - wa) * (b - a) / (t1 - t0))) / 2)(t0, min(t, t1), w0, w1) for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]) if t > t0)  # noqa: B023, E731
        for r in spark.range(11).select((F.col("id") / 10).alias("y"), mixing.inverse_demand(F.col("id") / 10, schedule).alias("t")).collect():
            assert abs(area(r["t"]) / area(1.0) - r["y"]) < 1e-9


def test_language_model(spark, docs, monkeypatch):
    monkeypatch.setattr(lm, "LEAST_STEPS", 30)
    words = lambda t: (t or "").encode().lower().split() + [b"\n"]
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    count = Counter(w for i, t in ROWS if not held(i) for w in words(t))
    n, v = sum(count.values()), len(count)
    expected = [(i, held(i), len(words(t)), sum(w in count for w in words(t)), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words(t)), 6)) for i, t in ROWS]
    out = lm.language_model_scores(docs)
    assert got(out, "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6)) == want(expected)
    assert all(r["score"] < 0 for r in out.collect())


def test_language_model_probabilities_sum_to_one(monkeypatch):
    import numpy as np

    monkeypatch.setattr(lm, "HEAD", 6)
    count = Counter({b"\n": 9, b"aa": 8, b"ba": 7, b"c": 5, b"d": 4, b"e": 3, b"fa": 2, b"g": 2, b"h": 1})
    words = list(count)
    bounds = np.array([0, 1, 3, 6])
    n, v = np.zeros(lm.TAILS), np.zeros(lm.TAILS)
    for w in words[6:]:
        n[lm.tail_class(w)] += count[w]
        v[lm.tail_class(w)] += 1
    model = lm.Model(words, np.array(list(count.values())), bounds, np.log10(n + v + 1), sum(count.values()), len(count)).ready()
    model.weights = lm.first_weights(model)
    seq = [words[i % 9] for i in (1, 2, 3, 1, 2, 3, 6, 1, 2, 3, 1, 2, 3, 7, 0)]
    ids, klass, entry = model.encode(seq)
    before = lm.score_texts(model, ids, klass, entry, np.array([len(seq)])).sum()
    lm.train(model, [(ids, klass, np.concatenate([[model.entry[model.end]], entry[:-1]]))] * 40)
    after = lm.score_texts(model, ids, klass, entry, np.array([len(seq)])).sum()
    assert after > before
    h = np.random.default_rng(0).normal(size=(1, lm.HIDDEN)).astype(np.float32)
    total = 0.0
    for w in words[:6]:
        i, k, _ = model.encode([w])
        total += np.exp(lm.log_probability(model, h, i, k))[0]
    for c in range(lm.TAILS):
        total += np.exp(lm.log_probability(model, h, np.array([-1]), np.array([len(bounds) - 1 + c])))[0]
    assert abs(total - 1) < 1e-4


def test_language_model_windows_carry_state(monkeypatch):
    import numpy as np

    words = [b"\n", *(b"w%d" % i for i in range(30))]
    model = lm.Model(words, np.arange(60, 29, -1), np.array([0, 4, 12, 31]), np.zeros(lm.TAILS), 100, 31).ready()
    model.weights = lm.first_weights(model)
    rng = np.random.default_rng(1)
    sizes = np.array([5, 300, 1, 64, 65, 17])
    ids, klass, entry = model.encode([words[i] for i in rng.integers(0, 31, sizes.sum())])
    whole = lm.score_texts(model, ids, klass, entry, sizes, window=1000)
    assert np.allclose(whole, lm.score_texts(model, ids, klass, entry, sizes, group=2, window=7), rtol=1e-5)


def _trained_tokens(monkeypatch, tmp_path):
    """A call that tells, for each call of lm.train since, the tokens it was given."""
    real, at = lm.train, str(tmp_path)

    def train(model, segments, *rest, **named):
        import uuid

        with open(f"{at}/{uuid.uuid4().hex}", "w") as f:
            f.write(str(sum(len(s[0]) for s in segments)))
        return real(model, segments, *rest, **named)

    monkeypatch.setattr(lm, "train", train)
    return lambda: [int(p.read_text()) for p in tmp_path.iterdir()]


def test_language_model_of_held_out_rows_only(spark):
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2][:4]
    rows = list(zip(ids, ["a b c", "", None, "d"]))
    out = lm.language_model_scores(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got(out, "doc_id", "held_out", "n_tokens", "n_known", "train_tokens") == want([(i, True, len((t or "").split()) + 1, 0, 0) for i, t in rows])


def test_language_model_trains_on_every_token(spark, monkeypatch, tmp_path):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(n))) for i, n in enumerate([5000, 3, 0, 1600, 700, 40] * 5)]
    told = _trained_tokens(monkeypatch, tmp_path)
    monkeypatch.setattr(lm, "LEAST_STEPS", 1)
    out = lm.language_model_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(told()) == sum(r["n_tokens"] for r in out if not r["held_out"])


def test_language_model_holds_few_copies_at_once(spark, monkeypatch, tmp_path):
    copies = spark.range(3000).selectExpr("id as doc_id", "'one text that a third of all rows hold' as text")
    assert copies.select(lm.turn_of().alias("t")).distinct().count() == 16
    told = _trained_tokens(monkeypatch, tmp_path)
    monkeypatch.setattr(lm, "LEAST_STEPS", 1)
    monkeypatch.setattr(lm, "BATCH", 500)
    out = lm.language_model_scores(copies).collect()
    assert sum(told()) == 10 * sum(not r["held_out"] for r in out) and max(told()) <= 510


def test_language_model_lanes_carry_state_over_batches(monkeypatch):
    import numpy as np

    monkeypatch.setattr(lm, "STREAMS", 3)
    words = [b"\n", *(b"w%d" % i for i in range(30))]
    rng = np.random.default_rng(1)
    docs = []
    for n in (400, 30, 1, 90, 200, 7):
        x = rng.integers(0, 31, n)
        docs.append((x, np.searchsorted([4, 12, 31], x, "right"), np.append(0, x[:-1])))
    seen, got_, calls = Counter(), Counter(), []
    model = lm.Model(words, np.arange(60, 29, -1), np.array([0, 4, 12, 31]), np.zeros(lm.TAILS), 100, 31).ready()
    model.weights = lm.first_weights(model)
    whole = lm.score_texts(model, *(np.concatenate([d[k] for d in docs]) for k in range(3)), np.array([len(d[0]) for d in docs]))
    real = lm.log_probability

    def counted(m, h, ids, klass, grads=None):
        got_.update(ids.tolist())
        out = real(m, h, ids, klass, grads)
        calls.append(float(out.sum()))
        return out

    monkeypatch.setattr(lm, "log_probability", counted)
    rest = []
    for some in (docs[:2], docs[2:4], docs[4:], []):
        seen.update(int(x) for d in some for x in d[0])
        lm.train(model, some, 0.0, rest=rest)
    assert not rest and got_ == seen and abs(sum(calls) - whole.sum()) < 1e-2 * abs(whole.sum()) / 10


def _small_model(seed=3):
    import numpy as np

    words = [b"\n", *(b"w%d" % i for i in range(20)), b"rare", b"odd"]
    model = lm.Model(words, np.arange(60, 37, -1), np.array([0, 1, 4, 12, 21]), np.log10(np.arange(2.0, 2 + lm.TAILS)), 1000, 23).ready()
    rng = np.random.default_rng(seed)
    model.weights = {k: (v + rng.normal(0, 0.3, v.shape)).astype(np.float64) for k, v in lm.first_weights(model).items()}
    return model, rng


def plain_log_probability(model, words):
    """The model's natural log probability of a text, from its definition, one token and one number at a time."""
    w, k, base = model.weights, lm.HIDDEN, len(model.bounds) - 1
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    number = {x: i for i, x in enumerate(model.words)}
    h, before, out = [0.0] * k, b"\n", 0.0
    for word in words:
        i = number.get(before, -1)
        x = w["x"][:, i if 0 <= i < model.n_head else model.n_head + zlib.crc32(before[-2:]) % lm.TAILS]
        a = [sum(h[r] * w["u"][r][c] for r in range(k)) for c in range(3 * k)]
        z = [sigmoid(x[c] + a[c]) for c in range(k)]
        r = [sigmoid(x[k + c] + a[k + c]) for c in range(k)]
        n = [math.tanh(x[2 * k + c] + r[c] * a[2 * k + c]) for c in range(k)]
        h = [(1 - z[c]) * n[c] + z[c] * h[c] for c in range(k)]
        i = number.get(word, -1)
        head = 0 <= i < model.n_head
        klass = sum(i >= b for b in model.bounds[1:-1]) if head else base + zlib.crc32(word[-2:]) % lm.TAILS
        logits = [sum(h[q] * w["c"][q][c] for q in range(k)) + w["cb"][c] for c in range(base + lm.TAILS)]
        out += logits[klass] - math.log(sum(map(math.exp, logits)))
        if head:
            members = range(model.bounds[klass], model.bounds[klass + 1])
            logits = {m: sum(h[q] * w["o"][m][q] for q in range(k)) + w["ob"][m] for m in members}
            out += logits[i] - math.log(sum(map(math.exp, logits.values())))
        before = word
    return out


def test_language_model_against_its_definition():
    import numpy as np

    model, rng = _small_model()
    texts = [[(model.words + [b"new", b"other"])[i] for i in rng.integers(0, 25, n)] + [b"\n"] for n in (0, 1, 7, 30)]
    codes, klass, entry = model.encode([w for t in texts for w in t])
    found = lm.score_texts(model, codes, klass, entry, np.array([len(t) for t in texts]), group=3, window=5)
    assert np.allclose(found, [plain_log_probability(model, t) for t in texts], rtol=1e-5)


def test_language_model_gradients(monkeypatch):
    import numpy as np

    monkeypatch.setattr(lm, "STREAMS", 2)
    model, rng = _small_model()
    texts = [rng.integers(0, 23, n).astype(np.int32) for n in (9, 5, 7)]
    segments = [(x, model.klass[x], np.append(model.first, model.entry[x][:-1])) for x in texts]
    flat, sizes = np.concatenate(texts), np.array([len(x) for x in texts])
    start = model.weights

    def loss(weights):
        model.weights = weights
        return -lm.score_texts(model, flat, model.klass[flat], model.entry[flat], sizes).sum() / sizes.sum()

    model.weights = {k: v.copy() for k, v in start.items()}
    lm.train(model, segments, 1.0, seen={k: np.full(v.shape, 1e12) for k, v in start.items()} | {"rows": int(sizes.sum())})
    stepped = model.weights
    for name in start:
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in start[name].shape)
            more, less = ({k: v.copy() for k, v in start.items()} for _ in range(2))
            more[name][at] += 2e-3
            less[name][at] -= 2e-3
            assert abs((start[name] - stepped[name])[at] * 1e6 - (loss(more) - loss(less)) / 4e-3) < 1e-4, name


def test_language_model_beats_its_base_on_held_out_rows(spark):
    rng = random.Random(9)
    follow = {f"w{i}": [f"w{rng.randrange(40)}" for _ in range(2)] for i in range(40)}

    def text():
        words = [f"w{rng.randrange(40)}"]
        while len(words) < 60:
            words.append(rng.choice(follow[words[-1]]))
        return " ".join(words)

    out = lm.language_model_scores(spark.createDataFrame([(i, text()) for i in range(300)], "doc_id long, text string")).collect()
    held = [r for r in out if r["held_out"]]
    assert len(held) > 20 and sum(r["score"] for r in held) > 0.75 * sum(r["base_score"] for r in held)


def test_language_model_lists_the_first_words(spark, monkeypatch):
    monkeypatch.setattr(lm, "LISTED", 50)
    counts = [(f"w{i}".encode(), 0, 40 - i // 10) for i in range(100)] + [(f"v{i}".encode(), 0, 2) for i in range(30)] + [(lm.END, 0, 1)]
    table = spark.createDataFrame(counts, "word binary, tail int, c long")
    listed = lm.listed_words(table)
    # whole groups of ten, and the end token whatever its count
    assert [bytes(w) for w in listed["word"]] == sorted((f"w{i}".encode() for i in range(50)), key=lambda w: (int(w[1:]) // 10, w)) + [lm.END]
    monkeypatch.setattr(lm, "LISTED", 115)
    some = [bytes(w) for w in lm.listed_words(table)["word"]]
    assert len(some) in range(101, 117) and {f"w{i}".encode() for i in range(100)} < set(some) and lm.END in some and 10 <= sum(w[:1] == b"v" for w in some) <= 15


@pytest.mark.parametrize("rows", [1, 3])
def test_language_model_of_few_rows_with_many_rare_words(spark, monkeypatch, rows):
    monkeypatch.setattr(lm, "LISTED", 200)
    monkeypatch.setattr(lm, "LEAST_STEPS", 30)
    trained = []
    learn = lm.fit
    monkeypatch.setattr(lm, "fit", lambda spark, rows, model: trained.append(model) or learn(spark, rows, model))
    text = " ".join([f"a{i}" for i in range(100)] * 3 + [f"b{i}" for i in range(150)] * 2)
    ids = [i for i in range(50) if zlib.crc32(str(i).encode()) % 7 != 2][:rows]
    out = lm.language_model_scores(spark.createDataFrame([(i, text) for i in ids], "doc_id long, text string")).collect()
    assert len(out) == rows and all(r["n_tokens"] == r["n_known"] == 601 and r["score"] < 0 and math.isfinite(r["score"]) for r in out)
    assert len(trained[0].words) > 150 and lm.END in trained[0].words


def test_language_model_of_a_few_very_long_rows(spark, monkeypatch):
    monkeypatch.setattr(lm, "LEAST_STEPS", 30)
    rng = random.Random(5)
    ids = [i for i in range(50) if zlib.crc32(str(i).encode()) % 7 != 2][:2]
    rows = [(ids[0], " ".join(f"w{rng.randrange(300)}" for _ in range(40_000))), (ids[1], "x" * 1_000_000), (ids[1], " ".join(f"d{i}" for i in range(60_000)))]
    out = lm.language_model_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["n_tokens"] for r in out) == [2, 40_001, 60_001] and all(math.isfinite(r["score"]) and r["score"] < 0 for r in out)


def test_scorer_against_training_means(spark):
    import numpy as np

    rng = random.Random(2)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "Été", "x", "x", "stone"]) for _ in range(rng.randrange(0, 40))) for _ in range(30)] + [None, ""]
    logits, bias = quality.train(texts[:20], np.array([i % 2 for i in range(20)]))
    expected = []
    for t in texts:
        words = (t or "").encode().split()
        features = []
        for w in words:
            _, what, _ = quality.word_features([w])
            features += what.tolist()
        hashes = [quality.word_features([w])[2][0] for w in words]
        for a, b in zip(hashes, hashes[1:]):
            features += quality.pair_features(np.array([a, b], np.uint64), np.array([2]))[1].tolist()
        mean = sum(float(logits[f]) for f in features) / max(1, len(features))
        expected.append(1 / (1 + math.exp(-(mean + bias))))
    assert np.allclose(quality.Scorer(logits, bias)(texts), expected, atol=1e-6)
    assert np.allclose(quality.Scorer(logits, bias, room=2)(texts), expected, atol=1e-6)


def test_quality(spark):
    rng = random.Random(6)
    good = lambda: " ".join(rng.choice(["the", "river", "ran", "over", "stones", "and", "sang"]) for _ in range(30))
    bad = lambda: rng.choice([lambda: "BUY!! " * 20, lambda: " ".join(rng.choice(["foo###", "bar***", "qux&&"]) for _ in range(25)), lambda: "stones " * 30])()
    rows = [(i, good() if i % 3 else bad()) for i in range(300)] + [(900, None), (901, ""), (None, good()), (5, good())]
    labels = [(i, int(i % 3 > 0)) for i in range(300)] + [(None, 1), (7, None), (5000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x"))
    out = quality.quality_scores(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    told = out.collect()
    assert len(told) == len(rows)
    held = [r for r in told if r["doc_id"] is not None and r["doc_id"] < 300 and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 and r["doc_id"] != 5]
    assert sum(r["predicted"] == int(r["doc_id"] % 3 > 0) for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in told)
    empty = [r["score"] for r in told if not r["text"]]
    assert len(set(empty)) == 1
    none = quality.quality_scores(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert {r["score"] for r in none} == {0.5}


def test_media(spark, docs):
    expected = []
    for i, t in ROWS:
        b = (t or "").encode()
        p = b + b"\0" * (-len(b) % 64 if b else 64)
        expected.append((i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), hashlib.sha256(tiff.store(p)).hexdigest()))
    assert got(tiff.text_media(docs), "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_sha256") == want(expected)
    pages = tiff.tiff_pages(tiff.store_text(docs.where("doc_id = 7")).withColumn("doc_id", F.col("doc_id").cast("string"))).orderBy("page").collect()
    text = next(t for i, t in ROWS if i == 7).encode()
    assert len(pages) > 1 and b"".join(bytes(p["data"]) for p in pages)[: len(text)] == text


def test_boilerplate(spark):
    page = lambda *lines: "<html><script>var a='<p>';</script><!-- x --><body>" + "".join(f"<p>{x}</p>" for x in lines) + "</body></html>"
    rows = [(i, f"HTTP://A.example/{i}", page("Home  page", f"text {i}", "Home page", "ad" if i == 1 else "")) for i in range(6)]
    rows += [(20 + i, f"https://b.example:80/{i}", page("Home page", "same")) for i in range(3)] + [(30, None, page("Home page")), (31, "no host", None), (1, "http://a.example/1", page("Home page"))]
    rows += [(40, "http://c.example/", page("alone")), (41, "http://d.example/", page("one", "both")), (42, "http://d.example/2", page("two", "both"))]
    out = {(r["page_id"], r["n_lines"]): r for r in line_dedup.strip_boilerplate(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("x")), 0.5).collect()}
    assert len(out) == len(rows)
    assert out[0, 3]["kept"] == "text 0" and out[0, 3]["n_dropped"] == 2 and out[0, 3]["host_pages"] == 7
    assert out[1, 4]["kept"] == "text 1\nad" and out[1, 1]["kept"] == ""
    assert out[20, 2]["kept"] == "" and out[30, 1]["kept"] == "Home page" and out[30, 1]["host"] is None and out[31, 0]["kept"] == ""
    assert out[40, 1]["kept"] == "alone" and out[41, 2]["kept"] == "one" and out[42, 2]["kept"] == "two"


def test_repeats_at_common_grams(spark, monkeypatch):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    license_ = " ".join(word() for _ in range(14))
    rows = [(i, f"{word()} {word()} {license_} {word()}" if i % 3 else " ".join(word() for _ in range(20))) for i in range(120)]
    rows += [(200 + i, f"{word()} {license_[:60]} {word()} {license_[20:]}") for i in range(10)] + [(7, f"again {license_}"), (None, license_)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    plain = got(suffix_dedup.remove_repeats(docs), *columns)
    monkeypatch.setattr(suffix_dedup, "LEAST_COMMON", 2)
    assert len(suffix_dedup._common(docs.where("doc_id is not null"), 50)) > 3
    for least in (10**9, 3):
        monkeypatch.setattr(suffix_dedup, "LEAST_REPEATED", least)
        assert got(suffix_dedup.remove_repeats(docs), *columns) == plain


def test_boilerplate_with_salted_hosts(spark, monkeypatch):
    rows = [(i, f"http://h{i % 3}.example/{i}", f"<p>menu {i % 3}</p><p>t{i}</p>") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    one = got(line_dedup.strip_boilerplate(pages), "page_id", "kept")
    monkeypatch.setattr(line_dedup, "sized", lambda df, rows=0: df)
    monkeypatch.setattr(line_dedup, "PART_PAGES", 7)
    assert got(line_dedup.strip_boilerplate(pages), "page_id", "kept") == one


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    items = spark.createDataFrame([], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for df in (near_dup.near_duplicates(none), suffix_dedup.remove_repeats(none), decontam.contamination(none, items), secrets.scan(none), sharding.shard_rows(none, 40), mixing.mix(none),
               lm.language_model_scores(none), quality.quality_scores(none, labels), tiff.text_media(none), line_dedup.strip_boilerplate(pages)):
        assert df.collect() == []
