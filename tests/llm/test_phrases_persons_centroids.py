"""Phrases, personal data and centroids against plain computations, on nulls, ties, repeated rows and long texts."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from quire.llm import centroids, collocations, personal

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_collocations(rows, least, first):
    f, n = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOW)):
            words = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(words)
            for size in range(1, 5):
                for i in range(len(words) - size + 1):
                    f[(lang or "und", tuple(words[i : i + size]))] += 1
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    longer = {}
    for (lang, p), a in candidates.items():
        for size in range(2, len(p)):
            for i in range(len(p) - size + 1):
                key = (lang, p[i : i + size])
                longer[key] = max(longer.get(key, 0), a)
    by_lang = {}
    for (lang, p), a in candidates.items():
        if 100 * longer.get((lang, p), 0) >= 80 * a:
            continue
        cuts = [(2_000_000 * a // (f[(lang, p[:k])] + f[(lang, p[k:])]), k, f[(lang, p[:k])], f[(lang, p[k:])]) for k in range(1, len(p))]
        score, _, left, right = min(cuts)
        by_lang.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -score) for lang, found in by_lang.items() for i, (score, a, p, left, right) in enumerate(sorted(found)[:first]))


def phrase_rows():
    rng = random.Random(8)
    words = ["to", "be", "or", "not", "Été", "x%y", "ab\x00c", "the", "end", " ", "of"] + [f"r{i}" for i in range(60)]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", " "]) for _ in range(n))
    rows = [(rng.choice(["en", "fr", None, "und"]), text(rng.randrange(1, 120))) for _ in range(150)]
    rows += [("en", "to be OR not to be. " * 40), ("en", None), (None, ""), ("fr", " .,; "), ("en", "New York City hall " * 50), ("en", "New York City hall " * 50)]
    return rows + [("de", "a" * 300_000), ("de", "eins zwei drei vier " * 40_000)]


@pytest.mark.parametrize("first", [7, 2000])
def test_collocations(spark, monkeypatch, first):
    monkeypatch.setattr(collocations, "HELD", 5000)
    monkeypatch.setattr(collocations, "RANKED", 20)
    rows = phrase_rows()
    docs = spark.createDataFrame([(t, lang, "s", 1, 2) for lang, t in rows], "text string, lang string, phrase string, n long, a long").repartition(5)
    found = collocations.collocations(docs, least=4, first=first)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == plain_collocations(rows, 4, first)


def test_collocations_where_hashes_clash(spark, monkeypatch):
    monkeypatch.setattr(collocations, "clashing_words", lambda counted: {b"york": 1, b"to": 2, b"be": 3})
    rows = phrase_rows()[:-2]
    docs = spark.createDataFrame([(t, lang) for lang, t in rows], "text string, lang string")
    assert sorted(map(tuple, collocations.collocations(docs, least=5).collect())) == plain_collocations(rows, 5, 2000)


def test_words_that_share_a_hash_are_found(spark):
    counted = spark.createDataFrame([("en", b"a", 7_000_000, -1, 3), ("fr", b"b", 7_000_000, -1, 1), ("en", b"c", 8_000_000, -1, 1), ("de", b"c", 8_000_000, -1, 1), ("en", b"d", 5, -1, 1), (None, None, 0, 4, 40)], "lang string, word binary, h long, bucket int, n long")
    assert collocations.clashing_words(counted) == {b"a": 1, b"b": 2, b"d": 3}


def test_full_buckets_cut_nothing(spark, monkeypatch):
    monkeypatch.setattr(collocations, "bucket_bits", lambda buckets: np.full(1 << (collocations.BUCKET_BITS - 3), 255, np.uint8))
    rows = phrase_rows()[:-2]
    docs = spark.createDataFrame([(t, lang) for lang, t in rows], "text string, lang string")
    assert sorted(map(tuple, collocations.collocations(docs, least=6).collect())) == plain_collocations(rows, 6, 2000)


def test_score_of_large_counts_is_exact(spark):
    a, f = 9 * 10**15 + 7, 9 * 10**15 + 11
    counts = spark.createDataFrame([("en", 1, 5, 0, 0, 0, f), ("en", 1, 6, 0, 0, 0, f), ("en", 2, 5, 6, 0, 0, a)], "lang string, size int, w1 long, w2 long, w3 long, w4 long, f long")
    assert [r["score"] for r in collocations.scored(counts, 2_000_000).collect()] == [2_000_000 * a // (2 * f)]


def plain_personal(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = [int(c) for c in m.group() if c.isdigit()]
        doubled = [d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
        if 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]


def test_base_spans():
    rng = random.Random(5)
    for _ in range(20_000):
        letters = rng.choice(["0123456789 -", "a1@.-_ ", "0123.25", "+0123456789 ().-a", "a@b.c1 2+-("])
        t = "".join(rng.choice(letters) for _ in range(rng.randrange(60)))
        assert personal.base_spans(t)[0] == plain_personal(t), t


@pytest.mark.parametrize("unit", ["a", "1", "+1", "@", "a@", "1 ", "A", "(", "12 ", "a.", "Ab ", "1:", "a at "])
def test_long_runs_take_time_in_proportion(unit):
    found, _ = personal._found(unit * (1_000_000 // len(unit)))
    assert found == [] or unit == "+1"


def person_rows():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(50)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    good = "4539 1488 0343 6467"
    hits = ["mail a.b@example.com now", "from 10.0.0.1 here", f"card {good} please", "call +1 (415) 555-0134 today", "server 300.1.1.1 down", "number 1234567890123456 of", "or 4539148803436460 and"]
    rows = [(i, f"{text(10)} {rng.choice(hits)} {text(10)}") for i in range(200)]
    rows += [(300, "please call me on (415) 555-0199 tomorrow"), (301, "write to john.doe at example dot com today"), (302, "Dear Mr. Peter Miller, all is well"), (303, "order 4539148803436460 is late"), (304, "nothing at all")]
    rows += [(None, "x@y.de"), (400, None), (401, ""), (402, "x@y.de"), (402, "x@y.de"), (403, "é😀 x@y.de")]
    return rows


def test_personal_data(spark):
    rows = person_rows()
    docs = spark.createDataFrame([(i, t, "s", 3, "e") for i, t in rows], "doc_id long, text string, spans string, n_email long, base_sha256 string").repartition(3)
    found = personal.personal_data(docs).collect()
    assert len(found) == len(rows)
    order = {k: i for i, k in enumerate(personal.KINDS)}
    want = Counter()
    for i, t in rows:
        base = sorted(plain_personal(t or ""), key=lambda s: (order[s[0]], s[1]))
        n = Counter(k for k, _, _ in base)
        want[(i, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in found) == want
    spans = {r["doc_id"]: r["spans"] for r in found}
    assert spans[300] == "phone:18:32" and spans[301] == "email:9:36" and spans[302] == "name:5:21"
    assert spans[303] == spans[304] == spans[400] == spans[401] == "" and spans[403] == "email:3:9"
    texts = {i: t for i, t in rows}
    assert all(r["n_added"] == 0 for r in found if r["doc_id"] is not None and r["doc_id"] < 300), [texts[r["doc_id"]] for r in found if r["n_added"]]


def test_reliabilities_tell_bad_checksums():
    # yes of the first labeler for all, and a second one that fails for a quarter of the spans
    yes_no = sum((v + 1) * 3**i for i, v in enumerate((1, -1, 0, 0, 0, 0, 0, 0)))
    yes_yes = sum((v + 1) * 3**i for i, v in enumerate((1, 1, 0, 0, 0, 0, 0, 0)))
    believed, said, share = personal.reliabilities({("card", True, yes_yes): 900, ("card", False, yes_no): 300})
    assert believed[("card", True, yes_yes)] == 1 and believed[("card", False, yes_no)] < 0.05 and share["card"] < 0.1
    assert said[1, 1, 1] > 0.95


def plain_clusters(vectors, k, rounds):
    kept = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in vectors if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    named = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centroids_ = [q for _, q in named[:k]]
    nearest = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c)), j) for j, c in enumerate(centroids_))
    for _ in range(rounds):
        of = {}
        for _, q in kept:
            of.setdefault(nearest(q)[1], []).append(q)
        centroids_ = [[sum(col) // len(of[j]) for col in zip(*of[j])] if j in of else c for j, c in enumerate(centroids_)]
    found = [(i, *nearest(q)[::-1]) for i, q in kept]
    inertia = Counter()
    for _, c, d in found:
        inertia[c] += d
    return Counter((i, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids_[c])).encode()).hexdigest()) for i, c, d in found)


def vector_rows(n=220):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(rng.integers(-2, 3), 0.3, 64).round(2).tolist()) for i in range(n)]
    rows += [(1000, rows[5][1]), (1001, rows[5][1]), (5, rows[5][1]), (None, rows[6][1]), (None, [0.0] * 64), (1002, [0.5] * 63), (1003, [float("nan")] + [0.0] * 63), (1004, [float("-inf")] + [0.0] * 63), (1005, None), (1006, [None] + [0.0] * 63)]
    return rows + [(2000 + i, [1.0] * 64) for i in range(60)]


def test_clusters(spark):
    rows = vector_rows()
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, cluster int, distance long").repartition(3)
    found = centroids.cluster_vectors(table, clusters=12)
    got = Counter(tuple(r) for r in found.drop("centroid").collect())
    assert got == plain_clusters(rows, 12, 5)
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")
    assert Counter(tuple(r) for r in centroids.cluster_vectors(few, clusters=12).drop("centroid").collect()) == plain_clusters(rows[:3], 12, 5)


def test_search_is_exact_and_passes_most_over():
    rng = np.random.default_rng(4)
    c = np.floor(rng.normal(rng.integers(-40, 40, (40, 1)), 20, (40, 64))).astype(np.int64)
    c[7] = c[3]
    x = np.concatenate([np.floor(rng.normal(rng.integers(-40, 40, (500, 1)), 20, (500, 64))).astype(np.int64), c, (c[:20] + c[20:]) // 2])
    search = centroids.Search(c)
    owner, best = search(x)
    d = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    assert (best == d.min(axis=1)).all() and (owner == d.argmin(axis=1)).all()
    assert search.tested < 0.5 * d.size


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert collocations.collocations(docs).collect() == []
    assert personal.personal_data(docs).collect() == []
    assert centroids.cluster_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
