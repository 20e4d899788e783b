"""The pipeline, stage by stage on its own input, against a plain computation of each stage."""

import hashlib
import random
import re
import threading
from collections import Counter, defaultdict

import pytest
from test_llm_operators import LOW, descend, shingles

import corpus_pipeline
from quire.llm import common, quality, sharding


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    vocabulary = ["river", "stone", "and", "the", "over", "sang", "hill", "cloud", "in", "morning", *(f"name{i}" for i in range(120))]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    docs, labels = [], []
    passage = text(14)
    for i in range(160):
        bad = i % 6 == 0
        body = " ".join(rng.choice(["foo###", "bar***", "qux&&&"]) for _ in range(40)) if bad else text(rng.randrange(20, 120))
        if not bad and i % 13 == 1:
            body += " " + passage + " " + text(5)
        docs.append([i, body, "en", f"s{i % 4}" if i % 31 else None, len(body)])
        labels.append((i, int(not bad), 0))
    for i in range(160, 180):
        words = docs[7][1].split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            words[rng.randrange(len(words))] = "changed"
        docs.append([i, " ".join(words), "en", "s1", 5])
    at = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, text(30))], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def near(rows):
    sets = {r["doc_id"]: shingles(r["text"]) for r in rows}
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return [i for i in sets if find(i) == i]


def clean(rows, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOW))
    grams = lambda w: {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))}
    windows = set().union(*(grams(split(t)) for t in items))
    return [r["doc_id"] for r in rows if not grams(split(r["text"])) & windows]


def mixed(rows):
    sizes = {r["doc_id"]: len(r["text"].split()) for r in rows}
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r["doc_id"])
    total = {s: sum(sizes[i] for i in ids) for s, ids in by.items()}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(by, key=lambda s: (s is None, s)))}
    goal, open_ = {}, set(by)
    while True:
        left = sum(total.values()) - sum(goal.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * total[s]}
        if not full:
            break
        goal |= {s: 3.0 * total[s] for s in full}
        open_ -= full
    goal |= share
    out = Counter()
    for s, ids in by.items():
        start = 0
        for i in sorted(ids, key=lambda i: hashlib.md5(f"mix:{i}".encode()).hexdigest()):
            for again in range(3):
                taken = max(0, min(sizes[i], int(goal[s] + 0.5) - again * total[s] - start))
                out[i] += taken > 0 and 2 * taken >= sizes[i]
            start += sizes[i]
    return out


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    every = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        after = corpus_pipeline.staged(stage(spark, docs, folder), name)
        rows = after.collect()
        ids = sorted(r["doc_id"] for r in rows)
        if name == "quality_classifier":
            scored = quality.quality_scores(docs, spark.read.parquet(f"{folder}/labels.parquet")).where("predicted = 1").collect()
            assert ids == sorted(r["doc_id"] for r in scored)
            assert all(i % 6 for i in ids if i < 160) and len(ids) >= 0.95 * sum(1 for r in every if r["doc_id"] % 6 or r["doc_id"] >= 160)
        elif name == "minhash_near_dup":
            assert ids == sorted(near(before)) and len(ids) < len(before) - 4
        elif name == "benchmark_decontamination":
            assert ids == sorted(clean(before, [r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()])) and len(ids) < len(before) - 5
        elif name == "source_mixing":
            assert Counter(ids) == +mixed(before)
        else:
            slots = defaultdict(list)
            for r in rows:
                assert r["shard"] == descend(r["doc_id"], sharding.plan(40))
                slots[r["shard"]].append(r["slot"])
            assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and ids == sorted(r["doc_id"] for r in before)
        if name != "sharding":
            assert after.columns == columns
        docs = after
    whole = corpus_pipeline.run(spark, folder)
    assert sorted(tuple(map(str, r)) for r in whole.drop("slot").collect()) == sorted(tuple(map(str, r)) for r in docs.drop("slot").collect())


ODD = "doc_id long, text string, lang string, source string, n_chars long, size long, bucket string, position long, score double, words string, gone_id long, _held_0 int, shard int"


def test_stages_with_odd_rows_and_clashing_columns(spark, folder):
    good = "the river and the stone sang over the hill in the morning cloud " * 3
    long_ = "river stone and the over sang hill cloud in morning " * 3000
    texts = [(1, good), (1, good), (None, good), (None, None), (2, None), (3, ""), (4, "   "), (5, long_), (6, "stone" * 5000), (7, good.replace("hill", "name1")), (None, "the morning sang over name7 and name8 in the river")]
    rows = [(i, t, "en", None if i == 2 else "s", 1, 2, "b", 3, 0.5, "w", 9, 4, 5) for i, t in texts]
    docs = spark.createDataFrame(rows, ODD).repartition(2)
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = corpus_pipeline.staged(stage(spark, docs, folder), name)
        after = docs.collect()
        if name != "sharding":
            assert docs.columns == spark.createDataFrame([], ODD).columns
            assert all((r["size"], r["bucket"], r["position"], r["score"], r["words"], r["gone_id"], r["_held_0"], r["shard"]) == (2, "b", 3, 0.5, "w", 9, 4, 5) for r in after)
        else:
            assert docs.columns == [c for c in spark.createDataFrame([], ODD).columns if c not in ("size", "shard")] + ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
            assert all(r["bucket"] == "b" and r["_held_0"] == 4 for r in after) and len(after) == len(before)
        if name == "minhash_near_dup":
            ids = [r["doc_id"] for r in after]
            assert ids.count(1) == min(1, [r["doc_id"] for r in before].count(1)) and all(r["text"] != good for r in after if r["doc_id"] is None)
            apart = [r["text"] for r in before if r["doc_id"] is None and r["text"] != good]
            assert sorted(map(str, apart)) == sorted(str(r["text"]) for r in after if r["doc_id"] is None)


def test_stages_of_an_empty_table(spark, folder):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.staged(stage(spark, docs, folder), name)
        assert docs.count() == 0


def test_slots_follow_the_order_of_the_mix(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    mixed_ = corpus_pipeline.staged(corpus_pipeline.mixing_stage(spark, docs, folder), "mixed")
    read = [(r["doc_id"], r["text"]) for r in mixed_.select("*", "_metadata.file_name", "_metadata.row_index").orderBy("file_name", "row_index").collect()]
    rows = corpus_pipeline.sharding_stage(spark, mixed_, folder).orderBy("shard", "slot").collect()
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append((r["doc_id"], r["text"]))
    for shard, held in by.items():
        assert held == [x for x in read if descend(x[0], sharding.plan(40)) == shard]


def test_run_deletes_what_it_staged_on_the_way(spark, folder, tmp_path, monkeypatch):
    from quire.llm import common

    monkeypatch.setattr(common, "shared_dir", lambda spark: str(tmp_path))
    assert corpus_pipeline.run(spark, folder).count() > 0
    assert {p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()} == {name for name, _ in corpus_pipeline.STAGES}


def _staged_by(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(common, "shared_dir", lambda spark: str(tmp_path))
    return lambda: sorted(p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir())


def test_two_runs_at_once_leave_each_other_alone(spark, monkeypatch, tmp_path):
    there = _staged_by(spark, monkeypatch, tmp_path)
    gate, found = threading.Barrier(2), {}

    def run(name, n):
        with common.cleared(spark):
            docs = spark.range(n)
            for step in range(3):
                with common.cleared(spark):
                    common.staged(docs.where("id < 0"), f"{name}aside")
                    gate.wait(60)
                    docs = common.staged(docs.where(f"id <> {step}"), f"{name}{step}")
                    gate.wait(60)
        found[name] = docs.count()

    both = [threading.Thread(target=run, args=x) for x in (("a", 50), ("b", 70))]
    for t in both:
        t.start()
    for t in both:
        t.join()
    assert found == {"a": 47, "b": 67} and there() == ["a2", "b2"]


def test_a_failing_stage_leaves_what_is_done_only(spark, monkeypatch, tmp_path):
    there = _staged_by(spark, monkeypatch, tmp_path)
    monkeypatch.setattr(corpus_pipeline, "table", lambda spark, sf_dir, name: spark.range(5))

    def fails(spark, docs, sf_dir):
        common.staged(docs, "half")
        raise RuntimeError("stage")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("first", lambda spark, docs, sf_dir: common.staged(docs, "aside").where("id > 1")), ("second", fails)])
    with pytest.raises(RuntimeError, match="stage"):
        corpus_pipeline.run(spark, "")
    assert there() == ["first"]
    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[:1])
    assert corpus_pipeline.run(spark, "").count() == 3 and there() == ["first", "first"]
