"""Small cases for findings on large tables: what is done for each row or key stays little."""

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Row
from pyspark.sql import functions as F

from quire.llm import lm
from quire.llm.common import split_words
from quire.operators import normalize, words
from quire.streaming import progress


class Kept:
    """A state of one key that counts the calls it gets, each of which is a round trip between Python and the JVM."""

    calls = 0

    def __init__(self):
        self.values = {}

    def called(self):
        Kept.calls += 1
        return self.values

    def get(self):
        return self.called().get(None)

    def update(self, value):
        self.called()[None] = value

    def getValue(self, key):
        return self.called().get(key)

    def updateValue(self, key, value):
        self.called()[key] = value

    def removeKey(self, key):
        self.called().pop(key, None)


class Handle:
    def __init__(self):
        self.kept = {}

    def getMapState(self, name, *_):
        return self.kept.setdefault(name, Kept())

    getValueState = getMapState


def test_a_micro_batch_calls_the_state_a_few_times_however_many_chunks_wait():
    """chunks beyond a hole are read and written by blocks."""
    rng, handle = random.Random(3), Handle()
    chunks = [i for i in range(3 * progress.BLOCK) if i] * 2
    rng.shuffle(chunks)
    chunks.append(0)
    lots = [chunks[: len(chunks) // 2], chunks[len(chunks) // 2 :]]
    first, seq, got = {}, 0, []
    for lot in lots:
        rows = []
        for chunk in lot:
            rows.append(Row(seq=seq, chunk_index=chunk, frames=seq % 7 + 1, total_chunks=3 * progress.BLOCK))
            first.setdefault(chunk, seq)
            seq += 1
        state = progress._Rendered()
        state.init(handle)
        Kept.calls = 0
        got.append(list(state.advanced(iter(rng.sample(rows, len(rows))))))
        assert Kept.calls <= 2 + 2 * 3
    assert got[0] == [(0, 0, 3 * progress.BLOCK, -1, None)]
    assert [x[0] for x in got[1][:-1]] == list(range(1, 3 * progress.BLOCK + 1))
    assert got[1][-1][1] == sum(s % 7 + 1 for s in first.values()) and got[1][-1][3] == seq - 1
    assert not handle.kept["waiting"].values


def test_items_without_white_space_carry_no_arrays_through_the_window(spark):
    """words and gaps are cut after the window, and for items that hold white space only; results are the old ones."""
    texts = ["one", "two words", " before", "after ", "a b  c", " \t", "x", "", " ", "end", "no​gap", "é𝐀 𝐁!"]
    items = spark.createDataFrame([(1, 0, i, s, 10.0 * i, 6.0, i % 5 == 3) for i, s in enumerate(texts)], "doc_id int, page_index int, item_seq int, str string, x double, width double, has_eol boolean")
    pieces = words.split_items(items)
    plan = pieces._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" in plan[: plan.index("Window [")] and "regexp_extract_all" not in plan[plan.index("Window [") :]
    want, shown = [], [(i, s) for i, s in enumerate(texts) if s]
    for at, (i, s) in enumerate(shown):
        found = [m.span() for m in re.finditer(r"\S+", s)]
        blank_next = at + 1 < len(shown) and not shown[at + 1][1].strip()
        for k, (a, b) in enumerate(found):
            after = b < len(s) if k + 1 == len(found) else True
            before = a > (found[k - 1][1] if k else 0)
            unit = 6.0 / len(s)
            want.append((i, k, s[a:b], round(10.0 * i + unit * a, 9), round(10.0 * i + unit * b, 9), before, after or (k + 1 == len(found) and (i % 5 == 3 or blank_next))))
    got = pieces.select("item_seq", "piece", "text", F.round("x0", 9), F.round("x1", 9), "space_before", "space_after").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_frequent_tokens_meet_their_phonemes_where_they_stand(spark, monkeypatch):
    """only tokens that are not frequent are shuffled, and each token keeps its one row, whatever the bound."""
    said = ["The", "the", "the,", "(cat)", "—", "dog", "dog", "dog", "𝐀!", "x" * 70, "x" * 70, "x" * 70]
    tokens = spark.createDataFrame([(d, i, s) for d in range(3) for i, s in enumerate(said + [f"w{d}"])], "doc_id int, token_idx int, token string")
    lexicon = spark.createDataFrame([("the", "ðə"), ("the", "ði"), ("dog", "dɒɡ"), ("owl", "aʊl")], "word string, phonemes string")
    known = {"the": "ði", "dog": "dɒɡ"}
    known["the"] = min("ðə", "ði")
    bared = {s: re.sub(r"^[^\w]+|[^\w]+$", "", s).lower() for s in said + ["w0", "w1", "w2"]}
    want = sorted((d, i, s, known.get(bared[s], "-".join(bared[s])), bared[s] not in known) for d in range(3) for i, s in enumerate(said + [f"w{d}"]))
    for bound in (100_000, 4, 0):
        monkeypatch.setattr(normalize, "FREQUENT", bound)
        assert sorted(map(tuple, normalize.pronounce_join(tokens, lexicon).collect())) == want
    monkeypatch.setattr(normalize, "FREQUENT", 4)
    plan = normalize.pronounce_join(tokens, lexicon)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan and "LeftAnti" in plan


def test_an_input_s_weights_stand_together_and_steps_stay_the_gradient_s():
    """op1_lm_scoring: inputs are gathered by rows, which takes a tenth of the time; a first step is the rate by the gradient's sign."""
    heads = [b"\n", *(b"w%d" % i for i in range(9))]
    model = lm.Model(heads, np.arange(30, 20, -1), np.array([0, 3, 10]), np.zeros(lm.TAILS), 255, 10).ready()
    model.weights = lm.first_weights(model)
    start = {k: v.copy() for k, v in model.weights.items()}
    ids, klass, _ = model.encode([heads[i] for i in (1, 2, 3, 1, 2, 5, 0)])
    entry = np.append(model.first, model.entry[ids[:-1]])
    lm.train(model, [(ids, klass, entry)] * 8)
    assert model.weights["x"].T.flags.c_contiguous and model.weights["x"].shape == start["x"].shape
    unseen = np.setdiff1d(np.arange(start["x"].shape[1]), entry)
    assert (model.weights["x"][:, unseen] == start["x"][:, unseen]).all() and (model.weights["x"][:, entry] != start["x"][:, entry]).any()
    assert model.weights["ob"][5] > model.weights["ob"][4]


def test_language_model_scores_texts_in_even_lanes(monkeypatch):
    """op1_lm_scoring: a long text's end is walked beside other texts, and not alone."""
    words = [lm.END, *(b"w%d" % i for i in range(9))]
    model = lm.Model(words, np.arange(30, 20, -1), np.array([0, 3, 10]), np.zeros(lm.TAILS), 255, 10).ready()
    model.weights = lm.first_weights(model)
    sizes = np.array([100] * 20 + [400] + [100] * 20)
    ids, klass, entry = model.encode([words[i] for i in np.random.default_rng(2).integers(0, 10, sizes.sum())])
    real, lanes = lm._states, []
    monkeypatch.setattr(lm, "_states", lambda w, entry, on, h, lives: lanes.extend(lives) or real(w, entry, on, h, lives))
    found = lm.score_texts(model, ids, klass, entry, sizes)
    assert sum(lanes) == sizes.sum() and min(lanes) > 5
    at = [slice(e - n, e) for e, n in zip(np.cumsum(sizes), sizes)]
    assert np.allclose(found, [lm.score_texts(model, ids[x], klass[x], entry[x], np.array([len(ids[x])]))[0] for x in at], rtol=1e-5)


def test_language_model_words_are_cut_as_elsewhere():
    """op1_lm_scoring: Arrow's pieces are the words between ASCII white space, lower-cased in A-Z only."""
    texts = [" A\x0bb\x1cc\x85d\xa0e \xc9  X\t\n", None, "", " ", "\x0c\r", "\xc0Z\x00q\x1f zİ"]
    words, sizes = lm.arrow_words(pa.array([None, *texts], pa.string()).slice(1))
    flat, counts = split_words(texts)
    assert words.to_pylist() == flat and sizes.tolist() == counts.tolist() == [3, 0, 0, 0, 0, 2]


def test_language_model_numbers_words_by_arrays():
    """op1_lm_scoring: an array's words get the numbers and tail classes that each of them has by itself."""
    rng = random.Random(6)
    rare = [bytes(rng.randrange(128, 256) for _ in range(n)) for n in (1, 2, 3, 1, 7) for _ in range(40)]
    words = [lm.END, *(b"w%d" % i for i in range(30))]
    model = lm.Model(words, np.arange(60, 29, -1), np.array([0, 4, 12]), np.zeros(lm.TAILS), 100, 31).ready()
    got = model.codes(pa.array([b"first", *rare, *words, b"w"], pa.binary()).slice(1))
    assert got.tolist() == [31 + lm.tail_class(w) for w in rare] + list(range(31)) + [31 + lm.tail_class(b"w")]
    assert model.klass[12:31].tolist() == [2 + lm.tail_class(w) for w in words[12:]]
