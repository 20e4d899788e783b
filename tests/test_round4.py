"""What the findings of round 4 asked for."""

import random

from quire.operators import reflow, timing
from quire.plans import all_queries


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def documents(spark, path, texts):
    data = [(i, text, "en", "s", 1) for i, text in texts]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")


def test_word_timeline_shuffles_texts_only(spark, tmp_path, capsys):
    """Neither symbols nor words are shuffled or joined; a chunk's stay in its row."""
    long = " ".join("abz9ß😀"[: 1 + i % 6] for i in range(150))
    texts = [(1, long), (2, "one"), (3, ""), (4, None), (None, "lost"), (5, " " + "q" * 5000 + "\n\n😀 é "), (6, " ".join(["ab"] * 60)), (7, " ".join(["ab"] * 61))]
    documents(spark, tmp_path, texts)
    told = all_queries()["word_timeline"](spark, str(tmp_path))
    want = []
    for doc, text in texts:
        words, at = (text or "").split(), 0
        for k in range(0, len(words), 60):
            at += 1
            for i, word in enumerate(words[k : k + 60], k):
                start, at = at, at + sum(2 + "_abcdefghijklmnopqrstuvwxyz".find(c, 1) % 3 if c.isascii() and c.islower() else 2 for c in word)
                want.append((doc, i, start, at))
            at += 1
    assert rows(told, "doc_id", "token_idx", "start_frame", "end_frame") == sorted(w for w in want if w[0] is not None)
    told.explain()
    plan = capsys.readouterr().out
    assert plan.count("- Exchange ") == plan.count("REPARTITION_BY_NUM") == 1 and "Join" not in plan and "Aggregate" not in plan


def test_words_of_several_chunks_are_timed_at_once(spark):
    """A chunk's symbols may come in any order and have gaps; words beyond them are dropped, whatever the next chunk has."""
    chunks = [(1, 0, 100, [2, 0, 1, 3, 4], [2, 1, 3, 4, 1], [0, 1, 2, 3], [0, 2, 3, 8], [2, 3, 3, 9]), (1, 1, 50, [], [], [7], [0], [1]), (2, 0, 0, [0, 1, 3], [1, 5, 7], [4, 5, 6], [0, 1, 2], [1, 2, 3]), (3, 0, 9, [0], [1], [], [], [])]
    table = spark.createDataFrame(chunks, "doc_id long, block_idx int, start long, pos array<int>, frames array<int>, token_idx array<int>, lo array<int>, hi array<int>").coalesce(1)
    told = timing.timed_words(table)
    assert rows(told, "doc_id", "token_idx", "start_frame", "end_frame") == [(1, 0, 101, 106), (1, 1, 106, 110), (1, 2, 110, 110), (2, 4, 1, 6), (2, 6, 6, 13)]


def test_reflow_check_holds_tokens_against_texts_in_place(spark, tmp_path, capsys):
    """Tokens and texts are dealt by document and meet there: neither is shuffled again, and no text is broadcast."""
    documents(spark, tmp_path, [(1, "ab 😀 cd\n\n\né " + "y" * 900 + " z"), (2, None), (3, " \n "), (None, "lost words"), (4, "plain text\nof lines")])
    told = all_queries()["reflow_check"](spark, str(tmp_path))
    assert told.count() == 0
    told.explain()
    plan = capsys.readouterr().out
    assert plan.count("- Exchange ") == plan.count("REPARTITION_BY_NUM") == 2 and plan.count("Join") == plan.count("SortMergeJoin") == 1
    assert "Broadcast" not in plan and "token_idx#" not in "".join(line for line in plan.splitlines() if "collect_list" in line)


def test_reflow_check_against_slices_of_units(spark):
    """Texts with and without characters beyond the basic plane, moved in places; tokens end within, at and beyond blocks."""
    rng = random.Random(4)
    cut = lambda text, at, n: text.encode("utf-16-le")[2 * at : 2 * (at + n)]
    tokens = [(doc, i // 40, i % 40, "".join(rng.choice("abé末" + "😀" * (doc % 2)) for _ in range(rng.choice((1, 2, 5, 9, 255, 256, 257, 511, 800) if doc > 2 else (1, 4, 7))))) for doc in range(6) for i in range(300)]
    offsets = reflow.reflow_offsets(spark.createDataFrame(tokens, "doc_id long, block_idx int, token_idx int, token string"))
    texts = {r["doc_id"]: r["text"] for r in reflow.reflow_text(offsets).collect()}
    assert reflow.reflow_check(offsets, spark.createDataFrame(list(texts.items()), "doc_id long, text string")).count() == 0
    for doc, text in texts.items():
        at = sorted(rng.sample(range(len(text)), 3))
        texts[doc] = text[: at[0]] + ("#" if doc < 2 else "") + text[at[0] : at[1]] + "?" + text[at[1] + 1 : len(text) if doc % 3 else at[2]]
    texts[5] = texts[5].replace("😀", "x")  # tokens have what no text has
    del texts[2]
    told = reflow.reflow_check(offsets, spark.createDataFrame([*texts.items(), (2, None)], "doc_id long, text string"))
    want = [(r["doc_id"], r["block_idx"], r["token_idx"]) for r in offsets.collect() if r["doc_id"] in texts and cut(texts[r["doc_id"]], r["loc"], r["len"]) != r["token"].encode("utf-16-le")]
    assert rows(told, "doc_id", "block_idx", "token_idx") == sorted(want) and len(want) > 200
