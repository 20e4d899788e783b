"""What the findings of round 3 asked for."""

from pyspark.sql import functions as F

from quire.operators import furniture, layout, paragraphs, timeline, timing, words
from quire.plans import all_queries, all_sql


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_prefetch_tells_each_released_chunk(spark):
    chunks = spark.createDataFrame([(1, i, 100 * i, 100 * i + 100) for i in range(100)], "doc_id long, chunk_idx int, offset int, end int")
    even = spark.createDataFrame([(1, i) for i in range(0, 100, 2)], "doc_id long, chunk_idx int")
    positions = spark.createDataFrame([(7, 1, 2000)], "event_id int, doc_id long, t_frame int")
    got = timeline.prefetch_rows(timeline.prefetch_window(positions, chunks, chunks.select("doc_id", "chunk_idx"), even), chunks, even)
    want = [(7, i, "load") for i in range(12, 80) if i % 2] + [(7, i, "release") for i in range(0, 100, 2) if i < 12 or i >= 80]
    assert rows(got, "event_id", "chunk_idx", "action") == sorted(want)
    assert "min(chunk_idx)" not in all_sql()["prefetch_window"]


def test_a_note_line_that_opens_with_a_number(spark, tmp_path):
    """The words of a note's second line may open with a number: it is no label."""
    tokens = ["word"] * 400
    for line in (37, 39):
        tokens[10 * line] = "12"
    spark.createDataFrame([(1, " ".join(tokens), "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    line = "word " * 9 + "word"
    want = [(i, str(1 + i), f"{line} 12 " + ("word " * 9).strip()) for i in range(2)]
    assert rows(all_queries()["note_bodies"](spark, str(tmp_path)), "note_id", "label", "text") == want
    paired = all_queries()["pair_notes"](spark, str(tmp_path))
    assert [n for _, n in rows(paired, "marker", "note_id")] == [0, 1, None, None, None]


def test_letters_are_not_shuffled(spark, capsys):
    for name in ("char_runs", "frame_symbols", "dedupe_overstrike"):
        all_queries()[name](spark, "/root/testdata/sf0.001").explain()
        plan = capsys.readouterr().out
        assert plan.count("- Exchange ") == plan.count("REPARTITION_BY_NUM") > 0, name


def test_the_gutter_of_a_wide_page(spark):
    """Work grows with segments, not with the width between them."""
    seg = [(1, 0, x, x + 4e8, 100.0 - 14 * k, 110.0 - 14 * k, 102.0 - 14 * k, 10.0) for k in range(4) for x in (0.0, 6e8)]
    table = spark.createDataFrame(seg, "doc_id long, page_index int, x0 double, x1 double, y0 double, y1 double, baseline double, height double")
    x, width = layout.find_gutter(table).select("x", "width").first()
    assert (x, width) == (5e8 + 0.5, 2e8 - 1)
    assert {(r["x0"], r["region"]) for r in layout.reading_regions(table).collect()} == {(0.0, "00000.1/"), (6e8, "00000.2/")}


def test_timeline_of_symbols_with_arrays(spark, capsys):
    frames = spark.createDataFrame([(1, 0, 0, p, f) for p, f in enumerate((1, 3, 2, 4, 1))], "doc_id long, block_idx int, chunk_idx int, pos int, frames int")
    words = spark.createDataFrame([(1, 0, 0, 0, 0, 2), (1, 0, 0, 1, 2, 3), (1, 0, 0, 2, 3, 3), (1, 0, 0, 3, 8, 9)], "doc_id long, block_idx int, chunk_idx int, token_idx int, lo int, hi int")
    start = spark.createDataFrame([(1, 0, 0, 100)], "doc_id long, block_idx int, chunk_idx int, start long")
    told = timing.word_timeline(start, frames, words)
    assert rows(told, "token_idx", "start_frame", "end_frame") == [(0, 101, 106), (1, 106, 110), (2, 110, 110)]
    told.explain()
    assert "_p#" not in capsys.readouterr().out  # no symbol is joined by its place


def test_nearest_word_shuffles_no_words(spark, capsys):
    """Words that are dealt by document are met in place; a page's clicks go in several lots."""
    boxes = spark.createDataFrame([(1, p, t, 10.0 * t, 2.0, 100.0 * p, 2.0) for p in range(2) for t in range(50)], "doc_id long, page_index int, token_idx int, x double, width double, y double, height double")
    clicks = spark.createDataFrame([(c, 1, c % 2, c % 500 + 0.5, 101.0) for c in range(6000)], "click long, doc_id long, page_index int, cx double, cy double")
    told = timeline.nearest_word(clicks, boxes.repartition(16, "doc_id"))
    # a click in the middle between two words goes to the first
    want = [(c, c % 2, min(range(50), key=lambda t: (abs(10 * t + 1 - (c % 500 + 0.5)), t))) for c in range(6000)]
    assert rows(told, "click", "page_index", "token_idx") == want
    told.explain()
    plan = capsys.readouterr().out
    assert "(wx" not in plan and not [line for line in plan.splitlines() if "Exchange" in line and "page_index" in line and "_w" in line]
    assert "Checkpoint" not in plan and "ExistingRDD[click" in plan and "sx" not in plan


def test_punctuation_is_attached_without_joins(spark, capsys):
    """A row ends where two words stand side by side; groups are numbered on over rows."""
    text = ["word"] * 1500 + ['"', "quoted", ",", "(", "end"]
    table = spark.createDataFrame([(1, i // 10, i, t, 22.0 * (i % 10), 20.0) for i, t in enumerate(text)], "doc_id long, line_key long, token_idx int, token string, x double, width double")
    told = paragraphs.attach_punctuation(table)
    assert rows(told, "group", "token", "n_boxes") == [(i, "word", 1) for i in range(1500)] + [(1500, '"quoted,', 3), (1501, "(end", 2)]
    told.explain()
    assert "Join" not in capsys.readouterr().out


def test_words_of_blocks_are_cut_in_place(spark, capsys):
    for name in ("split_long", "uniform_chunks", "chunk_documents"):
        all_queries()[name](spark, "/root/testdata/sf0.001").explain()
        plan = capsys.readouterr().out
        assert "aggregate(" not in plan, name
        if name != "chunk_documents":
            assert "Join" not in plan and plan.count("- Exchange ") == plan.count("REPARTITION_BY_NUM") > 0, name


def test_lines_meet_their_columns_measures_in_place(spark, capsys):
    lines = spark.createDataFrame([(1, 0, 0, i, 72.0, 300.0, 700.0 - 15 * i, 10.0, 9, "some text") for i in range(8)], "doc_id long, page_index int, col int, line int, x0 double, x1 double, baseline double, height double, n_runs long, text string")
    told = paragraphs.paragraph_breaks(lines)
    assert rows(told, "line", "starts") == [(i, i == 0) for i in range(8)]
    told.explain()
    assert "Join" not in capsys.readouterr().out


def test_gaps_of_columns_shuffle_pages_not_words(spark, capsys):
    all_queries()["column_gap_histogram"](spark, "/root/testdata/sf0.001").explain()
    plan = capsys.readouterr().out
    assert plan.count("Join") == 1 and "bin#" not in plan


def test_plain_letters_with_one_accent(spark, capsys):
    table = spark.createDataFrame([(w,) for w in ("caf´e", "cafe´", "´ıx", "¸cx", "q´", "´q")], "w string").select("w", words.clean_word(F.col("w")).alias("c"))
    assert [r.c for r in table.collect()] == ["café", "café", "íx", "çx", "q́", "q́"]
    table.explain()
    assert f"[A-Za-z{''.join(words.DOTLESS)}]" in capsys.readouterr().out  # told without the maps of all scripts
