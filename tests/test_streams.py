"""Streams over several micro-batches and restarts against the batch forms, and what each micro-batch writes."""

import random

import pytest
from pyspark.sql import functions as F

from quire.streaming import progress, replay

SCHEMA = "doc_id long, seq long, chunk_index int, status string, frames long, total_chunks long, at timestamp"


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(1)
    data = []
    for doc in range(12):
        n = rng.randrange(4, 30)
        for i in range(n * 2):
            status = "failed" if rng.random() < (0.6 if doc % 3 == 0 else 0.2) else rng.choice(["rendered", "rendered", "rendered", "skipped"])
            data.append((doc, i, min(n - 1, rng.choice([i, i // 2, i // 2])), status, rng.randrange(1, 60), n, 1_700_000_000 + 60 * i + doc))
    data.append((77, 0, 0, "failed", 1, 3, 1_700_000_000))
    return spark.createDataFrame(data, SCHEMA.replace("at timestamp", "t long")).withColumn("at", F.timestamp_seconds("t")).drop("t")


def played(events, path, make, mode, parts=4):
    replay.replay(events, "at", str(path), make, mode, parts)
    return replay.emitted(events.sparkSession, str(path))


def test_progress(spark, events, tmp_path):
    out = played(events, tmp_path, progress.progress_stream, "update")
    assert out.select("batch").distinct().count() == 4
    columns = ("doc_id", "prefix", "frames", "seconds", "complete")
    last = replay.latest(spark, str(tmp_path), ["doc_id"])
    assert rows(last, *columns) == rows(progress.render_progress(events), *columns)


def test_an_update_touches_only_the_documents_of_its_events(spark, events, tmp_path):
    replay.drain(progress.progress_stream(arriving(spark, events.where("seq < 6"), tmp_path)), str(tmp_path), "update")
    replay.drain(progress.progress_stream(arriving(spark, events.where("seq >= 6 and doc_id in (3, 5)"), tmp_path)), str(tmp_path), "update")
    second = replay.emitted(spark, str(tmp_path)).where("batch = 1")
    assert rows(second, "doc_id") == [(3,), (5,)]


def arriving(spark, lot, path):
    """A stream over what has come to the folder, with another lot."""
    lot.write.mode("append").parquet(f"{path}/in")
    return replay.stream_session(spark).readStream.schema(lot.schema).parquet(f"{path}/in")


def test_priming_comes_once(events, tmp_path):
    out = played(events, tmp_path, lambda e: progress.priming_stream(e, 40), "append")
    assert rows(out, "doc_id", "ready_at") == rows(progress.priming(events, 40), "doc_id", "ready_at")
    assert out.count() > 1


def test_breaker_cuts_what_comes_later(events, tmp_path):
    out = played(events, tmp_path, progress.breaker_stream, "append")
    failed = {r["doc_id"]: r["failed_at"] for r in progress.failure_breaker(events).collect()}
    assert failed and rows(out.where("opened"), "doc_id", "seq") == sorted(failed.items())
    passed = [r for r in events.collect() if r["seq"] <= failed.get(r["doc_id"], 10**9)]
    assert rows(out, "doc_id", "seq") == sorted((r["doc_id"], r["seq"]) for r in passed)


def test_breaker_goes_on_from_its_checkpoint(spark, tmp_path):
    def lot(*items):
        return spark.createDataFrame([(1, i, 0, s, 1, 9) for i, s in items], "doc_id long, seq long, chunk_index int, status string, frames long, total_chunks long")

    for items in ([(0, "failed"), (1, "failed")], [(2, "rendered"), (3, "failed")], [(4, "skipped"), (5, "failed")], [(6, "failed"), (7, "rendered")], [(8, "rendered")]):
        replay.drain(progress.breaker_stream(arriving(spark, lot(*items), tmp_path)), str(tmp_path), "append")
    assert rows(replay.emitted(spark, str(tmp_path)), "seq", "opened") == [(i, i == 6) for i in range(7)]


def test_a_repeated_micro_batch_replaces_what_it_has_written(spark, events, tmp_path):
    stream = progress.breaker_stream(arriving(spark, events, tmp_path))
    replay.drain(stream, str(tmp_path), "append")
    before = rows(replay.emitted(spark, str(tmp_path)), "doc_id", "seq")
    # the micro-batch has been written, but its end is not in the log
    (next((tmp_path / "state/commits").glob("0"))).unlink()
    (next((tmp_path / "state/commits").glob(".0.crc"))).unlink()
    replay.drain(progress.breaker_stream(replay.stream_session(spark).readStream.schema(events.schema).parquet(f"{tmp_path}/in")), str(tmp_path), "append")
    assert rows(replay.emitted(spark, str(tmp_path)), "doc_id", "seq") == before


def test_late_and_repeated_requests(spark, tmp_path):
    def lot(*items):
        return spark.createDataFrame([(1, c, m) for c, m in items], "doc_id long, chunk_index int, m long").select("doc_id", "chunk_index", F.timestamp_seconds(1_700_000_000 + F.col("m") * 60).alias("at"))

    def drain(*items):
        stream = arriving(spark, lot(*items), tmp_path).withWatermark("at", "10 minutes")
        replay.drain(progress.dedupe_requests(stream).select("doc_id", "chunk_index"), str(tmp_path), "append")

    drain((1, 0), (1, 1), (2, 1))
    drain((1, 5), (3, 60))  # repeated within the watermark: dropped
    drain((4, 20), (2, 61))  # 4 is 40 minutes late: dropped; 2 is asked for anew after its state has gone
    assert rows(replay.emitted(spark, str(tmp_path)), "chunk_index") == [(1,), (2,), (2,), (3,)]


def test_lookahead_of_moving_cursors(spark, events, tmp_path):
    chunks = events.select("doc_id", "chunk_index").distinct()
    chunks.write.parquet(f"{tmp_path}/chunks")

    def ahead(e):
        cursors = e.select("doc_id", F.expr("seq div 4").alias("cursor"), "at").withWatermark("at", "2 days")
        return progress.lookahead_stream(cursors, e.sparkSession.read.parquet(f"{tmp_path}/chunks"), 3)

    out = played(events, tmp_path, ahead, "append")
    want = {(r["doc_id"], c) for r in events.collect() for c in range(r["seq"] // 4, r["seq"] // 4 + 3)} & {tuple(r) for r in chunks.collect()}
    assert rows(out, "doc_id", "chunk_index") == sorted(want)


def test_streams_leave_the_session_alone(spark, events, tmp_path):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.streaming.stateStore.providerClass")}
    assert replay.stream_session(spark).conf.get("spark.sql.streaming.stateStore.providerClass") == replay.ROCKSDB
    assert {k: spark.conf.get(k) for k in before} == before


def test_nothing_arrives(spark, events, tmp_path):
    assert played(events.limit(0), tmp_path, progress.progress_stream, "update").count() == 0
