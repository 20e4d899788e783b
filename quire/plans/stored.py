"""Queries that write to the shared folder and read back, and those that run as streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quire.operators.windows import shared_folder
from quire.plans.base import bind
from quire.sources import store
from quire.sources import views as v
from quire.sources.views import read
from quire.streaming import progress
from quire.streaming.replay import emitted, latest, replay


def _place(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _keyed(spark, d):
    hashes = read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    return v.v_blocks(spark, d).join(hashes, "doc_id").select("hash", "doc_id", "block_idx", "role", "n_tokens")


@bind("sidecar_write", "SELECT role, count(*) AS n FROM v_blocks GROUP BY role")
def _(spark, d):
    path = _place(spark, "sidecar")
    store.sidecar_write({"blocks": _keyed(spark, d)}, path, 3, "a")
    return spark.read.parquet(f"{path}/blocks").groupBy("role").agg(F.count("*").alias("n"))


@bind("sidecar_read", "SELECT doc_id, block_idx, role, n_tokens FROM v_blocks")
def _(spark, d):
    path = _place(spark, "sidecar")
    store.sidecar_write({"blocks": _keyed(spark, d)}, path, 3, "a")
    wanted = read(spark, d, "documents").select(F.sha2("text", 256).alias("hash"))
    return store.sidecar_read(spark, path, "blocks", 3, "a", wanted).select("doc_id", "block_idx", "role", "n_tokens")


@bind("originals_store", "SELECT sha256(text) AS hash, max(strlen(text)) AS size FROM documents GROUP BY 1")
def _(spark, d):
    path = _place(spark, "originals")
    docs = read(spark, d, "documents").select(F.col("text").alias("content"))
    store.originals_store(docs, path)
    return store.originals_read(spark, path, docs.select(F.sha2("content", 256).alias("hash"))).select("hash", F.octet_length("bytes").cast("long").alias("size"))


@bind("vocab_load", "SELECT source AS symbol, dense_rank() OVER (ORDER BY source)::INT AS id FROM (SELECT DISTINCT source FROM documents)")
def _(spark, d):
    # a vocabulary of the sources' names, written as JSON the way tokenizers have it
    path = _place(spark, "vocabulary")
    names = read(spark, d, "documents").select("source").distinct().agg(F.array_sort(F.collect_list("source")).alias("s"))
    vocab = F.map_from_entries(F.transform("s", lambda x, i: F.struct(x, (i + 1).cast("string"))))
    names.select(F.to_json(F.struct(F.struct(F.map_concat(vocab, F.create_map(F.lit("odd"), F.lit("none"))).alias("vocab")).alias("model"))).alias("value")).coalesce(1).write.text(path)
    return store.vocab_load(spark, path, {"a": 1})


def _arriving(spark, d):
    """Render events with the time at which they come."""
    return v.v_render(spark, d).join(read(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("at")), "event_id")


def _span(events) -> str:
    """A watermark's delay that all events fit in."""
    first, last = events.agg(F.min("at"), F.max("at")).first()
    return f"{(last - first).days + 2 if first else 1} days"


@bind("timeline_updates", "SELECT user_id AS doc_id, count(*) AS chunks, sum(20 + floor(value))::BIGINT AS frames FROM events GROUP BY user_id")
def _(spark, d):
    """Totals as lengths stream in: a micro-batch, which is the throttle, writes the documents that it touches, and the
    last one is forced by the end of the input."""
    path = _place(spark, "updates")
    totals = lambda e: e.groupBy(F.col("user_id").alias("doc_id")).agg(F.count("*").alias("chunks"), F.sum(20 + F.floor("value")).alias("frames"))
    replay(read(spark, d, "events").select("user_id", "value", "ts"), "ts", path, totals, "update")
    return latest(spark, path, ["doc_id"])


@bind("online_calibration", "SELECT user_id AS doc_id, round(sum(20 + floor(value)) / sum(30 + event_id % 40), 6) AS scale FROM events WHERE event_type <> 'error' GROUP BY user_id")
def _(spark, d):
    path = _place(spark, "scales")
    pairs = read(spark, d, "events").where("event_type <> 'error'").select(F.col("user_id").alias("doc_id"), (30 + F.col("event_id") % 40).alias("estimated"), (20 + F.floor("value")).alias("actual"), "ts")
    replay(pairs, "ts", path, progress.online_calibration, "update")
    return latest(spark, path, ["doc_id"]).withColumn("scale", F.round("scale", 6))


_DONE = "done AS (SELECT doc_id, chunk_index, min(seq) AS seq, arg_min(frames, seq) AS frames, max(total_chunks) AS total FROM v_render WHERE status = 'rendered' GROUP BY doc_id, chunk_index), whole AS (SELECT *, chunk_index = row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) - 1 AS w FROM done)"


@bind("render_progress_stream", f"WITH {_DONE} SELECT doc_id, count_if(w)::BIGINT AS prefix, coalesce(sum(frames) FILTER (WHERE w), 0)::BIGINT AS frames, coalesce(sum(frames) FILTER (WHERE w), 0) / 40 AS seconds, count_if(w) = max(total) AS complete FROM whole GROUP BY doc_id")
def _(spark, d):
    path = _place(spark, "progress")
    replay(_arriving(spark, d), "at", path, progress.progress_stream, "update")
    return latest(spark, path, ["doc_id"])


@bind("failure_breaker_stream", """WITH r AS (SELECT doc_id, seq, status, seq - row_number() OVER (PARTITION BY doc_id, status ORDER BY seq) AS g FROM v_render), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, status, g ORDER BY seq) AS nth FROM r),
    f AS (SELECT doc_id, min(seq) AS failed_at FROM n WHERE status = 'failed' AND nth >= 3 GROUP BY doc_id)
    SELECT v.doc_id, seq, chunk_index, status, coalesce(seq = failed_at, false) AS opened FROM v_render v LEFT JOIN f ON v.doc_id = f.doc_id WHERE failed_at IS NULL OR seq <= failed_at""")
def _(spark, d):
    path = _place(spark, "breaker")
    replay(_arriving(spark, d), "at", path, progress.breaker_stream, "append")
    return emitted(spark, path).drop("batch")


@bind("dedupe_requests_stream", "SELECT DISTINCT doc_id, chunk_index FROM v_render")
def _(spark, d):
    path, events = _place(spark, "requests"), _arriving(spark, d)
    replay(events, "at", path, lambda e, delay=_span(events): progress.dedupe_requests(e.withWatermark("at", delay)).select("doc_id", "chunk_index"), "append")
    return emitted(spark, path).drop("batch")


@bind("lookahead_stream", "WITH c AS (SELECT DISTINCT doc_id, seq // 2 AS cursor FROM v_render) SELECT DISTINCT r.doc_id, r.chunk_index FROM v_render r JOIN c ON r.doc_id = c.doc_id WHERE r.chunk_index >= cursor AND r.chunk_index < cursor + 8")
def _(spark, d):
    path, events = _place(spark, "lookahead"), _arriving(spark, d)
    v.v_render(spark, d).select("doc_id", "chunk_index").distinct().write.parquet(f"{path}/chunks")

    def ahead(stream, delay=_span(events)):
        cursors = stream.select("doc_id", F.expr("seq div 2").alias("cursor"), "at").withWatermark("at", delay)
        return progress.lookahead_stream(cursors, stream.sparkSession.read.parquet(f"{path}/chunks"))

    replay(events, "at", path, ahead, "append")
    return emitted(spark, path).drop("batch")


@bind("priming_stream", f"WITH {_DONE}, t AS (SELECT *, sum(frames) OVER o AS through, max(seq) OVER o AS due FROM whole WHERE w WINDOW o AS (PARTITION BY doc_id ORDER BY chunk_index)) SELECT doc_id, min(due) AS ready_at FROM t WHERE through >= 100 OR chunk_index + 1 = total GROUP BY doc_id")
def _(spark, d):
    path = _place(spark, "priming")
    replay(_arriving(spark, d), "at", path, lambda e: progress.priming_stream(e, 100), "append")
    return emitted(spark, path).drop("batch")
