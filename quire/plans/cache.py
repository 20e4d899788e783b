"""Queries over the library, its cache and the progress of rendering, all bound to the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import library
from quire.plans.base import bind
from quire.sources import views as v
from quire.sources.views import read
from quire.streaming import progress


def _meta(spark, d):
    return v.v_render(spark, d).where("status = 'rendered'").select(F.col("doc_id").alias("hash"), "chunk_index", "frames", (F.col("frames") * 1200).alias("bytes"))


_META = "meta AS (SELECT doc_id AS hash, chunk_index, frames, frames * 1200 AS bytes FROM v_render WHERE status = 'rendered')"


@bind("library_list", f"WITH {_META} SELECT l.hash, l.opened, coalesce(sum(m.bytes), 0)::BIGINT AS bytes, count(m.hash) AS chunks FROM v_library l LEFT JOIN meta m ON l.hash = m.hash GROUP BY l.hash, l.opened")
def _(spark, d):
    return library.library_list(v.v_library(spark, d).select("hash", "opened"), _meta(spark, d))


@bind("rendered_chunks", f"WITH {_META} SELECT hash, chunk_index, frames, bytes FROM meta WHERE hash = (SELECT min(hash) FROM v_library)")
def _(spark, d):
    return library.rendered_chunks(_meta(spark, d), v.v_library(spark, d).agg(F.min("hash")).first()[0])


@bind("lru_evict", """WITH t AS (SELECT hash, bytes, opened, sum(bytes) OVER () AS total FROM v_library), f AS (SELECT *, coalesce(sum(bytes) OVER (ORDER BY opened, hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t WHERE hash <> (SELECT min(hash) FROM t))
    SELECT hash FROM f WHERE total - before > (SELECT sum(bytes) / 2 FROM v_library)""")
def _(spark, d):
    lib = v.v_library(spark, d)
    cap, keep = lib.agg(F.sum("bytes") / 2, F.min("hash")).first()
    return library.lru_evict(lib, cap, keep)


@bind("usage", f"WITH {_META} SELECT sum(bytes)::BIGINT AS bytes FROM meta")
def _(spark, d):
    return library.usage(_meta(spark, d))


def _touches(spark, d):
    return read(spark, d, "events").select(F.col("user_id").alias("hash"), F.unix_micros(F.col("ts").cast("timestamp")).alias("opened"), "event_id", "event_type")


@bind("touch", "SELECT user_id AS hash, epoch_us(ts) AS opened, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def _(spark, d):
    t = _touches(spark, d)
    return library.touch(t.where("event_id % 3 = 0"), t.where("event_id % 3 <> 0"), ["opened", "event_id"])


@bind("remove_cascade", f"WITH {_META} SELECT * FROM meta WHERE hash NOT IN (SELECT user_id FROM events WHERE event_type = 'signup')")
def _(spark, d):
    return library.remove_cascade(_meta(spark, d), read(spark, d, "events").where("event_type = 'signup'").select(F.col("user_id").alias("hash")))


def _incoming(spark, d):
    return read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("hash"), F.when(F.col("doc_id") % 10 == 0, 2).otherwise(1).alias("version"), F.lit("a").alias("voice"))


_INCOMING = "incoming AS (SELECT doc_id, sha256(text) AS hash, CASE WHEN doc_id % 10 = 0 THEN 2 ELSE 1 END AS version FROM documents), lib AS (SELECT DISTINCT hash FROM incoming WHERE doc_id % 2 = 0)"


def _shelf(spark, d):
    return _incoming(spark, d).where("doc_id % 2 = 0").select("hash", F.lit(1).alias("version"), "voice").distinct()


@bind("cache_hits", f"WITH {_INCOMING} SELECT doc_id, hash FROM incoming WHERE version = 1 AND hash IN (SELECT hash FROM lib)")
def _(spark, d):
    return library.cache_hits(_incoming(spark, d), _shelf(spark, d)).select("doc_id", "hash")


@bind("to_import", f"WITH {_INCOMING} SELECT doc_id, hash FROM incoming WHERE NOT (version = 1 AND hash IN (SELECT hash FROM lib))")
def _(spark, d):
    return library.to_import(_incoming(spark, d), _shelf(spark, d)).select("doc_id", "hash")


@bind("import_report", r"""SELECT doc_id, 'violations' AS kind, count(*) AS n FROM v_blocks WHERE n_tokens > 6 GROUP BY doc_id
    UNION ALL SELECT doc_id, 'unknown symbols', sum(len(regexp_extract_all(token, '[0-9]')))::BIGINT FROM v_tokens GROUP BY doc_id HAVING sum(len(regexp_extract_all(token, '[0-9]'))) > 0
    UNION ALL SELECT doc_id, 'over budget', count(*) FROM v_tokens WHERE length(token) > 20 GROUP BY doc_id""")
def _(spark, d):
    t = v.v_tokens(spark, d)
    bad = v.v_blocks(spark, d).where("n_tokens > 6").groupBy("doc_id").agg(F.lit("violations").alias("kind"), F.count("*").alias("n"))
    unknown = t.groupBy("doc_id").agg(F.lit("unknown symbols").alias("kind"), F.sum(F.regexp_count("token", F.lit("[0-9]"))).alias("n")).where("n > 0")
    over = t.where(F.length("token") > 20).groupBy("doc_id").agg(F.lit("over budget").alias("kind"), F.count("*").alias("n"))
    return bad.unionByName(unknown).unionByName(over)


_DONE = "done AS (SELECT doc_id, chunk_index, min(seq) AS seq, arg_min(frames, seq) AS frames, max(total_chunks) AS total FROM v_render WHERE status = 'rendered' GROUP BY doc_id, chunk_index), whole AS (SELECT *, chunk_index = row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) - 1 AS w FROM done)"


@bind("render_progress", f"WITH {_DONE} SELECT doc_id, count_if(w)::BIGINT AS prefix, coalesce(sum(frames) FILTER (WHERE w), 0)::BIGINT AS frames, coalesce(sum(frames) FILTER (WHERE w), 0) / 40 AS seconds, count_if(w) = max(total) AS complete FROM whole GROUP BY doc_id")
def _(spark, d):
    return progress.render_progress(v.v_render(spark, d))


@bind("dedupe_requests", "SELECT doc_id, chunk_index, min(seq) AS seq FROM v_render GROUP BY doc_id, chunk_index")
def _(spark, d):
    return progress.dedupe_requests(v.v_render(spark, d))


@bind("deferred_first", "SELECT c.doc_id, c.chunk_index, row_number() OVER (PARTITION BY c.doc_id ORDER BY (e.doc_id IS NOT NULL)::INT DESC, c.chunk_index) AS rank FROM (SELECT DISTINCT doc_id, chunk_index FROM v_render) c LEFT JOIN (SELECT DISTINCT doc_id, chunk_index FROM v_render WHERE status = 'failed') e ON c.doc_id = e.doc_id AND c.chunk_index = e.chunk_index")
def _(spark, d):
    r = v.v_render(spark, d)
    return progress.deferred_first(r.select("doc_id", "chunk_index").distinct(), r.where("status = 'failed'"))


@bind("failure_breaker", """WITH r AS (SELECT doc_id, seq, status, seq - row_number() OVER (PARTITION BY doc_id, status ORDER BY seq) AS g FROM v_render), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, status, g ORDER BY seq) AS nth FROM r)
    SELECT doc_id, min(seq) AS failed_at FROM n WHERE status = 'failed' AND nth >= 3 GROUP BY doc_id""")
def _(spark, d):
    return progress.failure_breaker(v.v_render(spark, d))


@bind("lookahead", "WITH c AS (SELECT doc_id, max(seq) // 2 AS cursor FROM v_render GROUP BY doc_id) SELECT DISTINCT r.doc_id, r.chunk_index FROM v_render r JOIN c ON r.doc_id = c.doc_id WHERE r.chunk_index >= cursor AND r.chunk_index < cursor + 8")
def _(spark, d):
    r = v.v_render(spark, d)
    return progress.lookahead(r.select("doc_id", "chunk_index").distinct(), r.groupBy("doc_id").agg(F.expr("max(seq) div 2").alias("cursor")))


@bind("priming", f"WITH {_DONE}, t AS (SELECT *, sum(frames) OVER o AS through, max(seq) OVER o AS due FROM whole WHERE w WINDOW o AS (PARTITION BY doc_id ORDER BY chunk_index)) SELECT doc_id, min(due) AS ready_at FROM t WHERE through >= 100 OR chunk_index + 1 = total GROUP BY doc_id")
def _(spark, d):
    return progress.priming(v.v_render(spark, d), 100)


@bind("ready_to_resume", "WITH c AS (SELECT doc_id, chunk_index, bool_or(status = 'rendered') AS rendered FROM v_render GROUP BY doc_id, chunk_index) SELECT *, rendered AND coalesce(lead(rendered) OVER (PARTITION BY doc_id ORDER BY chunk_index), true) AS ready FROM c")
def _(spark, d):
    r = v.v_render(spark, d).groupBy("doc_id", "chunk_index").agg(F.bool_or(F.col("status") == "rendered").alias("rendered"))
    return progress.ready_to_resume(r)
