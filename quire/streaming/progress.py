"""Progress of rendering: batch forms of the operators, and their streaming forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.operators.windows import islands

FRAMES_A_SECOND, MOST_FAILURES, LOOKAHEAD = 40, 3, 8
#: Waiting chunks of a document that are read and written together.
BLOCK = 256


def render_progress(events: DataFrame) -> DataFrame:
    """doc_id, prefix (chunks rendered without a hole from the first), frames, seconds, complete, from render events."""
    done = events.where("status = 'rendered'").groupBy("doc_id", "chunk_index").agg(F.min("seq").alias("seq"), F.min_by("frames", "seq").alias("frames"), F.max("total_chunks").alias("total"))
    along = W.partitionBy("doc_id").orderBy("chunk_index")
    done = done.withColumn("whole", F.col("chunk_index") == F.row_number().over(along) - 1)
    out = done.groupBy("doc_id").agg(F.count_if("whole").alias("prefix"), F.coalesce(F.sum(F.when(F.col("whole"), F.col("frames"))), F.lit(0)).alias("frames"), F.max("total").alias("total"))
    return out.select("doc_id", "prefix", "frames", (F.col("frames") / FRAMES_A_SECOND).alias("seconds"), (F.col("prefix") == F.col("total")).alias("complete"))


def dedupe_requests(requests: DataFrame) -> DataFrame:
    """One row for each chunk however often it is asked for. A stream needs a watermark on requests first."""
    if requests.isStreaming:
        return requests.dropDuplicatesWithinWatermark(["doc_id", "chunk_index"])
    return requests.groupBy("doc_id", "chunk_index").agg(F.min("seq").alias("seq"))


def deferred_first(chunks: DataFrame, deferred: DataFrame) -> DataFrame:
    """chunks (doc_id, chunk_index) with rank: those asked for early come first, then document order."""
    asked = deferred.select("doc_id", "chunk_index").distinct().withColumn("asked", F.lit(1))
    both = chunks.join(asked, ["doc_id", "chunk_index"], "left")
    return both.withColumn("rank", F.row_number().over(W.partitionBy("doc_id").orderBy(F.coalesce("asked", F.lit(0)).desc(), "chunk_index"))).drop("asked")


def failure_breaker(events: DataFrame, most: int = MOST_FAILURES) -> DataFrame:
    """doc_id, failed_at: the seq at which the third failure in a row comes."""
    failed = F.col("status") == "failed"
    before = F.lag("status").over(W.partitionBy("doc_id").orderBy("seq"))
    runs = islands(events.where("status in ('failed', 'rendered')"), ["doc_id"], ["seq"], before != F.col("status"), "run")
    nth = F.row_number().over(W.partitionBy("doc_id", "run").orderBy("seq"))
    return runs.withColumn("nth", nth).where(failed & (F.col("nth") >= most)).groupBy("doc_id").agg(F.min("seq").alias("failed_at"))


def online_calibration(events: DataFrame) -> DataFrame:
    """doc_id, scale: actual over estimated frames; pairs that are not positive are left out. Runs on streams as it is."""
    good = events.where("estimated > 0 and actual > 0")
    return good.groupBy("doc_id").agg((F.sum("actual") / F.sum("estimated")).alias("scale"))


def lookahead(chunks: DataFrame, cursors: DataFrame, ahead: int = LOOKAHEAD) -> DataFrame:
    """Chunks at most `ahead` in front of a document's cursor (doc_id, cursor)."""
    return chunks.join(cursors, "doc_id").where((F.col("chunk_index") >= F.col("cursor")) & (F.col("chunk_index") < F.col("cursor") + ahead)).select("doc_id", "chunk_index")


def priming(events: DataFrame, lead_frames: int) -> DataFrame:
    """doc_id, ready_at: the seq at which the chunks rendered from the first on reach the lead, or all are rendered."""
    done = events.where("status = 'rendered'").groupBy("doc_id", "chunk_index").agg(F.min("seq").alias("seq"), F.min_by("frames", "seq").alias("frames"), F.max("total_chunks").alias("total"))
    along = W.partitionBy("doc_id").orderBy("chunk_index")
    upto = along.rowsBetween(W.unboundedPreceding, 0)
    done = done.withColumn("whole", F.col("chunk_index") == F.row_number().over(along) - 1).where("whole")
    done = done.withColumn("through", F.sum("frames").over(upto)).withColumn("at", F.max("seq").over(upto))
    ready = (F.col("through") >= lead_frames) | (F.col("chunk_index") + 1 == F.col("total"))
    return done.where(ready).groupBy("doc_id").agg(F.min("at").alias("ready_at"))


def ready_to_resume(chunks: DataFrame) -> DataFrame:
    """chunks (doc_id, chunk_index, rendered) with ready: it and the next are rendered, or it is the last."""
    following = F.lead("rendered").over(W.partitionBy("doc_id").orderBy("chunk_index"))
    return chunks.withColumn("ready", F.col("rendered") & F.coalesce(following, F.lit(True)))


class _Rendered:
    """What a document's state holds: how far its chunks are rendered without a hole, and the chunks beyond that.

    Events of a document come in the order of seq, over as many micro-batches as it takes. Each call of the state is a
    round trip between Python and the JVM, so chunks beyond a hole are kept in blocks of `BLOCK`: the value and each
    block touched are read and written once for each key and micro-batch, however many chunks wait.
    """

    def init(self, handle) -> None:
        self.waiting = handle.getMapState("waiting", "block int", "chunk array<int>, seq array<bigint>, frames array<bigint>, total array<bigint>")
        self.through = handle.getValueState("through", "prefix int, frames long, total long, at long, held int, told boolean")

    def advanced(self, rows):
        """The state after each chunk that joins the prefix: prefix, frames, total (largest so far), at (largest seq
        through it), own total; last comes the state as it is, with an own total of null. Writes the state in the end."""
        prefix, frames, total, at, held, self.told = self.through.get() or (0, 0, 0, -1, 0, False)
        stored, blocks, changed = held > 0, {}, set()

        def block(chunk: int) -> dict[int, tuple[int, int, int]]:
            """Waiting chunks of the chunk's block: seq, frames and own total."""
            n = chunk // BLOCK
            if n not in blocks:
                found = self.waiting.getValue((n,)) if stored else None
                blocks[n] = dict(zip(found[0], zip(*found[1:]))) if found else {}
            return blocks[n]

        for r in sorted(rows, key=lambda r: r["seq"]):
            chunk, own = r["chunk_index"], r["total_chunks"]
            total = max(total, own)
            if chunk > prefix and chunk not in block(chunk):
                block(chunk)[chunk] = (r["seq"], r["frames"], own)
                changed.add(chunk // BLOCK)
                held += 1
            if chunk != prefix:
                continue
            seq, more = r["seq"], r["frames"]
            while True:
                prefix, frames, at = prefix + 1, frames + more, max(at, seq)
                yield prefix, frames, total, at, own
                if not held or prefix not in block(prefix):
                    break
                seq, more, own = block(prefix).pop(prefix)
                changed.add(prefix // BLOCK)
                held -= 1
        yield prefix, frames, total, at, None
        for n in changed:
            if blocks[n]:
                self.waiting.updateValue((n,), (list(blocks[n]), *map(list, zip(*blocks[n].values()))))
            elif stored:
                self.waiting.removeKey((n,))
        self.through.update((prefix, frames, total, at, held, self.told))

    def close(self) -> None:
        pass


def _stateful(events: DataFrame, processor, schema: str, mode: str) -> DataFrame:
    """events by doc_id through a processor, which gets rows: documents have few in a micro-batch, and a pandas frame for
    each would cost more than the work."""
    return events.groupBy("doc_id").transformWithState(statefulProcessor=processor, outputStructType=schema, outputMode=mode, timeMode="None")


def _rendered(events: DataFrame) -> DataFrame:
    return events.where("status = 'rendered'").select("doc_id", "seq", "chunk_index", "frames", "total_chunks")


def progress_stream(events: DataFrame) -> DataFrame:
    """render_progress as a stream, in update mode: one row for each document that a micro-batch renders chunks of.

    events is a stream of (doc_id, seq, chunk_index, frames, status, total_chunks). Needs the RocksDB state store provider.
    """
    from pyspark.sql.streaming import StatefulProcessor

    class Progress(_Rendered, StatefulProcessor):
        def handleInputRows(self, key, rows, timer_values):
            *_, (prefix, frames, total, _, _) = self.advanced(rows)
            yield Row(doc_id=key[0], prefix=prefix, frames=frames, seconds=frames / FRAMES_A_SECOND, complete=prefix == total)

    return _stateful(_rendered(events), Progress(), "doc_id long, prefix long, frames long, seconds double, complete boolean", "Update")


def priming_stream(events: DataFrame, lead_frames: int) -> DataFrame:
    """priming as a stream, in append mode: a document's one row comes in the micro-batch in which the lead is reached."""
    from pyspark.sql.streaming import StatefulProcessor

    class Priming(_Rendered, StatefulProcessor):
        def handleInputRows(self, key, rows, timer_values):
            ready = None
            for prefix, frames, _, at, own in self.advanced(rows):
                if own is not None and not self.told and (frames >= lead_frames or prefix == own):
                    self.told, ready = True, at
            if ready is not None:
                yield Row(doc_id=key[0], ready_at=ready)

    return _stateful(_rendered(events), Priming(), "doc_id long, ready_at long", "Append")


def breaker_stream(events: DataFrame, most: int = MOST_FAILURES) -> DataFrame:
    """Events that pass the breaker, in append mode, with opened on the failure that opens it; later ones of the document
    are cut. A rendered chunk resets the count; other states pass and leave it."""
    from pyspark.sql.streaming import StatefulProcessor

    class Breaker(StatefulProcessor):
        def init(self, handle) -> None:
            self.count = handle.getValueState("count", "failures int, open boolean")

        def handleInputRows(self, key, rows, timer_values):
            failures, is_open = self.count.get() or (0, False)
            if is_open:
                return
            for r in sorted(rows, key=lambda r: r["seq"]):
                failures = failures + 1 if r["status"] == "failed" else 0 if r["status"] == "rendered" else failures
                is_open = failures >= most
                yield Row(doc_id=key[0], seq=r["seq"], chunk_index=r["chunk_index"], status=r["status"], opened=is_open)
                if is_open:
                    break
            self.count.update((failures, is_open))

        def close(self) -> None:
            pass

    return _stateful(events.select("doc_id", "seq", "chunk_index", "status"), Breaker(), "doc_id long, seq long, chunk_index int, status string, opened boolean", "Append")


def lookahead_stream(cursors: DataFrame, chunks: DataFrame, ahead: int = LOOKAHEAD) -> DataFrame:
    """Chunks that come within `ahead` of a document's cursor, each once, in append mode.

    cursors is a stream (doc_id, cursor, at) with a watermark on at; chunks is a table. A cursor names the chunks in front
    of it, so the stream-static join is on equal keys, and each cursor meets `ahead` rows at most.
    """
    wanted = cursors.select("doc_id", "at", F.explode(F.sequence(F.col("cursor").cast("int"), (F.col("cursor") + ahead - 1).cast("int"))).alias("chunk_index"))
    once = wanted.dropDuplicatesWithinWatermark(["doc_id", "chunk_index"])
    return once.join(chunks.select("doc_id", "chunk_index"), ["doc_id", "chunk_index"]).select("doc_id", "chunk_index")
