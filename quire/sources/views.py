"""Derived tables on which the queries run: plain arithmetic on the driver tables, in Spark and as SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PER_PAGE, PER_COLUMN, PER_LINE = 800, 400, 10


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a table's files that a partition of dealt documents gets, 200,000 to 400,000 words.
DEALT = 1 << 20


def dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents by doc_id over as many partitions as their files' size asks for.

    What a text is cut into is many times its size. It is dealt out whole, so that windows and groups over a document's
    lines, words and letters find them in place, and none of these are shuffled; small partitions are sorted in memory.
    """
    size = spark.read.format("binaryFile").load(f"{sf_dir}/documents.parquet").agg(F.sum("length")).first()[0] or 0
    return read(spark, sf_dir, "documents").repartition(size // DEALT + 1, "doc_id")


def v_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of each document in its row."""
    return dealt(spark, sf_dir).select("doc_id", F.array_remove(F.split("text", r"\s+"), "").alias("words"))


def v_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v_words(spark, sf_dir).select("doc_id", F.posexplode("words").alias("token_idx", "token"))


def v_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    idx = F.col("token_idx")
    grid = v_tokens(spark, sf_dir).select(
        "doc_id", "token_idx", "token", F.expr("token_idx div 800").cast("int").alias("page_index"), F.expr("token_idx % 800 div 400").cast("int").alias("col"),
        F.expr("token_idx % 400 div 10").cast("int").alias("line"), (idx % 10).alias("w"),
    )
    marker = (F.col("w") == 9) & (F.col("line") % 7 == 3) & (F.col("line") < 36)
    low = F.lit(720.0) - 15 * F.col("line")
    return grid.select(
        "doc_id", "token_idx", "page_index", "col", "line", "w", F.when(marker, F.expr("cast(1 + line div 7 as string)")).otherwise(F.col("token")).alias("text"),
        (F.lit(72.0) + 252 * F.col("col") + 22 * F.col("w")).alias("x"), F.when(marker, 4.0).otherwise(5.0 * F.least(F.length("token"), F.lit(4))).alias("width"),
        F.when(marker, 6.0).when(F.col("line") >= 36, 8.0).otherwise(10.0).alias("glyph_height"), F.when(marker, low + 3).otherwise(low).alias("baseline"), marker.alias("is_mark"),
    )


def v_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size(F.filter(F.split("text", r"\s+"), lambda x: x != ""))
    page = read(spark, sf_dir, "documents").groupBy("doc_id").agg(F.max(n).alias("n")).where("n > 0")
    page = page.select("doc_id", F.explode(F.sequence(F.lit(0), F.expr("cast((n - 1) div 800 as int)"))).alias("page_index"))
    return page.select("doc_id", "page_index", F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(612.0).alias("x1"), F.lit(792.0).alias("y1"))


def v_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = v_runs(spark, sf_dir)
    cut = (F.col("token_idx") % 5 == 0) & (F.length("text") > 1)
    n = F.length("text")
    first = F.struct(F.lit(0).alias("part"), F.substring("text", 1, 1).alias("str"), F.col("x").alias("x"), (F.col("width") / n).alias("width"))
    rest = F.struct(F.lit(1).alias("part"), F.expr("substring(text, 2)").alias("str"), (F.col("x") + F.col("width") / n).alias("x"), (F.col("width") * (n - 1) / n).alias("width"))
    whole = F.struct(F.lit(0).alias("part"), F.col("text").alias("str"), F.col("x").alias("x"), F.col("width").alias("width"))
    turned = F.col("token_idx") % 97 == 0
    return runs.withColumn("p", F.explode(F.when(cut, F.array(first, rest)).otherwise(F.array(whole)))).select(
        "doc_id", "page_index", (2 * F.col("token_idx") + F.col("p.part")).alias("item_seq"), "p.str", F.when(turned, 0.0).otherwise(10.0).alias("a"), F.when(turned, 10.0).otherwise(0.0).alias("b"),
        F.when(turned, -10.0).otherwise(0.0).alias("c"), F.when(turned, 0.0).otherwise(10.0).alias("d"), "p.x", "baseline", "p.width", F.col("glyph_height").alias("height"), (F.col("w") == 9).alias("has_eol"),
    )


def v_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = v_runs(spark, sf_dir).where("not is_mark")
    shift = F.when(F.col("line") % 6 == 0, 12.0).otherwise(0.0)
    body = runs.groupBy("doc_id", "page_index", "col", "line").agg(
        (F.min("x") + F.first(shift)).alias("x0"), F.max(F.col("x") + F.col("width")).alias("x1"), F.min(F.col("baseline") - 2).alias("y0"), F.max(F.col("baseline") + F.col("glyph_height") - 2).alias("y1"),
        F.max("baseline").alias("baseline"), F.max("glyph_height").alias("height"), F.count("*").alias("n_runs"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("w", "text"))), lambda x: x["text"]), " ").alias("text"),
    )
    pages = v_pages(spark, sf_dir).select("doc_id", "page_index")
    sources = read(spark, sf_dir, "documents").select("doc_id", "source")
    extra = lambda line, base, text: [F.lit(0).alias("col"), F.lit(line).alias("line"), F.lit(72.0).alias("x0"), F.lit(200.0).alias("x1"), F.lit(base - 2.0).alias("y0"), F.lit(base + 8.0).alias("y1"), F.lit(base).alias("baseline"), F.lit(10.0).alias("height"), F.lit(1).cast("long").alias("n_runs"), text.alias("text")]
    head = pages.join(sources, "doc_id").select("doc_id", "page_index", *extra(-1, 770.0, F.col("source")))
    folio = pages.select("doc_id", "page_index", *extra(99, 36.0, (F.col("page_index") + 1).cast("string")))
    return body.unionByName(head).unionByName(folio)


def v_doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.split("text", "\n")
    return dealt(spark, sf_dir).select("source", "doc_id", F.size(lines).alias("n_lines"), F.posexplode(lines).alias("line_no", "text")).select("source", "doc_id", "line_no", "n_lines", "text")


def v_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size(F.filter(F.split("text", r"\s+"), lambda x: x != ""))
    b = F.col("line_no")
    role = F.when(b % 9 == 8, "footnoteBody").when(b % 9 == 4, "footnoteMarker").when(n <= 3, "heading").otherwise("body")
    return v_doc_lines(spark, sf_dir).select(
        "doc_id", b.alias("block_idx"), role.alias("role"), F.expr("line_no div 8").cast("int").alias("page_index"), F.expr("line_no % 8 div 4").cast("int").alias("col"), "text", n.alias("n_tokens"),
        F.when(role == "heading", 12.0).otherwise(10.0).alias("height"), (b % 2 == 1).alias("starts_indented"), (n % 2 == 0).alias("ends_full"), F.lit(240.0).alias("col_width"),
    )


def v_block_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    return v_blocks(spark, sf_dir).select("doc_id", "block_idx", "role", F.posexplode(words).alias("token_idx", "token"))


def v_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v_blocks(spark, sf_dir).where("block_idx % 4 <> 0").select("doc_id", F.col("block_idx").alias("absorbed"), (F.col("block_idx") - 1).alias("survivor"))


def v_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = v_tokens(spark, sf_dir).select("doc_id", F.col("token_idx").alias("word_idx"), F.expr("token_idx div 25").cast("int").alias("block_idx"), (4 + 2 * F.length("token")).alias("frames"))
    quiet = F.when((F.col("word_idx") % 25 == 0) & (F.col("word_idx") > 0), 16).otherwise(0)
    along = W.partitionBy("doc_id").orderBy("word_idx").rowsBetween(W.unboundedPreceding, 0)
    return t.withColumn("end_frame", F.sum(F.col("frames") + quiet).over(along)).select("doc_id", "word_idx", "block_idx", (F.col("end_frame") - F.col("frames")).alias("start_frame"), "end_frame")


def v_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("doc_id"), (F.col("event_id") * 37 % 20000).alias("t_frame"))


def v_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, sf_dir, "events").withColumn("seq", F.row_number().over(order) - 1)
    return e.select(
        F.col("user_id").alias("doc_id"), "seq", "event_id", F.when(F.col("event_type") == "error", "failed").otherwise("rendered").alias("status"),
        F.when(F.col("event_id") % 2 == 1, F.col("seq")).otherwise(F.expr("seq div 2")).cast("int").alias("chunk_index"), (20 + F.floor("value")).alias("frames"),
        F.count("*").over(W.partitionBy("user_id")).alias("total_chunks"),
    )


def v_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("hash")).agg(F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("opened"), F.sum(F.floor(F.col("value") * 100)).alias("bytes"), F.count("*").alias("chunks"))


_SPLIT = r"list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')"
SQL: dict[str, str] = {
    "v_tokens": rf"SELECT doc_id, unnest(w) AS token, (generate_subscripts(w, 1) - 1)::INT AS token_idx FROM (SELECT doc_id, {_SPLIT} AS w FROM documents)",
    "v_grid": "SELECT *, token_idx // 800 AS page_index, token_idx % 800 // 400 AS col, token_idx % 400 // 10 AS line, token_idx % 10 AS w, (token_idx % 10 = 9 AND token_idx % 400 // 10 % 7 = 3 AND token_idx % 400 // 10 < 36) AS is_mark FROM v_tokens",
    "v_runs": """SELECT doc_id, token_idx, page_index, col, line, w, CASE WHEN is_mark THEN (1 + line // 7)::VARCHAR ELSE token END AS text, 72.0::DOUBLE + 252 * col + 22 * w AS x,
        CASE WHEN is_mark THEN 4.0::DOUBLE ELSE 5.0::DOUBLE * least(length(token), 4) END AS width, CASE WHEN is_mark THEN 6.0::DOUBLE WHEN line >= 36 THEN 8.0 ELSE 10.0 END AS glyph_height,
        720.0::DOUBLE - 15 * line + CASE WHEN is_mark THEN 3 ELSE 0 END AS baseline, is_mark FROM v_grid""",
    "v_pages": "SELECT DISTINCT doc_id, page_index, 0.0::DOUBLE AS x0, 0.0::DOUBLE AS y0, 612.0::DOUBLE AS x1, 792.0::DOUBLE AS y1 FROM v_grid",
    "v_items": """SELECT doc_id, page_index, 2 * token_idx + part AS item_seq,
        CASE WHEN NOT cut THEN text WHEN part = 0 THEN substring(text, 1, 1) ELSE substring(text, 2) END AS str,
        CASE WHEN turned THEN 0.0::DOUBLE ELSE 10.0 END AS a, CASE WHEN turned THEN 10.0::DOUBLE ELSE 0.0 END AS b, CASE WHEN turned THEN -10.0::DOUBLE ELSE 0.0 END AS c, CASE WHEN turned THEN 0.0::DOUBLE ELSE 10.0 END AS d,
        CASE WHEN part = 1 THEN x + width / n ELSE x END AS x, baseline, CASE WHEN NOT cut THEN width WHEN part = 0 THEN width / n ELSE width * (n - 1) / n END AS width, glyph_height AS height, w = 9 AS has_eol
        FROM (SELECT *, length(text) AS n, token_idx % 5 = 0 AND length(text) > 1 AS cut, token_idx % 97 = 0 AS turned FROM v_runs) JOIN (VALUES (0), (1)) AS p(part) ON part = 0 OR cut""",
    "v_lines": """SELECT doc_id, page_index, col, line, min(x) + CASE WHEN line % 6 = 0 THEN 12.0::DOUBLE ELSE 0.0 END AS x0, max(x + width) AS x1, min(baseline - 2) AS y0, max(baseline + glyph_height - 2) AS y1, max(baseline) AS baseline,
        max(glyph_height) AS height, count(*) AS n_runs, string_agg(text, ' ' ORDER BY w) AS text FROM v_runs WHERE NOT is_mark GROUP BY doc_id, page_index, col, line
        UNION ALL SELECT p.doc_id, page_index, 0, -1, 72.0, 200.0, 768.0, 778.0, 770.0, 10.0, 1, source FROM v_pages p JOIN documents d ON p.doc_id = d.doc_id
        UNION ALL SELECT doc_id, page_index, 0, 99, 72.0, 200.0, 34.0, 44.0, 36.0, 10.0, 1, (page_index + 1)::VARCHAR FROM v_pages""",
    "v_doc_lines": "SELECT source, doc_id, (generate_subscripts(l, 1) - 1)::INT AS line_no, len(l)::INT AS n_lines, unnest(l) AS text FROM (SELECT source, doc_id, string_split(text, chr(10)) AS l FROM documents)",
    "v_blocks": rf"""SELECT *, CASE WHEN role = 'heading' THEN 12.0::DOUBLE ELSE 10.0 END AS height, block_idx % 2 = 1 AS starts_indented, n_tokens % 2 = 0 AS ends_full, 240.0::DOUBLE AS col_width FROM (
        SELECT doc_id, block_idx, CASE WHEN block_idx % 9 = 8 THEN 'footnoteBody' WHEN block_idx % 9 = 4 THEN 'footnoteMarker' WHEN n_tokens <= 3 THEN 'heading' ELSE 'body' END AS role,
        block_idx // 8 AS page_index, block_idx % 8 // 4 AS col, text, n_tokens FROM (SELECT doc_id, line_no AS block_idx, text, len({_SPLIT})::INT AS n_tokens FROM v_doc_lines))""",
    "v_block_tokens": rf"SELECT doc_id, block_idx, role, unnest(w) AS token, (generate_subscripts(w, 1) - 1)::INT AS token_idx FROM (SELECT doc_id, block_idx, role, {_SPLIT} AS w FROM v_blocks)",
    "v_edges": "SELECT doc_id, block_idx AS absorbed, block_idx - 1 AS survivor FROM v_blocks WHERE block_idx % 4 <> 0",
    "v_timeline": """SELECT doc_id, word_idx, block_idx, end_frame - frames AS start_frame, end_frame FROM (SELECT *, (sum(frames + CASE WHEN word_idx % 25 = 0 AND word_idx > 0 THEN 16 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY word_idx))::BIGINT AS end_frame
        FROM (SELECT doc_id, token_idx AS word_idx, token_idx // 25 AS block_idx, 4 + 2 * length(token) AS frames FROM v_tokens))""",
    "v_positions": "SELECT event_id, user_id AS doc_id, event_id * 37 % 20000 AS t_frame FROM events",
    "v_render": """SELECT doc_id, seq, event_id, status, CASE WHEN event_id % 2 = 1 THEN seq ELSE seq // 2 END AS chunk_index, frames, total_chunks FROM (
        SELECT user_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, event_id, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'rendered' END AS status,
        (20 + floor(value))::BIGINT AS frames, count(*) OVER (PARTITION BY user_id) AS total_chunks FROM events)""",
    "v_library": "SELECT user_id AS hash, max(epoch_us(ts)) AS opened, sum(floor(value * 100))::BIGINT AS bytes, count(*) AS chunks FROM events GROUP BY user_id",
}



def v_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens with digits: those of documents, and prices, dates, times, quantities and codes of the other tables as text."""
    orders, lines, events = (read(spark, sf_dir, t) for t in ("orders", "lineitem", "events"))
    text = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    cents = F.floor(F.col("o_totalprice") * 100 + 0.5).cast("long")
    whole, rest = F.floor(cents / 100).cast("long"), F.lpad((cents % 100).cast("string"), 2, "0")
    sign = F.when(F.col("o_orderkey") % 2 == 0, "$").otherwise("£")
    price = F.when(F.col("o_orderkey") % 5 == 0, F.concat(sign, whole)).otherwise(F.concat(sign, whole, F.lit("."), rest))
    grouped = F.when(whole < 1000, whole.cast("string")).otherwise(F.concat(F.floor(whole / 1000).cast("long"), F.lit(","), F.lpad((whole % 1000).cast("string"), 3, "0")))
    year = F.concat(F.year("o_orderdate") - F.col("o_orderkey") % 130, F.when(F.col("o_orderkey") % 7 == 0, "s").otherwise(""))
    clock = F.concat(F.hour("ts") % 12 + 1, F.lit(":"), F.lpad((F.col("event_id") % 60).cast("string"), 2, "0"))
    of_orders = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("token")) for k, c in (("price", price), ("grouped", grouped), ("year", year), ("code", text((F.col("o_orderkey") * 7919) % 1_000_000_000)))]))
    of_lines = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("token")) for k, c in (("range", F.concat("l_linenumber", F.lit("-"), F.col("l_quantity").cast("int"))), ("decimal", F.concat(F.lit("0."), F.lpad(F.floor(F.col("l_discount") * 100 + 0.5).cast("string"), 2, "0"))), ("part", text("l_partkey")))]))
    tokens = v_tokens(spark, sf_dir).where(F.col("token").rlike("[0-9]")).select(F.col("doc_id").alias("id"), F.lit("text").alias("kind"), "token")
    return (
        tokens.unionByName(orders.select(F.col("o_orderkey").alias("id"), of_orders.alias("t")).select("id", "t.kind", "t.token"))
        .unionByName(lines.select(F.col("l_orderkey").alias("id"), of_lines.alias("t")).select("id", "t.kind", "t.token"))
        .unionByName(events.select(F.col("event_id").alias("id"), F.lit("clock").alias("kind"), clock.alias("token")))
    )


SQL["v_numbers"] = """SELECT doc_id AS id, 'text' AS kind, token FROM v_tokens WHERE regexp_matches(token, '[0-9]')
    UNION ALL SELECT id, unnest(['price', 'grouped', 'year', 'code']), unnest([CASE WHEN id % 5 = 0 THEN sign || c // 100 ELSE sign || c // 100 || '.' || lpad((c % 100)::VARCHAR, 2, '0') END,
        CASE WHEN c // 100 < 1000 THEN (c // 100)::VARCHAR ELSE c // 100 // 1000 || ',' || lpad((c // 100 % 1000)::VARCHAR, 3, '0') END, year(o_orderdate) - id % 130 || CASE WHEN id % 7 = 0 THEN 's' ELSE '' END, (id * 7919 % 1000000000)::VARCHAR])
        FROM (SELECT o_orderkey AS id, o_orderdate, floor(o_totalprice * 100 + 0.5)::BIGINT AS c, CASE WHEN o_orderkey % 2 = 0 THEN '$' ELSE '£' END AS sign FROM orders)
    UNION ALL SELECT l_orderkey, unnest(['range', 'decimal', 'part']), unnest([l_linenumber || '-' || l_quantity::INT, '0.' || lpad(floor(l_discount * 100 + 0.5)::INT::VARCHAR, 2, '0'), l_partkey::VARCHAR]) FROM lineitem
    UNION ALL SELECT event_id, 'clock', hour(ts) % 12 + 1 || ':' || lpad((event_id % 60)::VARCHAR, 2, '0') FROM events"""


def _replaced(every: int, marks: dict[int, str]):
    def make(spark: SparkSession, sf_dir: str) -> DataFrame:
        token = F.col("token")
        for k, word in marks.items():
            token = F.when(F.col("token_idx") % every == k, word).otherwise(token)
        return v_tokens(spark, sf_dir).select("doc_id", "token_idx", token.alias("token"))

    cases = " ".join(f"WHEN {k} THEN '{w}'" for k, w in marks.items())
    return make, f"SELECT doc_id, token_idx, CASE token_idx % {every} {cases} ELSE token END AS token FROM v_tokens"


v_abbrev, SQL["v_abbrev"] = _replaced(40, {0: "(e.g.,", 5: "i.e.", 10: "cf.", 15: "ibid.,", 20: "et", 21: "al.", 30: "pp.", 31: "12-19", 35: "(pp.", 36: "3–7)."})
v_homographs, SQL["v_homographs"] = _replaced(50, {0: "the", 1: "record", 10: "to", 11: "record", 20: "they", 21: "conflict", 30: "lead", 40: "a", 41: "sharp", 42: "conflict"})


def with_views(sql: str) -> str:
    """sql with the derived views it uses, and those they use, in front."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in SQL:
            if re.search(rf"\b{name}\b", text) and name not in needed:
                visit(SQL[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    views = ", ".join(f"{n} AS MATERIALIZED ({SQL[n]})" for n in needed)
    body = sql.strip()
    if not views:
        return body
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {views}, {body[15:]}"
    return f"WITH {views}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {views} {body}"
