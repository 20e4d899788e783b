"""The registered queries of the training-data operators, with their production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.centroids import cluster_vectors
from quire.llm.collocations import collocations
from quire.llm.common import table
from quire.llm.decontam import contamination, near_items
from quire.llm.line_dedup import strip_boilerplate
from quire.llm.lm import language_model_scores
from quire.llm.mixing import in_order, mix
from quire.llm.near_dup import near_duplicates
from quire.llm.personal import personal_data
from quire.llm.quality import quality_scores, training_row
from quire.llm.secrets import scan
from quire.llm.sharding import shard_rows
from quire.llm.suffix_dedup import remove_repeats
from quire.llm.tiff import text_media


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model_scores(table(spark, sf_dir, "documents"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False).drop("kept")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = strip_boilerplate(table(spark, sf_dir, "pages"))
    return kept.select("page_id", "host", "host_pages", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard_rows(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=40)
    return rows.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = in_order(mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "position")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op4_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = quality_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scores.select("doc_id", (~training_row(F.col("doc_id"))).alias("held_out"), "score", "predicted")


def op8_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85).drop("text_key", "representative")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings")).drop("centroid")


def benchmark_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_lm_scoring, op2_line_dedup, op3_sharding, op4_tiff_media, op5_suffix_array_dedup, op6_quality_classifier, op7_source_mixing, op8_minhash_near_dup,
        op9_benchmark_decontamination, op10_secret_scan, op11_phrase_collocations, op12_personal_data, op13_centroid_clustering, benchmark_proximity,
    )
}

_WORDS9 = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""



def _centroid_sql(clusters: int = 40, rounds: int = 5) -> str:
    """Lloyd rounds written out, vectors and centroids one row a component."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
        d{i} AS MATERIALIZED (SELECT r, cluster, sum((v - c) * (v - c))::BIGINT AS d FROM long_rows JOIN c{i} USING (i) GROUP BY r, cluster),
        a{i} AS MATERIALIZED (SELECT r, arg_min(cluster, d::HUGEINT * {clusters} + cluster) AS cluster, min(d) AS d FROM d{i} GROUP BY r)""")
        if i < rounds:
            steps.append(f"""
        s{i} AS MATERIALIZED (SELECT cluster, i, sum(v)::HUGEINT AS s, count(*)::HUGEINT AS n FROM long_rows JOIN a{i} USING (r) GROUP BY cluster, i),
        c{i + 1} AS MATERIALIZED (SELECT c.cluster, c.i, coalesce((s - ((s % n) + n) % n) // n, c.c)::BIGINT AS c FROM c{i} c LEFT JOIN s{i} s ON c.cluster = s.cluster AND c.i = s.i)""")
    return f"""
        WITH sound AS (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
        kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id::VARCHAR) NULLS LAST, q) - 1 AS r, vec_id, q FROM (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM sound)),
        long_rows AS MATERIALIZED (SELECT r, unnest(range(64)) AS i, unnest(q) AS v FROM kept),
        c0 AS MATERIALIZED (SELECT r AS cluster, i, v AS c FROM long_rows WHERE r < {clusters}),{",".join(steps)},
        named AS (SELECT cluster, sha256(string_agg(c::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster)
        SELECT vec_id, a.cluster::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
        FROM a{rounds} a JOIN kept USING (r) JOIN named n ON a.cluster = n.cluster"""


ORACLE_SQL: dict[str, str] = {
    "op11_phrase_collocations": r"""
        WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        cut AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
        grams AS (SELECT lang, size, w[k:k + size - 1] AS p FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM cut, range(1, 5) sizes(size) WHERE len(w) >= size)),
        f AS MATERIALIZED (SELECT lang, size, p, lang || chr(1) || array_to_string(p, ' ') AS key, count(*) AS f FROM grams GROUP BY lang, size, p),
        totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
        c AS MATERIALIZED (SELECT lang, size, p, key, f AS a FROM f WHERE size >= 2 AND f >= 30),
        cuts AS MATERIALIZED (SELECT key, a, k, lang || chr(1) || array_to_string(p[1:k], ' ') AS lk, lang || chr(1) || array_to_string(p[k + 1:size], ' ') AS rk FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
        lefts AS MATERIALIZED (SELECT cuts.*, f.f AS l FROM cuts JOIN f ON f.key = lk),
        both_sides AS (SELECT lefts.*, f.f AS r, ((2000000::HUGEINT * a) // (l + f.f))::BIGINT AS score FROM lefts JOIN f ON f.key = rk),
        best AS (SELECT key, min({'score': score, 'k': k, 'l': l, 'r': r}) AS cut FROM both_sides GROUP BY key),
        inner_parts AS (SELECT lang || chr(1) || array_to_string(p[k:k + n - 1], ' ') AS key, max(a) AS longer FROM (SELECT lang, p, a, n, unnest(range(1, size - n + 2)) AS k FROM c, range(2, 4) sizes(n) WHERE n < size) GROUP BY 1),
        outer_ones AS (SELECT c.lang, array_to_string(c.p, ' ') AS phrase, c.a, cut.l AS l, cut.r AS r, cut.score AS score FROM c JOIN best ON best.key = c.key LEFT JOIN inner_parts i ON i.key = c.key WHERE i.longer IS NULL OR 100 * i.longer < 80 * c.a)
        SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM outer_ones) JOIN totals USING (lang) WHERE rank <= 2000""",
    "op13_centroid_clustering": _centroid_sql(),
    "op2_line_dedup": r"""
        WITH bare AS (
            SELECT page_id, nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#:]+)', 1), '') AS host,
                   regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', chr(10), 'g'), '<[^>]*>', chr(10), 'g') AS body
            FROM pages),
        cut AS (SELECT page_id, host, list_filter(list_transform(string_split(body, chr(10)), lambda x: trim(regexp_replace(x, '[ \t\r\f\x0B]+', ' ', 'g'))), lambda x: x <> '') AS lines FROM bare),
        totals AS (SELECT host, count(*) AS host_pages FROM cut WHERE host IS NOT NULL GROUP BY host),
        held AS (SELECT host, unnest(list_distinct(lines)) AS line FROM cut WHERE host IS NOT NULL),
        over_ratio AS (SELECT h.host, h.line FROM held h JOIN totals t ON h.host = t.host GROUP BY h.host, h.line, t.host_pages HAVING count(*) >= 2 AND count(*) > t.host_pages * 0.2),
        lists AS (SELECT host, list(line) AS dropped FROM over_ratio GROUP BY host),
        kept AS (SELECT c.page_id, c.host, coalesce(t.host_pages, 0) AS host_pages, c.lines,
                        list_filter(c.lines, lambda x: NOT list_contains(coalesce(l.dropped, []::VARCHAR[]), x)) AS stays
                 FROM cut c LEFT JOIN totals t ON c.host = t.host LEFT JOIN lists l ON c.host = l.host)
        SELECT page_id, host, host_pages, len(lines)::BIGINT AS n_lines, (len(lines) - len(stays))::BIGINT AS n_dropped, sha256(coalesce(array_to_string(stays, chr(10)), '')) AS kept_sha256 FROM kept""",
    "op7_source_mixing": r"""
        WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('mix:' || doc_id::VARCHAR) AS place FROM documents),
        each AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS number FROM sized GROUP BY source),
        weighed AS (SELECT *, CASE number % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 3 AS bound FROM each),
        filled AS (SELECT *, row_number() OVER w AS r, (sum(source_size) OVER ())::BIGINT - coalesce((sum(bound) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT, 0) AS rest,
                          (sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS rest_weight
                   FROM weighed WINDOW w AS (ORDER BY bound / weight, number)),
        first AS (SELECT r, rest, rest_weight FROM filled WHERE rest::DOUBLE * weight / rest_weight < bound ORDER BY r LIMIT 1),
        goals AS (SELECT f.source, f.number, f.source_size, CASE WHEN first.r IS NULL OR f.r < first.r THEN f.bound::DOUBLE ELSE first.rest::DOUBLE * f.weight / first.rest_weight END AS target
                  FROM filled f LEFT JOIN first ON true),
        placed AS (SELECT s.doc_id, s.size, g.number, g.source_size, g.target, floor(g.target + 0.5)::BIGINT AS goal,
                          (sum(s.size) OVER (PARTITION BY s.source ORDER BY s.place, s.doc_id, s.size ROWS UNBOUNDED PRECEDING))::BIGINT - s.size AS start
                   FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source),
        taken AS (SELECT *, greatest(0, least(size, goal - start)) + greatest(0, least(size, goal - source_size - start)) + greatest(0, least(size, goal - 2 * source_size - start)) AS taken,
                         start::DOUBLE / greatest(goal, 1) AS share FROM placed),
        timed AS (SELECT *, CASE number % 3
                    WHEN 0 THEN share
                    WHEN 1 THEN CASE WHEN share * 1.125 >= 0.75 THEN 0.5 + (sqrt(greatest(1.0 + -2.0 * (share * 1.125 - 0.75), 0.0)) - 1.0) / -1.0 ELSE (sqrt(greatest(4.0 + -4.0 * (share * 1.125), 0.0)) - 2.0) / -2.0 END
                    ELSE CASE WHEN share * 1.075 >= 0.375 THEN 0.6 + (sqrt(greatest(1.0 + 7.5 * (share * 1.075 - 0.375), 0.0)) - 1.0) / 3.75 ELSE (sqrt(greatest(0.0625 + 2.5 * (share * 1.075), 0.0)) - 0.25) / 1.25 END
                  END AS time FROM taken)
        SELECT doc_id, size, source_size, target, taken::BIGINT AS taken, CASE WHEN taken > 0 THEN least(floor(time * (SELECT sum(size) FROM sized))::BIGINT, (SELECT sum(size) FROM sized)::BIGINT) END AS position FROM timed""",
    "benchmark_proximity": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS9} AS w FROM documents),
        i AS (SELECT item_id::VARCHAR AS item_id, {_WORDS9} AS w FROM benchmark),
        own AS (SELECT DISTINCT item_id, w[k:k + 9] AS terms FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
        win AS (SELECT row_number() OVER () AS p, terms FROM (SELECT DISTINCT terms FROM own)),
        sharing AS (SELECT r, p FROM (SELECT r, unnest(list_distinct(w)) AS t FROM d) x JOIN (SELECT p, len(list_distinct(terms)) AS n, unnest(list_distinct(terms)) AS t FROM win) y ON x.t = y.t GROUP BY r, p, n HAVING count(*) = n),
        hit AS (SELECT DISTINCT r, p FROM (SELECT d.r, win.p, terms, w, unnest(range(1, greatest(len(w) - len(terms) - 1, 1) + 1)) AS k FROM sharing s JOIN d ON s.r = d.r JOIN win ON s.p = win.p) WHERE list_has_all(w[k:k + len(terms) + 1], terms))
        SELECT doc_id, item_id, count(*) AS n_windows FROM hit JOIN win ON hit.p = win.p JOIN own ON own.terms = win.terms JOIN d ON d.r = hit.r GROUP BY d.r, doc_id, item_id""",
    "op9_benchmark_decontamination": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS9} AS w FROM documents),
        i AS (SELECT item_id::VARCHAR AS item_id, {_WORDS9} AS w FROM benchmark),
        win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k:k + 9], ' ') AS key FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
        lens AS (SELECT DISTINCT n FROM win),
        spots AS (SELECT r, n, k, array_to_string(w[k:k + n - 1], ' ') AS key FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, lens WHERE len(w) >= n)),
        hit AS (SELECT spots.r, spots.k, spots.n, win.item_id FROM spots JOIN win ON spots.n = win.n AND spots.key = win.key),
        covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(k, k + n)) AS p FROM hit) GROUP BY r),
        named AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN covered USING (r) LEFT JOIN named USING (r)""",
}
