"""Queries over tokens and texts: quality, normalization, tagging."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.text import bare
from quire.functions.wordlists import DETERMINERS, FUNCTION_WORDS, HOMOGRAPHS, PREPOSITIONS, SUBJECT_PRONOUNS, UNCONDITIONAL, VERB_CUES
from quire.operators import normalize, quality
from quire.plans.base import bind
from quire.sources import views as v
from quire.sources.views import read

_quoted = lambda words: ", ".join("'" + w.replace("'", "''") + "'" for w in words)
_BARE = r"lower(regexp_replace(token, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g'))"


@bind("sample_pages", "WITH n AS (SELECT doc_id, count(*) AS n FROM v_pages GROUP BY doc_id) SELECT doc_id, unnest(CASE WHEN n <= 8 THEN range(n) ELSE list_transform(range(8), lambda i: floor((i + 0.5) * n / 8)::BIGINT) END)::INT AS page FROM n")
def _(spark, d):
    return quality.sample_pages(v.v_pages(spark, d).groupBy("doc_id").agg(F.count("*").alias("page_count")))


@bind("pronounceable", rf"SELECT doc_id, token_idx, regexp_matches(t, '[aeiouy]') AND NOT regexp_matches(t, '[bcdfghjklmnpqrstvwxz]{{5,}}') AS said FROM (SELECT doc_id, token_idx, lower(token) AS t FROM v_tokens)")
def _(spark, d):
    return v.v_tokens(spark, d).select("doc_id", "token_idx", quality.pronounceable(F.col("token")).alias("said"))


def _metrics_sql(tokens: str) -> str:
    return rf"""SELECT m.doc_id, chars / area AS density, n_function / n_tokens AS function_ratio, CASE WHEN n_alpha > 0 THEN n_said / n_alpha ELSE 0.0 END AS pronounceable_ratio, n_tokens FROM (
        SELECT doc_id, sum(length(token)) AS chars, count(*) AS n_tokens, count_if(core IN ({_quoted(sorted(set(FUNCTION_WORDS)))})) AS n_function, count_if(alpha) AS n_alpha,
               count_if(alpha AND regexp_matches(core, '[aeiouy]') AND NOT regexp_matches(core, '[bcdfghjklmnpqrstvwxz]{{5,}}')) AS n_said
        FROM (SELECT *, regexp_matches(core, '^\p{{L}}{{3,}}$') AS alpha FROM (SELECT doc_id, token, {_BARE} AS core FROM ({tokens}))) WHERE core <> '' GROUP BY doc_id) m
        JOIN (SELECT doc_id, sum((x1 - x0) * (y1 - y0)) AS area FROM v_pages GROUP BY doc_id) a ON m.doc_id = a.doc_id"""


_SCORED = "SELECT *, CASE WHEN n_tokens < 40 THEN 0.3 * least(1.0, density / 0.006) ELSE 0.3 * least(1.0, density / 0.006) + 0.45 * least(1.0, function_ratio / 0.2) + 0.25 * pronounceable_ratio END AS score FROM"


def _areas(spark, d):
    return v.v_pages(spark, d).groupBy("doc_id").agg(F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("area"))


def _rounded(df, *names):
    return df.select(*[F.round(c, 6).alias(c) if c in names else c for c in df.columns])


@bind("quality_metrics", f"SELECT doc_id, round(density, 6) AS density, round(function_ratio, 6) AS function_ratio, round(pronounceable_ratio, 6) AS pronounceable_ratio, n_tokens FROM ({_metrics_sql('SELECT doc_id, token FROM v_tokens')})")
def _(spark, d):
    return _rounded(quality.quality_metrics(v.v_tokens(spark, d), _areas(spark, d)), "density", "function_ratio", "pronounceable_ratio")


@bind("quality_score", f"SELECT doc_id, round(score, 6) AS score, score >= 0.55 AS ok FROM ({_SCORED} ({_metrics_sql('SELECT doc_id, token FROM v_tokens')}))")
def _(spark, d):
    return _rounded(quality.quality_score(quality.quality_metrics(v.v_tokens(spark, d), _areas(spark, d))).select("doc_id", "score", "ok"), "score")


_OCR = "SELECT doc_id, token FROM (SELECT doc_id, CASE WHEN token_idx % 3 = 0 THEN regexp_replace(token, '[aeiouAEIOU]', '', 'g') ELSE token END AS token FROM v_tokens) WHERE token <> ''"


@bind("choose_extraction", f"""WITH e AS ({_SCORED} ({_metrics_sql("SELECT doc_id, token FROM v_tokens")})), o AS ({_SCORED} ({_metrics_sql(_OCR)}))
    SELECT coalesce(e.doc_id, o.doc_id) AS doc_id, CASE WHEN coalesce(e.score >= 0.55, false) OR o.score IS NULL OR coalesce(o.score < e.score, false) THEN 'embedded' ELSE 'ocr' END AS choice,
           CASE WHEN coalesce(e.score >= 0.55, false) THEN false WHEN o.score IS NULL OR coalesce(o.score < e.score, false) THEN true ELSE NOT o.score >= 0.55 END AS needs_review FROM e FULL JOIN o ON e.doc_id = o.doc_id""")
def _(spark, d):
    t = v.v_tokens(spark, d)
    ocr = t.withColumn("token", F.when(F.col("token_idx") % 3 == 0, F.regexp_replace("token", "[aeiouAEIOU]", "")).otherwise(F.col("token"))).where("token <> ''")
    scored = lambda x: quality.quality_score(quality.quality_metrics(x, _areas(spark, d)))
    return quality.choose_extraction(scored(t), scored(ocr))


@bind("dictionary_hit_ratio", rf"""WITH t AS (SELECT doc_id, word, row_number() OVER (PARTITION BY doc_id ORDER BY token_idx) - 1 AS n, greatest(1, count(*) OVER (PARTITION BY doc_id) // 600) AS step FROM (SELECT doc_id, token_idx, {_BARE} AS word FROM v_tokens) WHERE regexp_matches(word, '^\p{{L}}{{3,}}$')),
    dict AS (SELECT word FROM (SELECT {_BARE} AS word FROM v_tokens) WHERE word <> '' GROUP BY word HAVING count(*) >= 5)
    SELECT doc_id, count(*) AS n, count(d.word) AS hits, round(CASE WHEN count(*) >= 40 THEN count(d.word) / count(*) ELSE 0.0 END, 6) AS ratio FROM t LEFT JOIN dict d ON t.word = d.word WHERE n % step = 0 GROUP BY doc_id""")
def _(spark, d):
    t = v.v_tokens(spark, d)
    dictionary = t.select(bare(F.col("token")).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("k")).where("k >= 5")
    return _rounded(quality.dictionary_hit_ratio(t, dictionary), "ratio")


_AFFIX = r"""affix AS (SELECT *, regexp_extract(rest, '([^\p{L}\p{N}]*)$', 1) AS trail, substring(rest, 1, length(rest) - length(regexp_extract(rest, '([^\p{L}\p{N}]*)$', 1))) AS core FROM (
    SELECT *, regexp_extract(token, '^([^\p{L}\p{N}]*)', 1) AS lead, substring(token, length(regexp_extract(token, '^([^\p{L}\p{N}]*)', 1)) + 1) AS rest FROM %s))"""


@bind("token_affixes", f"WITH {_AFFIX % 'v_abbrev'} SELECT doc_id, token_idx, lead, core, trail FROM affix")
def _(spark, d):
    return normalize.token_affixes(v.v_abbrev(spark, d)).select("doc_id", "token_idx", "lead", "core", "trail")


@bind("expand_abbreviations", rf"""WITH {_AFFIX % 'v_abbrev'},
    k AS (SELECT doc_id, token_idx, token, lead, core, lower(core) AS low, replace(trail, '.', '') AS kept FROM affix),
    n AS (SELECT *, lead(lead) OVER w AS n_lead, lead(core) OVER w AS n_core, lead(low) OVER w AS n_low, lead(kept) OVER w AS n_kept FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY token_idx)),
    p AS (SELECT *, coalesce((low = 'et' AND n_low = 'al') OR (low = 'pp' AND regexp_matches(n_core, '^\d+[-–—]\d+$')), false) AS pair FROM n),
    q AS (SELECT *, coalesce(lag(pair) OVER (PARTITION BY doc_id ORDER BY token_idx), false) AS eaten FROM p),
    o AS (SELECT doc_id, token_idx, CASE WHEN low = 'et' AND pair THEN ['et', 'al' || n_kept]
        WHEN pair THEN [n_lead || 'pages', regexp_extract(n_core, '^(\d+)', 1), 'to', regexp_extract(n_core, '(\d+)$', 1) || n_kept]
        WHEN low = 'e.g' THEN [lead || 'for', 'example' || kept] WHEN low = 'i.e' THEN [lead || 'that', 'is' || kept] WHEN low = 'cf' THEN [lead || 'compare' || kept] WHEN low = 'ibid' THEN [lead || 'ibid' || kept] ELSE [token] END AS l FROM q WHERE NOT eaten)
    SELECT doc_id, token_idx, (generate_subscripts(l, 1) - 1)::INT AS sub_idx, unnest(l) AS spoken FROM o""")
def _(spark, d):
    return normalize.expand_abbreviations(v.v_abbrev(spark, d))


@bind("normalize_guard", "SELECT doc_id, block_idx, role NOT IN ('body', 'heading', 'footnoteBody') OR n_tokens % 5 = 0 AS pass_through FROM v_blocks")
def _(spark, d):
    spoken = F.col("role").isin("body", "heading", "footnoteBody")
    return v.v_blocks(spark, d).select("doc_id", "block_idx", (~spoken | (F.col("n_tokens") % 5 == 0)).alias("pass_through"))


@bind("fold_punctuation", r"""SELECT doc_id, md5(regexp_replace(translate(translate(translate(text, '‘’«»', chr(39) || chr(39) || '“”'), '“”', '""'), '()', '«»'), ' {2,}', ' ', 'g')) AS folded FROM (SELECT doc_id, regexp_replace(text, '[\t\r\f\x0B]', ' ', 'g') AS text FROM documents)""")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(normalize.fold_punctuation(F.col("text"))).alias("folded"))


_TITLED = r"regexp_replace(regexp_replace(text, '\bThe ([A-Za-z])', 'Dr. Smith and Mrs. \1', 'g'), '\bThe ([A-Za-z])', 'Dr. Smith and Mrs. \1', 'g')"
_SPOKEN = _TITLED
for _find, _put in ((r"\bD[Rr]\.( [A-Z])", r"Doctor\1"), (r"\bMr\.", "Mister"), (r"\bMR\.( [A-Z])", r"Mister\1"), (r"\bMs\.", "Miss"), (r"\bMS\.( [A-Z])", r"Miss\1"), (r"\bMrs\.", "Mrs"), (r"\bMRS\.( [A-Z])", r"Mrs\1"), (r"(?i)\betc\.( [^A-Za-z]|[^ ]| ?$)", r"etc\1")):
    _SPOKEN = f"regexp_replace({_SPOKEN}, '{_find}', '{_put}', 'g')"


@bind("expand_titles", f"SELECT doc_id, md5({_SPOKEN}) AS spoken FROM documents")
def _(spark, d):
    titled = F.regexp_replace("text", r"\bThe (?=[A-Za-z])", "Dr. Smith and Mrs. ")
    return read(spark, d, "documents").select("doc_id", F.md5(normalize.expand_titles(titled)).alias("spoken"))


@bind("read_years_times", rf"""SELECT id, kind, token, CASE WHEN regexp_matches(token, '^([1-9]|1[0-2]):[0-5]\d$') THEN CASE WHEN m = 0 THEN h || ' o''clock' WHEN m < 10 THEN h || ' oh ' || m ELSE h || ' ' || m END
    WHEN regexp_matches(token, '^\d{{4}}s?$') THEN CASE WHEN y < 1100 OR y % 1000 < 10 THEN token WHEN y % 1000 >= 100 AND r = 0 THEN l || ' hundred' || s WHEN y % 1000 >= 100 AND r < 10 THEN l || ' oh ' || r || s ELSE l || ' ' || r || s END ELSE token END AS spoken
    FROM (SELECT id, kind, token, regexp_extract(token, '^(\d+):', 1) AS h, try_cast(regexp_extract(token, ':(\d\d)$', 1) AS INT) AS m, try_cast(substring(token, 1, 4) AS INT) AS y, try_cast(substring(token, 3, 2) AS INT) AS r, substring(token, 1, 2) AS l, CASE WHEN token LIKE '%s' THEN 's' ELSE '' END AS s FROM v_numbers)""")
def _(spark, d):
    return v.v_numbers(spark, d).select("id", "kind", "token", normalize.read_years_times(F.col("token")).alias("spoken"))


@bind("read_money", rf"""SELECT id, kind, token, CASE WHEN NOT regexp_matches(token, '^[$£]\d+(\.\d+)?$') THEN token WHEN NOT contains(a, '.') THEN a || ' ' || u || CASE WHEN a = '1' THEN '' ELSE 's' END
    ELSE w || ' ' || u || CASE WHEN w = '1' THEN '' ELSE 's' END || ' and ' || c || ' ' || CASE WHEN u = 'dollar' THEN CASE WHEN c = 1 THEN 'cent' ELSE 'cents' END WHEN c = 1 THEN 'penny' ELSE 'pence' END END AS spoken
    FROM (SELECT id, kind, token, substring(token, 2) AS a, CASE WHEN token LIKE '$%' THEN 'dollar' ELSE 'pound' END AS u, regexp_extract(substring(token, 2), '^(\d+)', 1) AS w, try_cast(rpad(regexp_extract(token, '\.(\d+)$', 1), 2, '0') AS INT) AS c FROM v_numbers)""")
def _(spark, d):
    return v.v_numbers(spark, d).select("id", "kind", "token", normalize.read_money(F.col("token")).alias("spoken"))


@bind("read_decimals_ranges", rf"""SELECT id, kind, token, regexp_replace(regexp_replace(CASE WHEN regexp_matches(t, '^\d*\.\d+$') THEN regexp_extract(t, '^(\d*)', 1) || ' point ' || array_to_string(string_split(regexp_extract(t, '\.(\d+)$', 1), ''), ' ') ELSE t END, '(\d)-(\d)', '\1 to \2', 'g'), '(\d)-(\d)', '\1 to \2', 'g') AS spoken
    FROM (SELECT id, kind, token, regexp_replace(regexp_replace(token, '(\d),(\d)', '\1\2', 'g'), '(\d),(\d)', '\1\2', 'g') AS t FROM v_numbers)""")
def _(spark, d):
    return v.v_numbers(spark, d).select("id", "kind", "token", normalize.read_decimals_ranges(F.col("token")).alias("spoken"))


def _named(n: str, below: int) -> str:
    """SQL that names a number below 100 or 1000."""
    ones, tens = (f"[{_quoted(x)}]" for x in (normalize.ONES, normalize.TENS))
    small = lambda x: f"CASE WHEN {x} < 20 THEN {ones}[{x} + 1] WHEN {x} % 10 = 0 THEN {tens}[{x} // 10 - 1] ELSE {tens}[{x} // 10 - 1] || ' ' || {ones}[{x} % 10 + 1] END"
    if below == 100:
        return small(f"({n})")
    return f"CASE WHEN {n} < 100 THEN {small(f'({n})')} WHEN {n} % 100 = 0 THEN {ones}[{n} // 100 + 1] || ' hundred' ELSE {ones}[{n} // 100 + 1] || ' hundred ' || {small(f'({n} % 100)')} END"


@bind("number_words", rf"""SELECT id, kind, token, CASE WHEN n IS NULL THEN NULL WHEN length(token) = 4 AND n BETWEEN 1100 AND 2099 AND NOT n BETWEEN 2000 AND 2009
        THEN {_named('n // 100', 100)} || CASE WHEN n % 100 = 0 THEN ' hundred' WHEN n % 100 < 10 THEN ' oh ' || {_named('n % 100', 100)} ELSE ' ' || {_named('n % 100', 100)} END
        ELSE array_to_string(list_filter([CASE WHEN m > 0 THEN {_named('m', 1000)} || ' million' END, CASE WHEN k > 0 THEN {_named('k', 1000)} || ' thousand' END, CASE WHEN r > 0 OR n = 0 THEN {_named('r', 1000)} END], lambda x: x IS NOT NULL), ' ') END AS words
    FROM (SELECT *, n // 1000000 AS m, n // 1000 % 1000 AS k, n % 1000 AS r FROM (SELECT *, CASE WHEN regexp_matches(token, '^\d{{1,9}}$') THEN try_cast(token AS BIGINT) END AS n FROM v_numbers))""")
def _(spark, d):
    return v.v_numbers(spark, d).select("id", "kind", "token", normalize.number_words(F.col("token")).alias("words"))


_GAP = r"[\s\x0B\x85\p{Z}]*"
_STOPS = rf'(?:{_GAP}[;:,.!?¡¿—…"«»“”]+{_GAP})+'


@bind("split_punctuation", rf"""WITH p AS (SELECT doc_id, string_split_regex(text, '{_STOPS}') AS said, regexp_extract_all(text, '{_STOPS}') AS stops FROM documents),
    q AS (SELECT doc_id, list_filter(flatten(list_transform(range(1, len(said) + 1), lambda i: [said[i], stops[i]])), lambda x: x IS NOT NULL AND x <> '') AS l FROM p)
    SELECT doc_id, seg_idx, text, regexp_full_match(text, '{_STOPS}') AS is_punct FROM (SELECT doc_id, (generate_subscripts(l, 1) - 1)::INT AS seg_idx, unnest(l) AS text FROM q)""")
def _(spark, d):
    return normalize.split_punctuation(read(spark, d, "documents"), ["doc_id"])


@bind("tag_pos", rf"""WITH w AS (SELECT doc_id, token_idx, {_BARE} AS word FROM v_homographs),
    n AS (SELECT *, coalesce(lag(word) OVER o, '') AS one, coalesce(lag(word, 2) OVER o, '') AS two, coalesce(lead(word) OVER o, '') AS after FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY token_idx))
    SELECT doc_id, token_idx, CASE WHEN word = '' THEN 'other' WHEN one IN ({_quoted(DETERMINERS + PREPOSITIONS)}) THEN 'noun' WHEN one IN ({_quoted(VERB_CUES + SUBJECT_PRONOUNS)}) THEN 'verb'
        WHEN two IN ({_quoted(DETERMINERS)}) THEN 'noun' WHEN token_idx = 0 AND after IN ({_quoted(DETERMINERS)}) THEN 'verb' ELSE 'other' END AS tag FROM n""")
def _(spark, d):
    return normalize.tag_pos(v.v_homographs(spark, d)).select("doc_id", "token_idx", "tag")


_READINGS = ", ".join([f"('{w}', '{p}', '{p}')" for w, p in UNCONDITIONAL.items()] + [f"('{w}', '{n}', '{p}')" for w, (n, p) in HOMOGRAPHS.items()])


@bind("homographs", rf"""WITH w AS (SELECT doc_id, token_idx, {_BARE} AS word FROM v_homographs), n AS (SELECT *, coalesce(lag(word) OVER o, '') AS one, coalesce(lag(word, 2) OVER o, '') AS two, coalesce(lead(word) OVER o, '') AS after FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY token_idx)),
    r AS (SELECT * FROM (VALUES {_READINGS}) AS t(word, noun, verb))
    SELECT n.doc_id, n.token_idx, CASE WHEN one NOT IN ({_quoted(DETERMINERS + PREPOSITIONS)}) AND (one IN ({_quoted(VERB_CUES + SUBJECT_PRONOUNS)}) OR (two NOT IN ({_quoted(DETERMINERS)}) AND token_idx = 0 AND after IN ({_quoted(DETERMINERS)}))) THEN verb ELSE noun END AS phonemes
    FROM n JOIN r ON n.word = r.word""")
def _(spark, d):
    return normalize.homographs(normalize.tag_pos(v.v_homographs(spark, d))).where("phonemes is not null").select("doc_id", "token_idx", "phonemes")


_LEXICON = f"lexicon AS (SELECT word, reverse(word) AS phonemes FROM (SELECT {_BARE} AS word FROM v_tokens) WHERE word <> '' GROUP BY word HAVING count(*) >= 3)"


def _lexicon(spark, d):
    """Words that occur three times or more, read backwards: a stand-in for a pronouncing dictionary."""
    seen = v.v_tokens(spark, d).groupBy("token").agg(F.count("*").alias("n"))
    word = bare(F.col("token"))
    # told from sums alone, so that tokens are counted as pronounce_join counts them, and both share that step
    words = seen.where("token is not null").groupBy(word.alias("word")).agg(F.sum(F.when(word != "", F.col("n"))).alias("n"))
    return words.where("n >= 3").select("word", F.reverse("word").alias("phonemes"))


@bind("pronounce_join", f"WITH {_LEXICON} SELECT t.doc_id, t.token_idx, coalesce(l.phonemes, array_to_string(list_filter(string_split(t.word, ''), lambda x: x <> ''), '-')) AS phonemes, l.word IS NULL AS spelled FROM (SELECT doc_id, token_idx, {_BARE} AS word FROM v_tokens) t LEFT JOIN lexicon l ON t.word = l.word")
def _(spark, d):
    return normalize.pronounce_join(v.v_tokens(spark, d), _lexicon(spark, d)).select("doc_id", "token_idx", "phonemes", "spelled")


@bind("word_cache", f"SELECT {_BARE} AS word, count(*) AS uses FROM v_tokens GROUP BY 1")
def _(spark, d):
    return v.v_tokens(spark, d).groupBy(bare(F.col("token")).alias("word")).agg(F.count("*").alias("uses"))


# what an engine might say, so that each remap is met
_ENGINE = "CASE length(word) % 5 WHEN 0 THEN word || 'nˈaɪntihˈʌndɹɪd' WHEN 1 THEN word || ' z' WHEN 2 THEN 'kəkˈoːɹoʊ' || word WHEN 3 THEN ' z ' || word || 'nˈaɪntiː' ELSE word || 'ːhˈʌndɹɪd z.' END"
_REMAPPED = "said"
for _find, _put in (("kəkˈoːɹoʊ", "kˈoʊkəɹoʊ"), ("kəkˈɔːɹəʊ", "kˈəʊkəɹəʊ"), ("ʲ", "j"), ("r", "ɹ"), ("x", "k"), ("ɬ", "l")):
    _REMAPPED = f"replace({_REMAPPED}, '{_find}', '{_put}')"
_REMAPPED = f"""regexp_replace(regexp_replace(regexp_replace({_REMAPPED}, '([a-zɹː])(hˈʌndɹɪd)', '\\1 \\2', 'g'), ' z([;:,.!?¡¿—…"«»“” ]|$)', 'z\\1', 'g'), '(nˈaɪn)ti([^ː]|$)', '\\1di\\2', 'g')"""


@bind("phoneme_postprocess", f"SELECT word, trim({_REMAPPED}) AS phonemes FROM (SELECT word, {_ENGINE} AS said FROM (SELECT DISTINCT {_BARE} AS word FROM v_tokens))")
def _(spark, d):
    t = v.v_tokens(spark, d).select(bare(F.col("token")).alias("word")).distinct()
    return t.select("word", normalize.phoneme_postprocess(F.expr(_ENGINE)).alias("phonemes"))
