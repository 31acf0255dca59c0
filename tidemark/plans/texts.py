"""Queries over texts: cleaning, tokens, language, features, quality, entities, topics and models, with their SQL."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions.alignment import indel_ratio, partial_indel_ratio
from tidemark.functions.lexicon import lexicon_sentiment
from tidemark.operators import brand, entity, features, models, preprocess, quality, topics, virality
from tidemark.plans.market import rounded
from tidemark.sources import readers
from tidemark.sources.shared import shared_path, stored, stored_model


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang", "source")


def _posts(spark, d):
    return readers.posts(spark, d)


def _joined(c) -> object:
    return F.array_join(c, "|")


#: A dictionary of words that the synthetic texts have, for the entity queries.
BRANDS = (("Thing", "goods", ("things", "thingou"), ("heat", "heatnt"), ("inner", "station")), ("Onion", "food", ("onions", "onand", "thing of", "of heat"), ("ration", "thread"), ("then", "nation")), ("Reed", "goods", ("reeds", "the reed", "and that shin"), ("shed", "shin"), ("that", "edition")))


#: Words that stand for aspects in the synthetic texts.
ASPECT_WORDS = ["heat", "onion", "reed", "station", "thing", "wheat"]


def terms(spark: SparkSession) -> DataFrame:
    rows = [(b, i, list(a), list(p), list(k)) for b, i, a, p, k in BRANDS]
    return entity.terms_of(spark.createDataFrame(rows, "brand string, industry string, aliases array<string>, products array<string>, keywords array<string>"))


def _q(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_CLEAN = r"trim(regexp_replace(replace(regexp_replace(regexp_replace(lower(text), 'https?://(?:[a-zA-Z0-9$-_@.&+!*\\(),]|%[0-9a-fA-F]{2})+', ' URL ', 'g'), '@\w+', ' USER ', 'g'), '#', ' '), '\s+', ' ', 'g'))"
_PUNCT = r"[!\"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{|}~]"
_TOK = f"list_distinct(list_filter(string_split_regex(regexp_replace({_CLEAN}, '{_PUNCT}', ' ', 'g'), '\\s+'), lambda w: w <> ''))"
_T = f"t AS (SELECT doc_id, {_TOK} AS w FROM documents)"
_F = f"f AS (SELECT doc_id, list_filter(w, lambda x: NOT list_contains({_q(X.STOP_WORDS)}, lower(x))) AS w FROM t)"
_END = lambda n: f"left(x, length(x) - {n})"
_DBL = lambda n, least: f"CASE WHEN length(x) - {n} >= {least} AND right({_END(n)}, 1) = right(left(x, length(x) - {n + 1}), 1) AND NOT list_contains(['a','e','i','o','u'], lower(right({_END(n)}, 1))) THEN {_END(n + 1)} ELSE {_END(n)} END"
_IRR = " ".join(f"WHEN list_contains({_q([f for f, k in X.IRREGULAR.items() if k == base])}, lower(x)) THEN '{base}'" for base in dict.fromkeys(X.IRREGULAR.values()))
_LEM = f"""CASE {_IRR} WHEN (lower(x) LIKE '%ies' OR lower(x) LIKE '%ied') AND length(x) > 4 THEN {_END(3)} || 'y' WHEN lower(x) LIKE '%ing' AND length(x) > 4 THEN {_DBL(3, 2)} WHEN lower(x) LIKE '%ed' AND length(x) > 3 THEN {_DBL(2, 3)}
 WHEN lower(x) LIKE '%er' AND length(x) > 3 THEN {_END(2)} WHEN lower(x) LIKE '%est' AND length(x) > 4 THEN {_END(3)} WHEN lower(x) LIKE '%ly' AND length(x) > 3 THEN {_END(2)} WHEN lower(x) LIKE '%ness' AND length(x) > 5 THEN {_END(4)} WHEN lower(x) LIKE '%ment' AND length(x) > 5 THEN {_END(4)}
 WHEN (lower(x) LIKE '%tion' OR lower(x) LIKE '%sion') AND length(x) > 5 THEN {_END(4)} WHEN lower(x) LIKE '%s' AND lower(x) NOT LIKE '%ss' AND lower(x) NOT LIKE '%us' AND length(x) > 2 THEN {_END(1)} ELSE x END"""
_L = f"l AS (SELECT doc_id, list_transform(w, lambda x: {_LEM}) AS w FROM f)"
_P = "p AS (SELECT d.doc_id, text, lang, source, TIMESTAMP '2024-01-01' + to_minutes(d.doc_id) AS ts, quality::DOUBLE AS y FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
_SHARE = lambda known: f"len(list_filter(w, lambda x: list_contains({_q(known)}, x))) / len(w)"
_SIGN = " + ".join(f"(CASE WHEN regexp_matches(low, '{p}') THEN 0.1::DOUBLE ELSE 0 END)" for p in X.ENGLISH_SIGNS)
_SCR = " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{c}'" for c, p, _ in X.SCRIPTS)
_LANG = f"""g AS (SELECT doc_id, text, lang, lower(text) AS low, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') AS w FROM documents), s AS (SELECT *, length(trim(text)) < 10 OR len(w) < 3 AS short,
  ({_SHARE(X.COMMON_EN)} + least({_SIGN}, 0.3::DOUBLE)) * (CASE WHEN length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) / length(text) > 0.1::DOUBLE THEN 0.8::DOUBLE ELSE 1 END) AS en, {_SHARE(X.COMMON_ES)} AS es, {_SHARE(X.COMMON_FR)} AS fr FROM g),
  k AS (SELECT *, CASE WHEN short THEN 'unknown' WHEN en > greatest(es, fr) AND en > 0.15::DOUBLE THEN 'en' WHEN es > fr AND es > 0.15::DOUBLE THEN 'es' WHEN fr > 0.15::DOUBLE THEN 'fr' {_SCR} ELSE 'unknown' END AS language FROM s),
  r AS (SELECT doc_id, lang, language, CASE language WHEN 'en' THEN least(en * 2, 0.95::DOUBLE) WHEN 'es' THEN es * 2 WHEN 'fr' THEN fr * 2 WHEN 'ru' THEN 0.7 WHEN 'unknown' THEN 0 ELSE 0.8 END AS confidence FROM k)"""
_N = "length(text)"
_CNT = lambda c: f"({_N} - length(replace(text, '{c}', '')))"
_DICT = "(VALUES " + ", ".join(f"('{b}', '{t.lower()}')" for b, _, a, p, _k in BRANDS for t in (b, *a, *p)) + ") AS d(brand, term)"
_CHUNK = r"list_filter(string_split_regex(regexp_replace(lower(text), '[^\p{L}\p{N}'' ]+', ' ', 'g'), '\s+'), lambda x: x <> '')"

#: Where a row stands in [0, 1) by the MD5 of seed and id.
_PLACE = lambda c: f"(('0x' || substr(md5('42:' || CAST({c} AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
_EMOJI_CLEAN = f"trim(regexp_replace(regexp_replace({_CLEAN}, '{X.EMOJI_RANGES}', ' ', 'g'), '\\s+', ' ', 'g'))"
# The words of each English post in the order of their first places, without stop words and as lemmas.
_WORDS = f"""u AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS k FROM (SELECT doc_id, list_filter(string_split_regex(regexp_replace({_EMOJI_CLEAN}, '{_PUNCT}', ' ', 'g'), '\\s+'), lambda w: w <> '') AS w FROM documents)),
  o AS (SELECT doc_id, x, min(k) AS k FROM u WHERE NOT list_contains({_q(X.STOP_WORDS)}, lower(x)) GROUP BY 1, 2), e AS (SELECT doc_id, string_agg({_LEM}, chr(1) ORDER BY k) AS j FROM o GROUP BY 1)"""
_ROWS = "(SELECT doc_id, text FROM documents)"
_TERMS3 = "(VALUES " + ", ".join(f"('{b}', '{p}')" for b, _, _a, ps, _k in BRANDS for p in ps) + ") AS d(brand, product)"
_ENDS = "(VALUES (''), " + ", ".join(f"(' {e}')" for e in (*entity.DESCRIPTORS, *range(1, 21))) + ") AS e(ending)"
_KEYWORDS = "(VALUES " + ", ".join(f"('{b}', '{k}')" for b, _, _a, _p, ks in BRANDS for k in ks if len(k) > 3) + ") AS d(brand, term)"
_SORTED = lambda c: f"array_to_string(list_sort(string_split({c}, ' ')), ' ')"
_RATIO = lambda a, b: f"((greatest(length({a}), length({b})) - levenshtein(regexp_replace({a}, '[^\\x00-\\x7F]', '~', 'g'), regexp_replace({b}, '[^\\x00-\\x7F]', '~', 'g'))) * 100.0::DOUBLE / greatest(length({a}), length({b})))"

_STRETCH = lambda a, b: f"CASE WHEN contains({b}, {a}) THEN 100 ELSE list_max(list_transform(range(1, length({b}) - length({a}) + 2), lambda i: {_RATIO(a, f'substr({b}, i::INT, length({a})::INT)')})) END"
_PARTIAL = f"CASE WHEN length(chunk) > length(term) THEN {_STRETCH('term', 'chunk')} ELSE {_STRETCH('chunk', 'term')} END"
# A row of the dynamic programme for each letter of a, the best of each place from the places before it.
_LCS = lambda a, b: f"list_last(list_reduce(list_concat([list_transform(range(0, length({b})), lambda z: 0)], list_transform(string_split({a}, ''), lambda c: [ord(c)])), lambda acc, x: list_transform(range(1, length({b}) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: greatest(acc[k], coalesce(acc[k - 1], 0) + (ord(substr({b}, k::INT, 1)) = x[1])::INT)))::INT)))"
_BEST_LCS = lambda a, b: f"list_max(list_transform(range(1, length({b}) - length({a}) + 2), lambda i: 100.0::DOUBLE * {_LCS(a, f'substr({b}, i::INT, length({a})::INT)')} / length({a})))"
# Runs of up to three words, by place.
_RUNS = f"""w AS (SELECT doc_id, {_CHUNK} AS w FROM documents), c AS (SELECT doc_id, n, i AS position, array_to_string(w[i + 1:i + n], ' ') AS chunk FROM (SELECT doc_id, w, n, unnest(range(0, greatest(len(w) - n + 1, 0))) AS i FROM w, (SELECT unnest([1, 2, 3]) AS n)) WHERE length(array_to_string(w[i + 1:i + n], ' ')) >= 3)"""
# From hits (h) and words like keywords (q): longer runs claim their words first, then better ones, then earlier ones; the best of a brand stays.
_FOUND = """g AS (SELECT doc_id, list_reduce(list([{'n': n, 's': score, 'p': position, 'b': brand}] ORDER BY n DESC, score DESC, position, brand), lambda a, x: CASE WHEN len(list_filter(a, lambda y: y.p < x[1].p + x[1].n AND x[1].p < y.p + y.n)) > 0 THEN a ELSE list_concat(a, x) END) AS xs FROM h GROUP BY 1),
  x AS (SELECT doc_id, x.b AS brand, max(x.s) AS score, arg_min(x.p, (-x.s, x.p)) AS position FROM (SELECT doc_id, unnest(xs) AS x FROM g) GROUP BY 1, 2), o AS (SELECT doc_id, count(*) AS n FROM x GROUP BY 1),
  k AS (SELECT doc_id, brand, count(DISTINCT term) AS k FROM c JOIN q USING (chunk) GROUP BY 1, 2 HAVING count(DISTINCT term) >= 2),
  a AS (SELECT doc_id, brand, score, position FROM x UNION ALL SELECT k.doc_id, k.brand, least(50 + 10 * k, 85), -1 FROM k LEFT JOIN o USING (doc_id) WHERE coalesce(n, 0) < 3 AND NOT EXISTS (SELECT 1 FROM x WHERE x.doc_id = k.doc_id AND x.brand = k.brand))
  SELECT doc_id AS id, string_agg(printf('%s:%.2f', brand, round(score) / 100), '|' ORDER BY score DESC, position, brand) AS brands FROM a GROUP BY 1"""

SQL: dict[str, str] = {
    "clean_text": f"SELECT doc_id, {_CLEAN} AS text_clean, array_to_string(regexp_extract_all(text, '#(\\w+)', 1), '|') AS hashtags FROM documents",
    "emoji_scores": f"SELECT doc_id, (2 * length(regexp_replace(text, '[^{X.EMOJI_GOOD}]', '', 'g')) + length(regexp_replace(text, '[^{X.EMOJI_MILD}]', '', 'g')) - 2 * length(regexp_replace(text, '[^{X.EMOJI_BAD}]', '', 'g')))::INT AS emoji_sentiment FROM documents",
    "tokens": f"WITH {_T} SELECT doc_id, array_to_string(list_sort(w), '|') AS tokens, len(w)::INT AS n FROM t",
    "tokens_filtered": f"WITH {_T}, {_F} SELECT doc_id, array_to_string(list_sort(w), '|') AS tokens_filtered, len(w)::INT AS n FROM f",
    "tokens_lemmatized": f"WITH {_T}, {_F}, {_L} SELECT doc_id, array_to_string(list_sort(w), '|') AS tokens_lemmatized, len(w)::INT AS n FROM l",
    "processed_lengths": f"WITH {_T}, {_F}, {_L} SELECT l.doc_id, length(text)::INT AS text_length, length(array_to_string(w, ' '))::INT AS processed_length, len(w)::INT AS token_count FROM l JOIN documents USING (doc_id)",
    "bigram_counts": f"SELECT doc_id, greatest(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) - 1, 0)::INT AS n2, greatest(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) - 2, 0)::INT AS n3 FROM documents",
    "detected_language": f"WITH {_LANG} SELECT doc_id, language, round(confidence, 6) AS confidence FROM r",
    "language_distribution": f"WITH {_LANG} SELECT language AS detected_language, count(*) AS count FROM r GROUP BY 1",
    "english_posts": f"WITH {_LANG} SELECT doc_id, lang FROM r WHERE language = 'en' AND confidence >= 0.5",
    "text_statistics": f"""SELECT doc_id, {_CNT('!')}::INT AS exclamation_count, {_CNT('?')}::INT AS question_count, round(coalesce(length(regexp_replace(text, '[^\\p{{Lu}}]', '', 'g')) / nullif({_N}, 0), 0), 6) AS uppercase_ratio, round(coalesce(length(regexp_replace(text, '[^!?.,;:''"-]', '', 'g')) / nullif({_N}, 0), 0), 6) AS punctuation_density FROM documents""",
    "temporal_features": """SELECT event_id, round(sin(2 * pi() * hour(ts) / 24), 6) + 0 AS hour_sin, round(cos(2 * pi() * hour(ts) / 24), 6) + 0 AS hour_cos, strftime(ts, '%a') AS day_of_week, (dayofweek(ts) IN (0, 6))::INT AS is_weekend, CASE WHEN hour(ts) BETWEEN 6 AND 11 THEN 'morning' WHEN hour(ts) BETWEEN 12 AND 17 THEN 'afternoon' WHEN hour(ts) >= 18 THEN 'evening' ELSE 'night' END AS time_of_day FROM events""",
    "csv_scan": "SELECT CASE WHEN o_orderkey % 13 = 0 OR o_orderkey % 17 = 0 THEN 'rejected' WHEN o_orderkey % 19 = 0 THEN 'blank' ELSE (o_orderkey % 2)::VARCHAR END AS kind, count(*) AS n FROM orders GROUP BY 1",
    "dictionary_features": f"""WITH b AS (SELECT doc_id, list_filter({_q(X.BRAND_TERMS)}, lambda t: regexp_matches(lower(text), '\\b' || t || '\\b')) AS m FROM documents) SELECT doc_id, array_to_string(m, '|') AS brand_mentions, len(m)::INT AS n, list_contains(m, 'apple')::INT AS has_apple FROM b""",
    "keyword_sentiment": f"""SELECT conv_id, turn, CASE WHEN {' OR '.join(f"contains(lower(text), '{w}')" for w in X.GOOD_WORDS)} THEN 'positive' WHEN {' OR '.join(f"contains(lower(text), '{w}')" for w in X.BAD_WORDS)} THEN 'negative' ELSE 'neutral' END AS sentiment FROM conversations""",
    "keyword_summary": f"""SELECT CASE WHEN {' OR '.join(f"contains(lower(text), '{w}')" for w in X.GOOD_WORDS)} THEN 'positive' WHEN {' OR '.join(f"contains(lower(text), '{w}')" for w in X.BAD_WORDS)} THEN 'negative' ELSE 'neutral' END AS sentiment, count(*) AS count FROM conversations GROUP BY 1""",
    "data_quality": f"""WITH {_P}, c AS (SELECT count(*) AS n, count(*) FILTER (text IS NULL) AS a, count(*) FILTER (length(trim(text)) = 0) AS b, count(*) FILTER (y IS NULL) AS s, count(*) FILTER (ts IS NULL) AS i, count(*) FILTER (length(trim(text)) > 0 AND y IS NOT NULL AND ts IS NOT NULL) AS f FROM p)
  SELECT n AS initial_count, a AS null_text_count, b AS empty_text_count, s AS null_sentiment_count, i AS invalid_date_count, f AS final_count, n - f AS removed_count, round((n - f) * 100.0::DOUBLE / n, 6) AS removal_percentage FROM c""",
    "class_distribution": f"WITH {_P} SELECT y AS sentiment, count(*) AS count FROM p GROUP BY 1",
    "trending_hashtags": f"""WITH {_P}, h AS (SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, lower(unnest(regexp_extract_all(text, '\\w+'))) AS hashtag, y FROM p), c AS (SELECT window_start, hashtag, count(*) AS mention_count, round(avg(y), 6) AS avg_sentiment FROM h GROUP BY 1, 2 HAVING count(*) >= 10)
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY window_start ORDER BY mention_count DESC, hashtag)::INT AS rank FROM c) WHERE rank <= 10""",
    "virality_text": f"""WITH {_P}, s AS (SELECT doc_id, round(abs(coalesce(y, 0.5::DOUBLE) * 2 - 1) * 0.3 + (len(regexp_extract_all(text, '#(\\w+)', 1)) > 0)::INT * 0.2 + contains(text, 'http')::INT * 0.1 + ({_CNT('!')} + {_CNT('?')} + 2 * length(regexp_replace(text, '[^{X.EMOJI_GOOD}]', '', 'g')) + length(regexp_replace(text, '[^{X.EMOJI_MILD}]', '', 'g')) - 2 * length(regexp_replace(text, '[^{X.EMOJI_BAD}]', '', 'g'))) * 0.01::DOUBLE, 6) AS virality_score FROM p)
  SELECT *, CASE WHEN virality_score > 0.7 THEN 'high' WHEN virality_score > 0.4 THEN 'medium' ELSE 'low' END AS virality_potential FROM s""",
    "virality_engagement": """SELECT o_orderkey, round((o_custkey * 2 + o_orderkey) / (o_totalprice + 1) * 0.4 + abs((o_custkey % 21 - 10) / 10.0::DOUBLE) * 0.2 + (o_orderstatus <> 'P')::INT * 0.15 + (o_orderpriority LIKE '1%')::INT * 0.15 + (o_orderpriority LIKE '2%')::INT * 0.1, 6) AS virality_score FROM orders""",
    "brand_chunks_exact": f"""WITH w AS (SELECT doc_id, {_CHUNK} AS w FROM documents), c AS (SELECT doc_id, unnest(w) AS chunk FROM w) SELECT doc_id AS id, brand, count(*) AS hits FROM c JOIN {_DICT} ON chunk = term GROUP BY 1, 2""",
    "brand_terms_fuzzy": f"""WITH w AS (SELECT {_CHUNK} AS w FROM documents), c AS (SELECT DISTINCT unnest(w) AS chunk FROM w) SELECT chunk, term, brand, round({_RATIO('chunk', 'term')}, 6) AS ratio FROM c JOIN {_DICT} ON least(length(chunk), length(term)) * 100.0 >= greatest(length(chunk), length(term)) * 75.0 - 0.000001 AND length(chunk) >= 3 WHERE {_RATIO('chunk', 'term')} >= 75""",
    "competitive_context": f"""WITH w AS (SELECT doc_id, lower(text) AS t, {_CHUNK} AS w FROM documents), c AS (SELECT DISTINCT doc_id, t, lower(brand) AS brand FROM (SELECT doc_id, t, unnest(w) AS chunk FROM w) JOIN {_DICT} ON chunk = term)
  SELECT a.doc_id AS id, a.brand AS brand_a, b.brand AS brand_b, CASE WHEN {' OR '.join(f"contains(a.t, '{p}')" for p in entity.COMPARISONS)} THEN 'comparison' ELSE 'co-mention' END AS context FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.brand < b.brand WHERE (a.brand, b.brand) IN (('reed', 'thing'), ('onion', 'thing'))""",
    "hash_sample": f"SELECT doc_id FROM documents WHERE {_PLACE('doc_id')} < 0.1::DOUBLE",
    "balanced_sample": f"""WITH {_P}, c AS (SELECT y, count(*) AS n FROM p WHERE y IS NOT NULL GROUP BY 1), t AS (SELECT y, least(sum(n) OVER () * 0.1::DOUBLE / count(*) OVER () / n, 1) AS share FROM c) SELECT doc_id AS tweet_id, y AS sentiment FROM p JOIN t USING (y) WHERE {_PLACE('doc_id')} < share""",
    "preprocessed_posts": f"""WITH {_LANG}, {_WORDS}, {_P} SELECT p.doc_id AS tweet_id, replace(coalesce(j, ''), chr(1), ' ') AS text_processed, y AS sentiment, ts AS timestamp, '' AS hashtags,
  (2 * length(regexp_replace(p.text, '[^{X.EMOJI_GOOD}]', '', 'g')) + length(regexp_replace(p.text, '[^{X.EMOJI_MILD}]', '', 'g')) - 2 * length(regexp_replace(p.text, '[^{X.EMOJI_BAD}]', '', 'g')))::INT AS emoji_sentiment,
  length(p.text)::INT AS text_length, length(coalesce(j, ''))::INT AS processed_length, (CASE WHEN j IS NULL THEN 0 ELSE len(string_split(j, chr(1))) END)::INT AS token_count, replace(coalesce(j, ''), chr(1), '|') AS tokens_lemmatized, language AS detected_language, round(confidence, 6) AS language_confidence
  FROM p JOIN r USING (doc_id) LEFT JOIN e USING (doc_id) WHERE language = 'en' AND confidence >= 0.5""",
    "product_extraction": f"""WITH w AS (SELECT doc_id, {_CHUNK} AS w FROM documents), c AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS chunk FROM w)
  SELECT DISTINCT doc_id AS id, product, brand, 1.0::DOUBLE AS confidence FROM c JOIN (SELECT brand, product, product || ending AS term FROM {_TERMS3}, {_ENDS}) ON chunk = term""",
    "product_matches": f"""WITH w AS (SELECT conv_id, turn, {_CHUNK} AS w FROM conversations), c AS (SELECT DISTINCT unnest(list_concat(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS chunk FROM w),
  t AS (SELECT brand, product, product || ending AS term FROM {_TERMS3}, {_ENDS}), m AS (SELECT chunk, term, brand, product, {_RATIO(_SORTED('chunk'), _SORTED('term'))} AS ratio FROM c JOIN t ON length(chunk) >= 3 AND least(length(chunk), length(term)) * 100.0 >= greatest(length(chunk), length(term)) * 70.0 - 0.000001)
  SELECT chunk, term, brand, product, round(ratio, 6) AS ratio FROM m WHERE ratio >= 70""",
    "brand_recognition_exact": f"""WITH {_RUNS}, h AS (SELECT doc_id, n, position, brand, 100.0::DOUBLE AS score FROM c JOIN {_DICT} ON chunk = term), q AS (SELECT chunk, brand, term FROM (SELECT DISTINCT chunk FROM c WHERE n = 1) JOIN {_KEYWORDS} ON chunk = term), {_FOUND}""",
    "brand_recognition": f"""WITH {_RUNS}, u AS (SELECT DISTINCT chunk FROM c), r AS (SELECT chunk, term, brand, {_RATIO('chunk', 'term')} AS r FROM u JOIN {_DICT} ON least(length(chunk), length(term)) * 100.0 >= greatest(length(chunk), length(term)) * 70.0 - 0.000001),
  t AS (SELECT chunk, term, brand, 0.4 * r + 0.2 * {_PARTIAL} + 0.25 * ts + 0.15 * CASE WHEN shared = least(len(list_distinct(string_split(chunk, ' '))), len(list_distinct(string_split(term, ' ')))) THEN 100 ELSE ts END AS score
    FROM (SELECT *, {_RATIO(_SORTED('chunk'), _SORTED('term'))} AS ts, len(list_intersect(string_split(chunk, ' '), string_split(term, ' '))) AS shared FROM r WHERE r >= 70 AND chunk <> term)),
  m AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY score DESC, term) AS k FROM t WHERE score >= 70), h AS (SELECT doc_id, n, position, brand, score FROM c JOIN (SELECT chunk, brand, score FROM m WHERE k <= 5 UNION ALL SELECT term, brand, 100.0::DOUBLE FROM {_DICT}) USING (chunk)),
  q AS (SELECT chunk, brand, term FROM (SELECT DISTINCT chunk FROM c WHERE n = 1) JOIN {_KEYWORDS} ON {_RATIO('chunk', 'term')} >= 80), {_FOUND}""",
    "benchmark_terms_fuzzy": f"""WITH w AS (SELECT {_CHUNK} AS w FROM documents), c AS (SELECT DISTINCT chunk FROM (SELECT unnest(w) AS chunk FROM w) WHERE length(chunk) >= 3), t AS (SELECT DISTINCT term FROM (SELECT unnest({_CHUNK}) AS term FROM benchmark) WHERE regexp_full_match(term, '[a-z0-9'']{{5,}}') UNION SELECT DISTINCT lower(p_name) FROM part)
  SELECT chunk, term, round({_RATIO('chunk', 'term')}, 6) AS ratio FROM c JOIN t ON least(length(chunk), length(term)) * 100.0 >= greatest(length(chunk), length(term)) * 80.0 - 0.000001 AND {_RATIO('chunk', 'term')} >= 80""",
    "indel_scores": f"""WITH w AS (SELECT {_CHUNK} AS w FROM conversations), u AS (SELECT DISTINCT chunk FROM (SELECT unnest(w) AS chunk FROM w) WHERE length(chunk) >= 3), r AS (SELECT chunk, term, brand FROM u JOIN {_DICT} ON least(length(chunk), length(term)) * 100.0 >= greatest(length(chunk), length(term)) * 65.0 - 0.000001 AND {_RATIO('chunk', 'term')} >= 65)
  SELECT chunk, term, brand, round(200.0::DOUBLE * {_LCS('chunk', 'term')} / (length(chunk) + length(term)), 6) AS indel, round(CASE WHEN length(chunk) > length(term) THEN {_BEST_LCS('term', 'chunk')} ELSE {_BEST_LCS('chunk', 'term')} END, 6) AS partial FROM r""",
    "token_ids": """WITH w AS (SELECT conv_id * 1000 + turn AS id, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') AS w FROM conversations), u AS (SELECT id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM w), v AS (SELECT word, row_number() OVER (ORDER BY n DESC, word) AS i FROM (SELECT word, count(*) AS n FROM u GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10000)),
  g AS (SELECT id, list(i ORDER BY k) AS ids FROM u JOIN v USING (word) GROUP BY 1) SELECT id, array_to_string(list_concat(list_transform(range(0, 100 - least(100, coalesce(len(ids), 0))), lambda z: 0), coalesce(ids[greatest(len(ids) - 99, 1):], [])), ' ') AS ids FROM w LEFT JOIN g USING (id)""",
    "vocabulary_index": "WITH w AS (SELECT unnest(string_split_regex(lower(text), '\\s+')) AS word FROM conversations), c AS (SELECT word, count(*) AS n FROM w WHERE word <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10000) SELECT word, n, row_number() OVER (ORDER BY n DESC, word)::INT AS index FROM c",
    "aspect_mentions": f"""WITH m AS (SELECT source AS brand, unnest(list_filter({_q(ASPECT_WORDS)}, lambda a: contains(lower(text), a))) AS aspect, quality::DOUBLE AS y FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
  g AS (SELECT brand, aspect, count(*) AS mention_count, avg(y) AS a, count(*) FILTER (y = 1) AS p FROM m GROUP BY 1, 2)
  SELECT brand, aspect, mention_count, round(a, 6) AS avg_sentiment, round((a * 2 - 1) * 100, 6) AS feature_score, round(p / mention_count, 6) AS positive_ratio, row_number() OVER (PARTITION BY brand ORDER BY mention_count DESC, aspect)::INT AS feature_rank FROM g""",
    "fold_auc": f"""WITH r AS (SELECT floor({_PLACE('l.doc_id')} * 3)::INT AS fold, toxic AS y, length(text) AS s FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE toxic IS NOT NULL AND text IS NOT NULL),
  k AS (SELECT fold, y, rank() OVER (PARTITION BY fold ORDER BY s) + (count(*) OVER (PARTITION BY fold, s) - 1) / 2 AS r FROM r)
  SELECT fold, count(*) AS rows, round((sum(CASE WHEN y = 1 THEN r END) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / nullif(count(*) FILTER (y = 1) * count(*) FILTER (y = 0), 0), 6) AS auc FROM k GROUP BY 1""",
    "model_metrics": """WITH c AS (SELECT toxic AS label, 1 - quality AS prediction, count(*) AS n FROM labels GROUP BY 1, 2), r AS (SELECT label, sum(n) AS actual, sum(CASE WHEN label = prediction THEN n ELSE 0 END) AS hit FROM c GROUP BY 1), s AS (SELECT prediction AS label, sum(n) AS said FROM c GROUP BY 1), p AS (SELECT actual, hit, coalesce(hit / nullif(said, 0), 0) AS p, coalesce(hit / actual, 0) AS r FROM r LEFT JOIN s USING (label)), f AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f FROM p)
  SELECT round(sum(hit) / sum(actual), 6) AS accuracy, round(sum(p * actual) / sum(actual), 6) AS precision, round(sum(r * actual) / sum(actual), 6) AS recall, round(sum(f * actual) / sum(actual), 6) AS f1 FROM f""",
}


def _prep(spark, d):
    return _docs(spark, d).transform(preprocess.clean).transform(preprocess.words)


def _tokens(col):
    return lambda s, d: _prep(s, d).select("doc_id", _joined(F.sort_array(col)).alias(col), F.size(col).alias("n"))


def _plain_words(c):
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def _language(spark, d):
    return preprocess.language(_docs(spark, d))


def _viral(spark, d):
    mood = F.coalesce(F.col("sentiment"), F.lit(0.5)) * 2 - 1
    rows = _posts(spark, d).withColumns({"hashtags": X.hashtags(F.col("text")), "vader_compound": mood, "exclamation_count": X.count_of(F.col("text"), "!"), "question_count": X.count_of(F.col("text"), "?"), "emoji_sentiment": X.emoji_score(F.col("text"))})
    out = virality.text_virality(rows)
    score = F.round("virality_score", 6)
    return out.select(F.col("tweet_id").alias("doc_id"), score.alias("virality_score"), F.when(score > 0.7, "high").when(score > 0.4, "medium").otherwise("low").alias("virality_potential"))


def _aspects(spark, d):
    rows = _posts(spark, d).withColumns({"brand": F.col("source"), "confidence": F.lit(1.0)})
    out = brand.aspect_sentiment(rows, ASPECT_WORDS)
    return rounded(out.select("brand", "aspect", "mention_count", "avg_sentiment", "feature_score", "positive_ratio", "feature_rank"))


def _engaged(spark, d):
    """Orders as posts: the priority tells whether one mentions somebody or has a link, the status whether it has a tag."""
    sign = F.when(F.startswith("o_orderpriority", F.lit("1")), "@shop ").when(F.startswith("o_orderpriority", F.lit("2")), "http://shop ").otherwise("")
    text = F.concat(sign, F.when(F.col("o_orderstatus") != "P", "#sold").otherwise("pending"))
    rows = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", text.alias("text"), X.hashtags(text).alias("hashtags"), ((F.col("o_custkey") % 21 - 10) / 10).alias("vader_compound"), F.col("o_custkey").alias("retweet_count"), F.col("o_orderkey").alias("favorite_count"), F.col("o_totalprice").alias("follower_count"))
    return rounded(virality.engagement_virality(rows).select("o_orderkey", "virality_score"))


def _exact(spark, d):
    return entity.matches(_docs(spark, d), terms(spark), "doc_id", "text", fuzzy=None).where("n = 1").groupBy("id", "brand").agg(F.count("*").alias("hits"))


def _fuzzy(spark, d):
    each = entity.chunks(_docs(spark, d), "doc_id", "text", 1).select("chunk").distinct()
    known = terms(spark).where("kind <> 'keyword'")
    return rounded(entity.similar_pairs(each, known, 75.0).select("chunk", "term", "brand", "ratio"))


def _benchmark_terms(spark, d):
    """Words of the documents against a dictionary of the benchmark's plain words of five letters or more, and the parts' names."""
    words = entity.chunks(spark.read.parquet(f"{d}/benchmark.parquet"), "item_id", "text", 1).where(F.col("chunk").rlike("^[a-z0-9']{5,}$")).select(F.col("chunk").alias("term"))
    known = words.union(spark.read.parquet(f"{d}/part.parquet").select(F.lower("p_name").alias("term"))).distinct()
    each = entity.chunks(_docs(spark, d), "doc_id", "text", 1).select("chunk").distinct()
    return rounded(entity.similar_pairs(each, known, 80.0).select("chunk", "term", "ratio"))


def _context(spark, d):
    hits = entity.matches(_docs(spark, d), terms(spark), "doc_id", "text", fuzzy=None).where("n = 1")
    rows = hits.groupBy("id").agg(F.collect_set("brand").alias("brands")).join(_docs(spark, d).select(F.col("doc_id").alias("id"), "text"), "id")
    rivals = entity.competitor_map(spark.createDataFrame([("Thing", "Onion")], "brand string, competitor string"))
    return entity.competitive_context(rows, rivals, terms(spark).select("brand", "industry").distinct(), phrases=None)


def _features(spark, d):
    docs = _posts(spark, d).transform(preprocess.clean).transform(preprocess.emoji).transform(preprocess.words, "text_clean_demojized").transform(preprocess.processed)
    return features.feature_pipeline(docs)


def _model_data(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), "l_quantity", "l_extendedprice", "l_discount", "l_tax", F.when(F.col("l_extendedprice") > 25 * 1400 + 1000 * quality.place("l_orderkey", 1), 1).otherwise(0).alias("sentiment"))
    # The price decides the label, with noise, and is no feature: models learn it from the quantity.
    return quality.hash_split(rows, "id"), ["l_quantity", "l_discount", "l_tax"]


def _compare(spark, d):
    data, names = _model_data(spark, d)
    return models.compare(spark, data, names).drop("train_seconds", "predict_seconds")


def _vectors(spark, d):
    rows = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", X.tokens(F.lower("text")).alias("tokens"))
    # With their keys, so that the vectors' rows don't make the tokens once more than learning does.
    return features.word2vec(stored(rows, "tokens"), "tokens", kept=True).select("conv_id", "turn", vector_to_array("word2vec_features").alias("word2vec_features"))


def _sparse(c: str):
    """A vector's entries that aren't 0, as (index, value)."""
    return F.filter(F.transform(vector_to_array(c), lambda x, i: F.struct(i.alias("index"), x.alias("value"))), lambda e: e["value"] != 0)


def _tfidf(spark, d):
    rows = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", X.tokens(F.lower("text")).alias("tokens"))
    return features.tfidf(rows, "tokens").select("conv_id", "turn", _sparse("tfidf_features").alias("tfidf_features"))


def _turns(spark, d):
    return spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", X.tokens(F.lower("text")).alias("tokens")).where("size(tokens) > 2")


def _topics(online: bool):
    def run(spark, d):
        model = topics.lda_pipeline(online=online, min_df=2, max_df=0.95).fit(_turns(spark, d))
        return topics.describe_topics(model).select("topic", _joined(F.col("words")).alias("words"), "weights")

    return run


def _dominant(spark, d):
    """Each turn's topics by a model that was saved and loaded again."""
    docs = _turns(spark, d)
    model = stored_model(spark, topics.lda_pipeline(min_df=2, max_df=0.95).fit(docs), "topics")
    p = vector_to_array("topic_distribution")
    return topics.with_topics(model, docs).select("conv_id", "turn", "dominant_topic", F.array_max(p).alias("weight"), topics.strong_topics(F.col("topic_distribution")).alias("strong_topics"))


def _csv_scan(spark, d):
    """Orders written as a CSV of posts with lines that break the schema, and read again with account of them."""
    k = F.col("o_orderkey")
    text = F.concat(F.lit('"He said ""no"", then, yes '), k.cast("string"), F.lit('"'))
    label = F.when(k % 13 == 0, "x").otherwise(((k % 2) * 4).cast("string"))
    line = F.when(k % 17 == 0, F.concat_ws(",", label, k.cast("string"))).otherwise(F.concat_ws(",", label, k.cast("string"), F.lit("Mon Apr 06 22:19:45 PDT 2009"), F.lit("NO_QUERY"), F.col("o_custkey").cast("string"), F.when(k % 19 == 0, F.lit('" "')).otherwise(text)))
    path = shared_path(spark, "csv")
    spark.read.parquet(f"{d}/orders.parquet").select(line.alias("value")).write.text(path)
    return readers.scan_counts(readers.scan_posts(spark, path))


def _clusters(spark, d):
    from pyspark.ml.functions import array_to_vector

    rows = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", array_to_vector("embedding").alias("features"))
    return topics.kmeans_clusters(rows).select("vec_id", "cluster")


def _product_matches(spark, d):
    found = entity.alike_chunks(spark.read.parquet(f"{d}/conversations.parquet"), entity.product_terms(terms(spark)), "conv_id", "text", entity.PRODUCT_RATIO, 3, words_sorted=True)
    return rounded(found.select("chunk", "term", "brand", "product", "ratio"))


def _indel(spark, d):
    words = entity.chunks(spark.read.parquet(f"{d}/conversations.parquet"), "conv_id", "text", 1).select("chunk").distinct()
    pairs = entity.similar_pairs(words, terms(spark).where("kind <> 'keyword'"), 65.0)
    return rounded(pairs.select("chunk", "term", "brand", indel_ratio(F.col("chunk"), F.col("term")).alias("indel"), partial_indel_ratio(F.col("chunk"), F.col("term")).alias("partial")))


def _token_ids(spark, d):
    rows = spark.read.parquet(f"{d}/conversations.parquet").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), _plain_words(F.lower("text")).alias("tokens"))
    return models.token_ids(rows, models.vocabulary(rows), "id").select("id", F.array_join("ids", " ").alias("ids"))


def _preprocessed(spark, d):
    out = preprocess.pipeline(_posts(spark, d)).drop("text").withColumns({"hashtags": _joined("hashtags"), "tokens_lemmatized": _joined("tokens_lemmatized")})
    return rounded(out)


QUERIES = {
    "clean_text": lambda s, d: _docs(s, d).transform(preprocess.clean).select("doc_id", "text_clean", _joined("hashtags").alias("hashtags")),
    "emoji_scores": lambda s, d: _docs(s, d).select("doc_id", X.emoji_score(F.col("text")).alias("emoji_sentiment")),
    "tokens": _tokens("tokens"),
    "tokens_filtered": _tokens("tokens_filtered"),
    "tokens_lemmatized": _tokens("tokens_lemmatized"),
    "processed_lengths": lambda s, d: _prep(s, d).transform(preprocess.processed).select("doc_id", "text_length", "processed_length", "token_count"),
    "bigram_counts": lambda s, d: _docs(s, d).withColumn("w", _plain_words(F.col("text"))).transform(features.ngram_counts, "w").select("doc_id", F.col("2gram_count").alias("n2"), F.col("3gram_count").alias("n3")),
    "detected_language": lambda s, d: rounded(_language(s, d).select("doc_id", F.col("detected_language").alias("language"), F.col("language_confidence").alias("confidence"))),
    "language_distribution": lambda s, d: _language(s, d).groupBy("detected_language").count(),
    "english_posts": lambda s, d: preprocess.filter_language(_docs(s, d)).select("doc_id", "lang"),
    "text_statistics": lambda s, d: rounded(features.text_statistics(_docs(s, d)).select("doc_id", "exclamation_count", "question_count", "uppercase_ratio", "punctuation_density")),
    "temporal_features": lambda s, d: rounded(features.temporal(s.read.parquet(f"{d}/events.parquet").select("event_id", F.col("ts").alias("timestamp"))).drop("timestamp")),
    "dictionary_features": lambda s, d: features.dictionary(_docs(s, d)).select("doc_id", _joined("brand_mentions").alias("brand_mentions"), F.size("brand_mentions").alias("n"), "has_apple"),
    "keyword_sentiment": lambda s, d: s.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", X.keyword_sentiment(F.col("text"))["sentiment"].alias("sentiment")),
    "keyword_summary": lambda s, d: s.read.parquet(f"{d}/conversations.parquet").select(X.keyword_sentiment(F.col("text"))["sentiment"].alias("sentiment")).groupBy("sentiment").count(),
    "data_quality": lambda s, d: rounded(quality.quality_report(_posts(s, d))),
    "class_distribution": lambda s, d: quality.class_counts(_posts(s, d)),
    # The texts have no tags of their own, so every word is written as one.
    "trending_hashtags": lambda s, d: rounded(topics.trending(_posts(s, d).withColumn("hashtags", X.hashtags(F.regexp_replace("text", r"(\w+)", "#$1"))))),
    "virality_text": _viral,
    "virality_engagement": _engaged,
    "brand_chunks_exact": _exact,
    "brand_terms_fuzzy": _fuzzy,
    "benchmark_terms_fuzzy": _benchmark_terms,
    "competitive_context": _context,
    "vocabulary_index": lambda s, d: models.vocabulary(s.read.parquet(f"{d}/conversations.parquet").select(_plain_words(F.lower("text")).alias("tokens"))),
    "aspect_mentions": _aspects,
    "fold_auc": lambda s, d: rounded(models.auc(models.folds(s.read.parquet(f"{d}/labels.parquet").join(_docs(s, d), "doc_id"), "doc_id").withColumn("score", F.char_length("text")), label="toxic", key=["fold"])),
    "model_metrics": lambda s, d: rounded(models.metrics(s.read.parquet(f"{d}/labels.parquet").select(F.col("toxic").cast("double").alias("label"), (1 - F.col("quality")).cast("double").alias("prediction")))),
    "brand_recognition": lambda s, d: entity.recognise(_docs(s, d), terms(s), "doc_id").select("id", _joined(entity.encode_pairs(F.col("brands"))).alias("brands")),
    "brand_recognition_exact": lambda s, d: entity.recognise(_docs(s, d), terms(s), "doc_id", fuzzy=None).select("id", _joined(entity.encode_pairs(F.col("brands"))).alias("brands")),
    "product_extraction": lambda s, d: entity.extract_products(_docs(s, d), terms(s), "doc_id", fuzzy=None),
    "product_matches": _product_matches,
    "product_extraction_fuzzy": lambda s, d: entity.extract_products(s.read.parquet(f"{d}/conversations.parquet").withColumn("id", F.col("conv_id") * 1000 + F.col("turn")), terms(s)),
    "indel_scores": _indel,
    "token_ids": _token_ids,
    "balanced_sample": lambda s, d: quality.balanced_sample(_posts(s, d).where("sentiment IS NOT NULL"), "tweet_id", 0.1).select("tweet_id", "sentiment"),
    "hash_sample": lambda s, d: quality.hash_sample(_docs(s, d), "doc_id", 0.1).select("doc_id"),
    "preprocessed_posts": _preprocessed,
    "lexicon_sentiment": lambda s, d: _docs(s, d).select("doc_id", lexicon_sentiment(F.col("text")).alias("s")).select("doc_id", "s.compound", "s.positive", "s.negative", "s.neutral"),
    "feature_table": lambda s, d: _features(s, d).select("tweet_id", "token_count", "2gram_count", "3gram_count", "exclamation_count", "uppercase_ratio", "vader_compound", "brand_count", "category_count", _sparse("tfidf_features").alias("tfidf")),
    "word2vec_similar": _vectors,
    "tfidf_vectors": _tfidf,
    "lda_topics": _topics(False),
    "lda_topics_online": _topics(True),
    "dominant_topics": _dominant,
    "csv_scan": _csv_scan,
    "kmeans_clusters": _clusters,
    "model_comparison": _compare,
}
