"""Queries over brand mentions and event series, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import brand, forecast, timeseries, topics
from tidemark.sources import readers

TARGET, RIVALS = "brand#11", ["brand#12", "brand#13", "brand#21"]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles at six digits, without a negative zero: sums in another order differ in the last digits."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _brands(spark: SparkSession, sf_dir: str, window: str = "1 day", least: float = 0.95) -> DataFrame:
    return brand.brand_sentiment(readers.brand_mentions(spark, sf_dir), window, least)


def _events(spark, d):
    return readers.event_series(spark, d)


# SQL pieces, written apart from the Spark code.
_M = """m AS (SELECT lower(p_brand) AS brand, p_type AS aspect, 1 - l_discount AS confidence, l_shipdate AS ts,
  CASE l_returnflag WHEN 'N' THEN 1.0 WHEN 'R' THEN 0.0 WHEN 'A' THEN 0.5 END::DOUBLE AS y, l_orderkey, l_linenumber FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def _b(width: str, least: str = "0.95") -> str:
    return f"""{_M}, b AS (SELECT time_bucket(INTERVAL '{width}', ts, TIMESTAMP '1970-01-01') AS window_start, brand, count(*) AS mention_count, avg(y) AS avg_sentiment, stddev_samp(y) AS sentiment_stddev,
  count(*) FILTER (y = 1) AS positive_mentions, count(*) FILTER (y = 0) AS negative_mentions, count(*) FILTER (y = 0.5) AS neutral_mentions, avg(confidence) AS avg_confidence, min(ts) AS first_mention, max(ts) AS last_mention,
  (avg(y) * 2 - 1) * 100 AS sentiment_score, count_if(y = 1) / count(*) AS positive_ratio, count_if(y = 0) / count(*) AS negative_ratio
  FROM m WHERE confidence >= {least}::DOUBLE GROUP BY 1, 2)"""


_E = "e AS (SELECT ts, event_type AS topic, value, CASE WHEN event_type IN ('purchase', 'signup') THEN 1.0 WHEN event_type = 'error' THEN 0.0 END::DOUBLE AS y FROM events)"


def _t(bucket: str) -> str:
    return f"""{_E}, t AS (SELECT {bucket} AS window_start, count(y) AS tweet_count, avg(y) AS avg_sentiment, stddev_samp(y) AS sentiment_stddev, count(*) FILTER (y = 1) AS positive_count, count(*) FILTER (y = 0) AS negative_count FROM e GROUP BY 1)"""


def _grain(bucket: str, end: str) -> str:
    return f"""WITH {_t(bucket)} SELECT tweet_count, round(avg_sentiment, 6) AS avg_sentiment, round(sentiment_stddev, 6) AS sentiment_stddev, positive_count, negative_count, window_start, {end} AS window_end,
  round(positive_count / nullif(tweet_count, 0), 6) AS positive_ratio, hour(window_start)::INT AS hour, (dayofweek(window_start) + 1)::INT AS day_of_week, month(window_start)::INT AS month, year(window_start)::INT AS year,
  weekofyear(window_start)::INT AS week_of_year, (dayofweek(window_start) IN (0, 6))::INT AS is_weekend FROM t"""


SQL: dict[str, str] = {
    "sentiment_hourly": _grain("date_trunc('hour', ts)", "window_start + INTERVAL '1 hour'"),
    "sentiment_daily": _grain("date_trunc('day', ts)::TIMESTAMP", "window_start + INTERVAL '1 day'"),
    "sentiment_weekly": _grain("time_bucket(INTERVAL '7 days', ts, TIMESTAMP '1970-01-01')", "window_start + INTERVAL '7 days'"),
    "sentiment_monthly": _grain("date_trunc('month', ts)::TIMESTAMP", "window_start + INTERVAL '1 month'"),
    "sentiment_by_hour_of_day": f"WITH {_E} SELECT hour(ts)::INT AS hour, round(avg(y), 6) AS avg_sentiment, count(y) AS tweet_count FROM e GROUP BY 1",
    "sentiment_by_day_of_week": f"WITH {_E} SELECT (dayofweek(ts) + 1)::INT AS day_of_week, round(avg(y), 6) AS avg_sentiment, count(y) AS tweet_count, dayname(ts) AS day_name FROM e GROUP BY 1, 4",
    "sentiment_cube": f"""WITH {_E}, k AS (SELECT date_trunc('hour', ts) AS a, date_trunc('day', ts)::TIMESTAMP AS b, time_bucket(INTERVAL '7 days', ts, TIMESTAMP '1970-01-01') AS c, hour(ts)::INT AS h, (dayofweek(ts) + 1)::INT AS d, y FROM e)
  SELECT CASE grouping_id(a, b, c, h, d) WHEN 15 THEN 'hourly' WHEN 23 THEN 'daily' WHEN 27 THEN 'weekly' WHEN 29 THEN 'hour' ELSE 'day_of_week' END AS grain, coalesce(a, b, c) AS window_start, coalesce(h, d) AS part,
  count(y) AS tweet_count, round(avg(y), 6) AS avg_sentiment, round(stddev_samp(y), 6) AS sentiment_stddev, count(*) FILTER (y = 1) AS positive_count, count(*) FILTER (y = 0) AS negative_count, round(count(*) FILTER (y = 1) / nullif(count(y), 0), 6) AS positive_ratio
  FROM k GROUP BY GROUPING SETS ((a), (b), (c), (h), (d))""",
    "sentiment_anomalies": f"""WITH {_t("date_trunc('hour', ts)")}, r AS (SELECT window_start, avg_sentiment, avg(avg_sentiment) OVER w AS rolling_mean, stddev_samp(avg_sentiment) OVER w AS rolling_std FROM t WINDOW w AS (ORDER BY window_start ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)),
  z AS (SELECT *, (avg_sentiment - rolling_mean) / CASE WHEN rolling_std <> 0 THEN rolling_std END AS z_score FROM r)
  SELECT window_start, round(avg_sentiment, 6) AS avg_sentiment, round(rolling_mean, 6) AS rolling_mean, round(rolling_std, 6) AS rolling_std, round(z_score, 6) AS z_score, coalesce(abs(z_score) > 2, false)::INT AS is_anomaly,
  CASE WHEN abs(z_score) > 2 AND z_score > 0 THEN 'positive_spike' WHEN abs(z_score) > 2 THEN 'negative_spike' ELSE 'normal' END AS anomaly_type FROM z""",
    "sentiment_momentum": f"""WITH {_t("date_trunc('day', ts)::TIMESTAMP")}, a AS (SELECT window_start, avg_sentiment AS x, avg(avg_sentiment) OVER (ORDER BY window_start ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS ma, lag(avg_sentiment, 7) OVER (ORDER BY window_start) AS p FROM t),
  c AS (SELECT *, x - p AS momentum, (x - p) * 100 / nullif(p, 0) AS roc FROM a)
  SELECT window_start, round(x, 6) AS avg_sentiment, round(ma, 6) AS sentiment_ma, round(roc, 6) AS roc, round(momentum, 6) AS momentum, round(momentum - lag(momentum) OVER (ORDER BY window_start), 6) AS acceleration,
  CASE WHEN momentum > 0.05 THEN 'improving' WHEN momentum < -0.05 THEN 'declining' ELSE 'neutral' END AS trend FROM c""",
    "hourly_volume": f"WITH {_E} SELECT date_trunc('hour', ts) AS window_start, count(*) AS tweet_count FROM e GROUP BY 1",
    "volume_anomalies": f"""WITH {_E}, v AS (SELECT date_trunc('hour', ts) AS window_start, count(*) AS tweet_count FROM e GROUP BY 1), r AS (SELECT *, avg(tweet_count) OVER w AS m, stddev_samp(tweet_count) OVER w AS s FROM v WINDOW w AS (ORDER BY window_start ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)),
  z AS (SELECT *, CASE WHEN s > 0 THEN (tweet_count - m) / s ELSE 0.0 END AS z_score FROM r) SELECT window_start, tweet_count, round(m, 6) AS rolling_mean, round(s, 6) AS rolling_std, round(z_score, 6) AS z_score, (abs(z_score) > 3)::INT AS is_anomaly,
  CASE WHEN abs(z_score) > 3 AND z_score > 0 THEN 'spike' WHEN abs(z_score) > 3 THEN 'drop' ELSE 'normal' END AS anomaly_type FROM z""",
    "general_brand_series": f"WITH {_E} SELECT 'general' AS brand, date_trunc('hour', ts) AS window_start, count(*) AS mention_count, round(avg(y), 6) AS sentiment_score, round(count(*) FILTER (y = 1) / count(*), 6) AS positive_ratio FROM e GROUP BY 2",
    "seasonal_decomposition": f"""WITH {_E}, v AS (SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, count(*)::DOUBLE AS x FROM e GROUP BY 1),
  a AS (SELECT *, row_number() OVER (ORDER BY window_start) - 1 AS k, count(*) OVER w AS n, avg(x) OVER w AS t FROM v WINDOW w AS (ORDER BY window_start ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
  b AS (SELECT *, CASE WHEN n = 7 THEN t END AS trend, k % 7 AS phase FROM a), s AS (SELECT phase, avg(x - trend) AS pm FROM b GROUP BY phase)
  SELECT window_start, x AS tweet_count, phase::INT AS phase, round(trend, 6) AS trend, round(pm - (SELECT avg(pm) FROM s), 6) AS seasonal, round(x - trend - (pm - (SELECT avg(pm) FROM s)), 6) AS residual FROM b JOIN s USING (phase)""",
    "weekday_pivot": f"""WITH {_E} SELECT weekofyear(ts)::INT AS week_of_year, {', '.join(f"round(avg(y) FILTER (dayofweek(ts) = {d - 1}), 6) AS day_{d}" for d in range(1, 8))} FROM e GROUP BY 1""",
    "emerging_topics": f"""WITH {_E}, c AS (SELECT time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') AS window_start, topic, count(*) AS doc_count FROM e GROUP BY 1, 2), l AS (SELECT *, lag(doc_count) OVER (PARTITION BY topic ORDER BY window_start) AS prev_count FROM c)
  SELECT window_start, topic, doc_count, prev_count, round(CASE WHEN prev_count > 0 THEN (doc_count - prev_count) / prev_count ELSE 0.0 END, 6) AS growth_rate FROM l WHERE CASE WHEN prev_count > 0 THEN (doc_count - prev_count) / prev_count ELSE 0.0 END > 0.2""",
    "topic_sentiment": f"""WITH {_E} SELECT topic, count(*) AS doc_count, count(y) AS labelled, round(avg(y), 6) AS avg_sentiment, round(stddev_samp(y), 6) AS sentiment_stddev, count(*) FILTER (y = 1) AS positive_count, count(*) FILTER (y = 0) AS negative_count, round(count_if(y = 1) / nullif(count(y), 0), 6) AS positive_ratio FROM e GROUP BY 1""",
    "polarising_brands": f"""WITH {_M}, g AS (SELECT aspect, count(*) AS doc_count, count(y) AS labelled, avg(y) AS a, stddev_samp(y) AS s, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS n FROM m GROUP BY 1 HAVING count(*) >= 50)
  SELECT aspect, doc_count, labelled, round(a, 6) AS avg_sentiment, round(s, 6) AS sentiment_stddev, p AS positive_count, n AS negative_count, round(p / labelled, 6) AS positive_ratio, round(n / labelled, 6) AS negative_ratio, round(2 * (p / labelled) * (n / labelled), 6) AS polarization, round(2 * (p / labelled) * (n / labelled) * coalesce(s, 0), 6) AS controversy FROM g""",
    "cluster_statistics": "SELECT label AS cluster, count(*) AS size, round(avg(vec_id % 2), 6) AS avg_sentiment FROM embeddings GROUP BY 1",
    "topic_histogram": "SELECT event_type AS topic, count(*) AS count FROM events GROUP BY 1",
    "viral_topics": "SELECT event_type AS topic, count(*) AS viral_count, round(avg(value), 6) AS avg_virality FROM events WHERE value > 0.7 GROUP BY 1",
    "topic_network": f"""WITH t AS (SELECT l_orderkey AS id, list_sort(list_distinct(list(p_type))) AS t FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1), r AS (SELECT * FROM t WHERE len(t) >= 2), x AS (SELECT id, unnest(t) AS a FROM r), n AS (SELECT count(*) AS n FROM r)
  SELECT x.a, y.a AS b, count(*) AS docs, round(count(*) / (SELECT n FROM n), 6) AS weight FROM x JOIN x y ON x.id = y.id AND x.a < y.a GROUP BY 1, 2 HAVING count(*) / (SELECT n FROM n) >= 0.1""",
    "word_overlap": """WITH w AS (SELECT p_brand AS topic, list_sort(list_distinct(list(p_name))) AS w FROM part GROUP BY 1)
  SELECT a.topic AS a, b.topic AS b, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 6) AS jaccard FROM w a JOIN w b ON a.topic < b.topic WHERE len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) > 0.1""",
    "brand_sentiment_daily": f"""WITH {_b('1 day')} SELECT brand, mention_count, round(avg_sentiment, 6) AS avg_sentiment, round(sentiment_stddev, 6) AS sentiment_stddev, positive_mentions, negative_mentions, neutral_mentions, round(avg_confidence, 6) AS avg_confidence, first_mention, last_mention, window_start, window_start + INTERVAL '1 day' AS window_end,
  round(positive_ratio, 6) AS positive_ratio, round(negative_ratio, 6) AS negative_ratio, round(sentiment_score, 6) AS sentiment_score, round(positive_ratio - negative_ratio, 6) AS net_sentiment, round((epoch(last_mention) - epoch(first_mention)) / 3600, 6) AS mention_duration_hours, hour(window_start)::INT AS hour, dayname(window_start) AS day_of_week, (dayofweek(window_start) IN (0, 6))::INT AS is_weekend FROM b""",
    "share_of_voice_weekly": f"""WITH {_b('7 days', '0.9')}, f AS (SELECT * FROM b WHERE mention_count >= 5), s AS (SELECT *, sum(mention_count) OVER w AS total_mentions, count(*) OVER w AS active_brands, avg(sentiment_score) OVER w AS market FROM f WINDOW w AS (PARTITION BY window_start)),
  r AS (SELECT *, mention_count * 100.0::DOUBLE / total_mentions AS sov FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY window_start ORDER BY sov DESC, brand) AS sov_rank, lag(sov) OVER (PARTITION BY brand ORDER BY window_start) AS p FROM r)
  SELECT window_start, brand, mention_count, round(sentiment_score, 6) AS sentiment_score, total_mentions::BIGINT AS total_mentions, active_brands, round(sov, 6) AS share_of_voice, round(sentiment_score - market, 6) AS relative_sentiment, round(mention_count / total_mentions * active_brands, 6) AS market_concentration, sov_rank::INT AS sov_rank,
  round(coalesce(sov - p, 0), 6) AS sov_change, round(CASE WHEN p <> 0 THEN (sov - p) / p * 100 ELSE 0 END, 6) AS sov_change_percent, CASE WHEN sov > 40 THEN 'Dominant' WHEN sov > 20 THEN 'Leader' WHEN sov > 10 THEN 'Challenger' WHEN sov > 5 THEN 'Niche' ELSE 'Emerging' END AS market_position FROM k""",
    "competitor_comparison": f"""WITH {_b('7 days')}, f AS (SELECT * FROM b WHERE brand IN ('brand#11', 'brand#12', 'brand#13', 'brand#21')), s AS (SELECT *, sum(mention_count) OVER w AS tm, sum(CASE WHEN brand = 'brand#11' THEN sentiment_score ELSE 0 END) OVER w AS ts_, sum(CASE WHEN brand = 'brand#11' THEN mention_count ELSE 0 END) OVER w AS tn FROM f WINDOW w AS (PARTITION BY window_start))
  SELECT window_start, brand, mention_count, round(sentiment_score, 6) AS sentiment_score, (row_number() OVER (PARTITION BY window_start ORDER BY mention_count DESC, brand))::INT AS market_rank, (row_number() OVER (PARTITION BY window_start ORDER BY sentiment_score DESC, brand))::INT AS sentiment_rank, round(mention_count * 100.0::DOUBLE / tm, 6) AS market_share,
  round(CASE WHEN brand = 'brand#11' THEN 0 ELSE ts_ - sentiment_score END, 6) AS sentiment_gap, (CASE WHEN brand = 'brand#11' THEN 0 ELSE tn - mention_count END)::BIGINT AS mention_gap FROM s""",
    "brand_momentum": f"""WITH {_b('7 days', '0.9')}, a AS (SELECT window_start, brand, sentiment_score AS s, mention_count AS n, avg(sentiment_score) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS m3, avg(sentiment_score) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS m7, avg(mention_count) OVER (w ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS v14,
  lag(sentiment_score, 7) OVER w AS p, stddev_samp(sentiment_score) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS vol FROM b WINDOW w AS (PARTITION BY brand ORDER BY window_start)), c AS (SELECT *, coalesce((s - p) / 7, 0) AS mo, coalesce((s - p) * 100 / nullif(abs(p), 0), 0) AS roc FROM a), d AS (SELECT *, coalesce(mo - lag(mo) OVER (PARTITION BY brand ORDER BY window_start), 0) AS v FROM c)
  SELECT window_start, brand, round(m3, 6) + 0 AS sentiment_ma_3, round(m7, 6) + 0 AS sentiment_ma_7, round(v14, 6) AS volume_ma_14, round(mo, 6) + 0 AS sentiment_momentum, round(roc, 6) + 0 AS sentiment_roc, round(v, 6) + 0 AS sentiment_velocity, round(vol, 6) AS sentiment_volatility,
  CASE WHEN mo > 2 THEN 'strong_uptrend' WHEN mo > 0.5 THEN 'uptrend' WHEN mo < -2 THEN 'strong_downtrend' WHEN mo < -0.5 THEN 'downtrend' ELSE 'sideways' END AS momentum_trend,
  CASE WHEN mo > 0 AND v > 0 THEN 'accelerating_positive' WHEN mo > 0 AND v < 0 THEN 'decelerating_positive' WHEN mo < 0 AND v < 0 THEN 'accelerating_negative' WHEN mo < 0 AND v > 0 THEN 'decelerating_negative' ELSE 'neutral' END AS momentum_signal,
  round(abs(mo) / (vol + 1), 6) AS trend_strength, round(s + mo * 3, 6) + 0 AS projected_sentiment, CASE WHEN vol < 5 THEN 'high' WHEN vol < 10 THEN 'medium' ELSE 'low' END AS projection_confidence FROM d""",
    "feature_sentiment": f"""WITH {_M}, g AS (SELECT brand, aspect, count(*) AS n, avg(y) AS a, avg(confidence) AS c, count(*) FILTER (y = 1) AS p FROM m GROUP BY 1, 2)
  SELECT brand, aspect, n AS mention_count, round(a, 6) AS avg_sentiment, round(c, 6) AS avg_confidence, p AS positive_count, round((a * 2 - 1) * 100, 6) AS feature_score, round(p / n, 6) AS positive_ratio, round((a * 2 - 1) * 100 * c, 6) AS confidence_weighted, (row_number() OVER (PARTITION BY brand ORDER BY n DESC, aspect))::INT AS feature_rank, (p / n > 0.7)::INT AS is_strength, (p / n < 0.3)::INT AS is_weakness FROM g""",
    "top_brands": f"""WITH {_b('7 days')}, f AS (SELECT *, mention_count * 100.0::DOUBLE / sum(mention_count) OVER (PARTITION BY window_start) AS sov FROM b WHERE mention_count >= 1) SELECT brand, round(avg(sov), 6) AS avg_sov, sum(mention_count)::BIGINT AS total_mentions FROM f GROUP BY 1 ORDER BY avg(sov) DESC, brand LIMIT 5""",
    "brand_insights": f"""WITH {_b('7 days')}, g AS (SELECT brand, avg(sentiment_score) AS s, avg(mention_count) AS n, sum(mention_count)::BIGINT AS t, stddev_samp(sentiment_score) AS v, arg_max(sentiment_score, window_start) AS ls, arg_max(mention_count, window_start) AS ln FROM b GROUP BY 1), x AS (SELECT * FROM g WHERE brand = 'brand#11')
  SELECT x.brand, round(x.s, 6) AS avg_sentiment, round(x.n, 6) AS avg_mentions, x.t AS total_mentions, round(x.v, 6) AS volatility, CASE WHEN coalesce(x.v, 0) < 10 THEN 'stable' ELSE 'volatile' END AS stability, round(x.ls, 6) AS latest_sentiment, x.ln AS latest_mentions, g.brand AS competitor, round(g.s, 6) AS competitor_sentiment, round(x.s - g.s, 6) AS sentiment_gap, CASE WHEN x.s - g.s > 0 THEN 'ahead' ELSE 'behind' END AS competitive_position
  FROM x, g WHERE g.brand IN ('brand#12', 'brand#13', 'brand#21')""",
    "brand_matrix": f"""WITH {_b('7 days')}, g AS (SELECT brand, avg(sentiment_score) AS s, avg(mention_count) AS n FROM b GROUP BY 1) SELECT brand, round((s - avg(s) OVER ()) / stddev_samp(s) OVER (), 6) AS sentiment_score, round((n - avg(n) OVER ()) / stddev_samp(n) OVER (), 6) AS mention_count FROM g""",
    "brand_positioning": f"""WITH {_b('7 days')}, f AS (SELECT *, mention_count * 100.0::DOUBLE / sum(mention_count) OVER (PARTITION BY window_start) AS sov FROM b), g AS (SELECT brand, avg(sov) AS v, avg(sentiment_score) AS s, sum(mention_count)::BIGINT AS t FROM f GROUP BY 1 ORDER BY v DESC, brand LIMIT 15), q AS (SELECT *, median(v) OVER () AS mv, median(s) OVER () AS ms FROM g)
  SELECT brand, round(v, 6) AS avg_sov, round(s, 6) AS avg_sentiment, t AS total_mentions, CASE WHEN v >= mv AND s >= ms THEN 'leader' WHEN v >= mv THEN 'contested' WHEN s >= ms THEN 'niche' ELSE 'laggard' END AS quadrant FROM q""",
    "parsed_brand_pairs": "SELECT l_orderkey, l_linenumber, lower(p_brand) AS brand, round(1 - l_discount, 2) AS confidence FROM lineitem JOIN part ON l_partkey = p_partkey",
    "primary_brands": "SELECT lower(p_brand) AS primary_brand, count(*) AS count FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "event_statistics": "SELECT 'value' AS \"column\", count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS stddev, min(value) AS min, max(value) AS max FROM events UNION ALL SELECT 'user_id', count(user_id), round(avg(user_id), 6), round(stddev_samp(user_id), 6), min(user_id)::DOUBLE, max(user_id)::DOUBLE FROM events",
    "event_correlations": "SELECT 'event_id' AS a, 'user_id' AS b, round(corr(event_id, user_id), 6) AS corr FROM events UNION ALL SELECT 'event_id', 'value', round(corr(event_id, value), 6) FROM events UNION ALL SELECT 'user_id', 'value', round(corr(user_id, value), 6) FROM events",
    "viral_samples": """WITH v AS (SELECT event_type AS topic, value, props, row_number() OVER (PARTITION BY event_type ORDER BY props, event_id) AS k FROM events WHERE value > 0.7)
  SELECT topic, count(*) AS viral_count, round(avg(value), 6) AS avg_virality, string_agg(props, '|' ORDER BY k) FILTER (k <= 5) AS sample_texts FROM v GROUP BY 1""",
    "brand_samples": f"""WITH {_M}, r AS (SELECT time_bucket(INTERVAL '7 days', ts, TIMESTAMP '1970-01-01') AS window_start, brand, aspect, row_number() OVER (PARTITION BY time_bucket(INTERVAL '7 days', ts, TIMESTAMP '1970-01-01'), brand ORDER BY ts, aspect) AS k FROM m WHERE confidence >= 0.9::DOUBLE)
  SELECT window_start, brand, count(*) AS mention_count, string_agg(aspect, '|' ORDER BY k) FILTER (k <= 5) AS sample_texts, count(DISTINCT aspect) FILTER (k <= 5)::INT AS unique_text_count FROM r GROUP BY 1, 2""",
    "strategic_summary": f"""WITH {_b('7 days')}, i AS (SELECT brand, window_start, sentiment_score AS s, mention_count AS n, coalesce((sentiment_score - lag(sentiment_score, 7) OVER (PARTITION BY brand ORDER BY window_start)) / 7, 0) AS mo FROM b WHERE mention_count >= 1),
  g AS (SELECT brand, avg(s) AS s, avg(n) AS n, arg_max(s, window_start) AS ls, arg_max(mo, window_start) AS lm FROM i GROUP BY 1), x AS (SELECT * FROM g WHERE brand = 'brand#11'),
  r AS (SELECT count(*) AS rivals, count(*) FILTER (x.s > g.s) AS ahead, coalesce(string_agg(g.brand, '|' ORDER BY g.brand) FILTER (x.s - g.s > 10), '') AS opportunities, coalesce(string_agg(g.brand, '|' ORDER BY g.brand) FILTER (x.s - g.s < -10), '') AS threats FROM g, x WHERE g.brand IN ('brand#12', 'brand#13', 'brand#21')),
  a AS (SELECT list_filter([CASE WHEN ls < -20 THEN 'critical:sentiment' END, CASE WHEN ls < 0 AND ls >= -20 THEN 'high:sentiment' END, CASE WHEN lm < -2 THEN 'high:trend' END, CASE WHEN lm > 2 THEN 'medium:trend' END, CASE WHEN n < 100 THEN 'medium:visibility' END], lambda v: v IS NOT NULL) AS recs FROM x)
  SELECT brand, printf('%s: %s on the whole (%.1f)', brand, CASE WHEN s > 0 THEN 'liked' ELSE 'disliked' END, s) || CASE WHEN rivals > 0 THEN printf('; ahead of %d/%d rivals', ahead, rivals) ELSE '' END || CASE WHEN lm > 0 THEN '; getting better' ELSE '; not getting better' END || '; work on: ' || CASE WHEN len(recs) > 0 THEN array_to_string(list_transform(list_slice(recs, 1, 3), lambda v: split_part(v, ':', 2)), ', ') ELSE 'nothing urgent' END AS strategic_summary,
  opportunities, threats, array_to_string(recs, '|') AS recommendations FROM x, r, a""",
    # The regression on a constant, the last value and the last change, by partial sums of squares.
    "unit_root_test": f"""WITH {_b('7 days')}, v AS (SELECT brand, sentiment_score AS y, lag(sentiment_score) OVER w AS y1, lag(sentiment_score, 2) OVER w AS y2 FROM b WINDOW w AS (PARTITION BY brand ORDER BY window_start)), l AS (SELECT brand, y - y1 AS d, y1 AS x, y1 - y2 AS z FROM v WHERE y2 IS NOT NULL),
  c AS (SELECT brand, count(*) AS n, var_pop(x) AS xx, var_pop(z) AS zz, var_pop(d) AS dd, covar_pop(x, z) AS xz, covar_pop(x, d) AS xd, covar_pop(z, d) AS zd FROM l GROUP BY 1), q AS (SELECT brand, n, xx - xz * xz / zz AS px, xd - xz * zd / zz AS pxd, dd - zd * zd / zz AS pd FROM c), t AS (SELECT brand, n, pxd / px / sqrt((pd - pxd * pxd / px) / (n - 3) / px) AS s FROM q)
  SELECT brand, round(s, 6) AS statistic, s < -2.8615::DOUBLE - 2.738::DOUBLE / n - 8.36::DOUBLE / (n * n) AS stationary FROM t""",
    "streamed_hourly": f"WITH {_E} SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL '1 hour' AS window_end, topic, count(*) AS mention_count, count(y) AS labelled, sum(y) AS sentiment_sum, avg(y) AS avg_sentiment, count(*) FILTER (y = 1) AS positive_count FROM e GROUP BY 1, 2, 3",
}


def _streamed(spark: SparkSession, d: str) -> DataFrame:
    """events as a stream of files, aggregated by hour in complete mode and read back."""
    from tidemark.streaming import streams

    path = f"{d}/events.parquet"
    schema = spark.read.parquet(path).schema
    kind = F.col("event_type")
    label = F.when(kind.isin("purchase", "signup"), 1.0).when(kind == "error", 0.0)
    # A single file is streamed through its folder, with a filter on the name.
    folder, name = path.rsplit("/", 1)
    source = spark.readStream.schema(schema).option("pathGlobFilter", name if not _is_dir(spark, path) else "*").parquet(folder if not _is_dir(spark, path) else path)
    rows = source.select(F.col("ts").cast("timestamp").alias("timestamp"), kind.alias("topic"), label.alias("sentiment"))
    base = streams.work_folder(spark)
    q = streams.windowed(rows, ["topic"]).writeStream.outputMode("complete").option("checkpointLocation", f"{base}/state").foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(f"{base}/out")).trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


def _is_dir(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def _insights(spark, d):
    out = brand.insight_table(_brands(spark, d, "1 week"), TARGET, RIVALS)
    return rounded(out.select("brand", "avg_sentiment", "avg_mentions", "total_mentions", "volatility", "stability", F.col("latest.sentiment_score").alias("latest_sentiment"), F.col("latest.mention_count").alias("latest_mentions"), F.explode("competitors").alias("c")).select("*", F.col("c.brand").alias("competitor"), F.col("c.average_sentiment").alias("competitor_sentiment"), "c.sentiment_gap", "c.competitive_position").drop("c"))


def _summary(spark, d):
    out = brand.insight_table(brand.brand_momentum(brand.share_of_voice(_brands(spark, d, "1 week"), 1)), TARGET, RIVALS)
    given = F.transform("recommendations", lambda r: F.concat_ws(":", r["priority"], r["area"]))
    return out.select("brand", "strategic_summary", F.array_join("opportunities", "|").alias("opportunities"), F.array_join("threats", "|").alias("threats"), F.array_join(given, "|").alias("recommendations"))


def _decomposed(spark, d):
    rows = _events(spark, d).groupBy(F.window("timestamp", "1 day").alias("w")).agg(F.count("*").cast("double").alias("tweet_count")).select(F.col("w.start").alias("window_start"), "tweet_count")
    return rounded(timeseries.decompose(rows, "tweet_count", 7)).select("window_start", "tweet_count", F.col("phase").cast("int").alias("phase"), "trend", "seasonal", "residual")


def _pairs(spark, d):
    rows = readers.brand_mentions(spark, d).select("l_orderkey", "l_linenumber", F.array(F.format_string("%s:%.2f", F.initcap("brand"), "confidence")).alias("brands"))
    return brand.parse_pairs(rows).drop("brands")


QUERIES = {
    **{f"sentiment_{g}": (lambda s, d, g=g: rounded(timeseries.sentiment_by_time(_events(s, d), g))) for g in ("hourly", "daily", "weekly", "monthly")},
    "sentiment_cube": lambda s, d: rounded(timeseries.trend_cube(_events(s, d))),
    "sentiment_by_hour_of_day": lambda s, d: rounded(timeseries.sentiment_by_part(_events(s, d), "hour")),
    "sentiment_by_day_of_week": lambda s, d: rounded(timeseries.sentiment_by_part(_events(s, d), "day_of_week")),
    "sentiment_anomalies": lambda s, d: rounded(timeseries.rolling_anomalies(timeseries.sentiment_by_time(_events(s, d), "hourly").select("window_start", "avg_sentiment"))),
    "sentiment_momentum": lambda s, d: rounded(timeseries.momentum(timeseries.sentiment_by_time(_events(s, d), "daily").select("window_start", "avg_sentiment"))),
    "hourly_volume": lambda s, d: timeseries.volume_by_hour(_events(s, d)),
    "volume_anomalies": lambda s, d: rounded(timeseries.volume_anomalies(_events(s, d))),
    "general_brand_series": lambda s, d: rounded(timeseries.general_series(_events(s, d))),
    "seasonal_decomposition": _decomposed,
    "weekday_pivot": lambda s, d: rounded(timeseries.weekday_pivot(_events(s, d))),
    "emerging_topics": lambda s, d: rounded(topics.emerging_topics(_events(s, d), "topic", "1 day", 0.2)),
    "topic_sentiment": lambda s, d: rounded(topics.topic_sentiment(_events(s, d), "topic")),
    "polarising_brands": lambda s, d: rounded(topics.polarising(readers.brand_mentions(s, d), "aspect")),
    "cluster_statistics": lambda s, d: rounded(topics.cluster_statistics(s.read.parquet(f"{d}/embeddings.parquet").select(F.col("label").alias("cluster"), (F.col("vec_id") % 2).alias("sentiment")))),
    "topic_histogram": lambda s, d: topics.histogram(_events(s, d), "topic"),
    "viral_topics": lambda s, d: rounded(topics.viral_topics(_events(s, d), "topic", "value")),
    "topic_network": lambda s, d: rounded(topics.topic_edges(readers.brand_mentions(s, d).groupBy("l_orderkey").agg(F.collect_set("aspect").alias("t")), "t")),
    "word_overlap": lambda s, d: rounded(topics.word_overlap(s.read.parquet(f"{d}/part.parquet").groupBy(F.col("p_brand").alias("topic")).agg(F.array_sort(F.collect_set("p_name")).alias("words")))),
    "brand_sentiment_daily": lambda s, d: rounded(_brands(s, d)),
    "share_of_voice_weekly": lambda s, d: rounded(brand.share_of_voice(_brands(s, d, "1 week", 0.9))).select("window_start", "brand", "mention_count", "sentiment_score", "total_mentions", "active_brands", "share_of_voice", "relative_sentiment", "market_concentration", "sov_rank", "sov_change", "sov_change_percent", "market_position"),
    "competitor_comparison": lambda s, d: rounded(brand.compare_competitors(_brands(s, d, "1 week"), TARGET, RIVALS)).select("window_start", "brand", "mention_count", "sentiment_score", "market_rank", "sentiment_rank", "market_share", "sentiment_gap", "mention_gap"),
    "brand_momentum": lambda s, d: rounded(brand.brand_momentum(_brands(s, d, "1 week", 0.9))).select("window_start", "brand", "sentiment_ma_3", "sentiment_ma_7", "volume_ma_14", "sentiment_momentum", "sentiment_roc", "sentiment_velocity", "sentiment_volatility", "momentum_trend", "momentum_signal", "trend_strength", "projected_sentiment", "projection_confidence"),
    "feature_sentiment": lambda s, d: rounded(brand.aspect_table(readers.brand_mentions(s, d), "aspect")),
    "top_brands": lambda s, d: rounded(brand.top_brands(brand.share_of_voice(_brands(s, d, "1 week"), 1))),
    "brand_insights": _insights,
    "brand_matrix": lambda s, d: rounded(brand.normalised_matrix(_brands(s, d, "1 week"), ["sentiment_score", "mention_count"])),
    "brand_positioning": lambda s, d: rounded(brand.positioning(brand.share_of_voice(_brands(s, d, "1 week"), 1))),
    "parsed_brand_pairs": _pairs,
    "primary_brands": lambda s, d: brand.primary_brands(readers.brand_mentions(s, d).select(F.array("brand").alias("brands"))),
    "event_statistics": lambda s, d: _statistics(s, d),
    "event_correlations": lambda s, d: _correlations(s, d),
    "streamed_hourly": _streamed,
    "strategic_summary": _summary,
    "viral_samples": lambda s, d: rounded(topics.viral_topics(s.read.parquet(f"{d}/events.parquet").withColumnRenamed("event_type", "topic"), "topic", "value", samples="props").withColumn("sample_texts", F.array_join("sample_texts", "|"))),
    "brand_samples": lambda s, d: brand.brand_sentiment(readers.brand_mentions(s, d), "1 week", 0.9, samples="aspect").select("window_start", "brand", "mention_count", F.array_join("sample_texts", "|").alias("sample_texts"), "unique_text_count"),
    "forecast_brands": lambda s, d: forecast.forecast(_brands(s, d, "1 week"), "brand", "sentiment_score", step_days=7.0),
    "forecast_metrics": lambda s, d: forecast.forecast_metrics(timeseries.sentiment_by_time(_events(s, d), "daily"), ["tweet_count", "avg_sentiment"]),
    "forecast_sentiment": lambda s, d: forecast.forecast_sentiment(_events(s, d)),
    "forecast_topics": lambda s, d: forecast.forecast_topics(_events(s, d), "topic"),
    "isolation_anomalies": lambda s, d: forecast.isolation_anomalies(_brands(s, d, "1 week"), "brand", ["sentiment_score", "mention_count"]),
    "unit_root_test": lambda s, d: rounded(forecast.unit_root(_brands(s, d, "1 week"), "brand", "sentiment_score")),
}


def _statistics(spark, d):
    from tidemark.operators.features import statistics

    return rounded(statistics(spark.read.parquet(f"{d}/events.parquet"), ["value", "user_id"]))


def _correlations(spark, d):
    from tidemark.operators.features import correlations

    return rounded(correlations(spark.read.parquet(f"{d}/events.parquet"), ["event_id", "user_id", "value"]))
