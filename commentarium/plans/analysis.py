"""Queries on fans, terms, alerts, labels and clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commentarium.functions import text as T
from commentarium.operators import alerts as A
from commentarium.operators import evaluation as E
from commentarium.operators import fans as N
from commentarium.operators import scoring, sentiment, terms
from commentarium.operators.cleaning import clean_mask
from commentarium.plans import views as V
from commentarium.plans.sentiment import KEYWORDS
from commentarium.session import written
from commentarium.tables import distinct_fans, latest, load

SAMPLE_ROWS = 250


def agg5_fan_features(spark: SparkSession, sf: str) -> DataFrame:
    return N.fan_features(V.scored(spark, sf))


def ml1_standard_scores(spark: SparkSession, sf: str) -> DataFrame:
    rows = N.standard_scores(distinct_fans(load(spark, sf, "fans")).withColumn("avg_sentiment", F.coalesce("avg_sentiment", F.lit(0.0))))
    return rows.select("author_channel_id", *[F.round(F.col(f"z_{f}") + 1e-9, 4).alias(f"z_{f}") for f in N.FEATURES])


def ml5_rule_labels(spark: SparkSession, sf: str) -> DataFrame:
    """The rule that each fan's own z-scores meet first."""
    rows = N.standard_scores(distinct_fans(load(spark, sf, "fans")).withColumn("avg_sentiment", F.coalesce("avg_sentiment", F.lit(0.0))))
    return rows.select("author_channel_id", N.rule_label().alias("label"))


def ml2_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Fans with their k-means segment."""
    placed, _, _ = N.segment(distinct_fans(load(spark, sf, "fans")).withColumn("avg_sentiment", F.coalesce("avg_sentiment", F.lit(0.0))))
    return placed.select("author_channel_id", "cluster_id", "cluster_label")


def ml6_segment_records(spark: SparkSession, sf: str) -> DataFrame:
    _, records, _ = N.segment(distinct_fans(load(spark, sf, "fans")).withColumn("avg_sentiment", F.coalesce("avg_sentiment", F.lit(0.0))))
    return records


def ml3_k_log(spark: SparkSession, sf: str) -> DataFrame:
    """Every k tried with its silhouette and inertia, and which was chosen."""
    _, _, log = N.segment(distinct_fans(load(spark, sf, "fans")).withColumn("avg_sentiment", F.coalesce("avg_sentiment", F.lit(0.0))))
    return log


def dq16_fan_map(spark: SparkSession, sf: str) -> DataFrame:
    """Each fan's activity, sentiment and segment, for a plot."""
    placed, _, _ = N.segment(distinct_fans(load(spark, sf, "fans")).withColumn("avg_sentiment", F.coalesce("avg_sentiment", F.lit(0.0))))
    return placed.select("author_channel_id", "author", "comment_count", "avg_sentiment", "likes_earned", "videos_commented", "recency", "consistency", "cluster_label")


def tfidf_trending(spark: SparkSession, sf: str) -> DataFrame:
    return terms.trending(V.cleaned(spark, sf).filter(clean_mask()), "comment_id", "text")


def stat6_video_shifts(spark: SparkSession, sf: str) -> DataFrame:
    """t-test of each video's sentiment against the channel's: statistic, difference, size of the family."""
    sure = sentiment.confident(V.scored(spark, sf))
    return A.mean_shift(sure, "video_id", "sentiment", sure, A.MIN_VIDEO).select("item", "n", F.round(F.col("t") + 1e-9, 3).alias("t"), "delta", "m")


def stat7_volume(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.volume(V.scored(spark, sf), "video_id", "velocity")
    return rows.select("item", "n", F.round(F.col("t") + 1e-9, 3).alias("z"), "m", (F.abs("t") > 2).alias("naive"), (F.abs("t") >= A.MIN_Z).alias("extreme"))


def stat8_keyword_shifts(spark: SparkSession, sf: str) -> DataFrame:
    """t-test of the seven fixed keywords, as the SQL has them; ``stat8_trending_shifts`` tests the terms of the comments themselves."""
    sure = sentiment.confident(V.scored(spark, sf))
    hits = sentiment.keyword_hits(sure, "text", {k: T.keyword_pattern(k, False) for k in KEYWORDS})
    return A.mean_shift(hits, "keyword", "keyword", sure, A.MIN_MENTIONS).select("item", "n", F.round(F.col("t") + 1e-9, 3).alias("t"), "delta", "m")


def _stored_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores written once, as three families read them."""
    return written(V.scored(spark, sf).select("comment_id", "video_id", "text", "sentiment_score", "sentiment_label"), "scored")


def stat8_trending_shifts(spark: SparkSession, sf: str) -> DataFrame:
    """t-test of the terms that stand out in all clean comments: statistic, difference, size of the family."""
    rows = _stored_scores(spark, sf)
    sure = sentiment.confident(rows)
    hits = sentiment.keyword_hits(sure, "text", {k: T.keyword_pattern(k, False) for k in terms.keywords(rows, "comment_id", "text")})
    return A.mean_shift(hits, "keyword", "keyword", sure, A.MIN_MENTIONS).select("item", "n", F.round(F.col("t") + 1e-9, 3).alias("t"), "delta", "m")


def _alerts(spark: SparkSession, sf: str) -> DataFrame:
    rows = _stored_scores(spark, sf)
    return A.all_alerts(rows, terms.keywords(rows, "comment_id", "text"))


def stat9_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """All three families with p-values, both corrections and what fires."""
    return _alerts(spark, sf)


def agg17_alert_summary(spark: SparkSession, sf: str) -> DataFrame:
    return A.family_summary(_alerts(spark, sf))


def dq2_top_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """The first three alerts that fire, in the order of the families, each with a short text of its size."""
    return A.first_alerts(_alerts(spark, sf))


def stat5_corrections(spark: SparkSession, sf: str) -> DataFrame:
    """Bonferroni and Benjamini-Hochberg on one p-value a video: the share of videos with at least as many comments, so all of it can be checked in SQL."""
    from commentarium.functions.stats import corrected, numbered

    per = V.comments(spark, sf).filter(F.col("video_id").isNotNull()).groupBy("video_id").agg(F.count("*").alias("n"))
    first = numbered(per, [F.col("n").asc(), F.col("video_id").asc()], "place").groupBy("n").agg(F.min("place").alias("place"))
    total = per.agg(F.count("*").alias("total"))
    above = F.col("total") - F.col("place") + 1
    p = per.join(first, "n").join(F.broadcast(total)).withColumn("p", F.pow(above / F.col("total"), 2)).withColumn("family", F.lit("volume"))
    out = corrected(p, "p", "family", "video_id")
    return out.select("video_id", F.col("rank").cast("bigint").alias("rank"), "m", "bonferroni", "bh", F.round(F.col("bonferroni_p") + 1e-12, 6).alias("bonferroni_p"), F.round(F.col("bh_p") + 1e-12, 6).alias("bh_p"))


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Comments with a valid human label and the scores of their text; one row a comment."""
    rows = load(spark, sf, "human_labels").withColumn("human", F.initcap(F.trim("human_label"))).filter(F.col("human").isin(list(E.CLASSES)))
    one = latest(rows, "comment_id", [F.col("human").asc(), F.col("text").asc_nulls_last()])
    return scoring.lexicon_scores(one.withColumn("cleaned_text", T.cleaned(F.col("text")))).drop("label")


def agg18_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy and macro F1 of the scores: all rows, those that are certain, those that look sarcastic (Uncertain counts as Neutral)."""
    rows = _labelled(spark, sf).withColumn("guess", F.when(F.col("sentiment_label") == "Uncertain", "Neutral").otherwise(F.col("sentiment_label")))
    slices = F.array_compact(F.array(F.lit("all"), F.when(F.col("sentiment_label") != "Uncertain", "confident"), F.when(T.matches(F.col("text"), T.SARCASM_SLICE), "sarcasm")))
    return E.metrics(rows.withColumn("slice", F.explode(slices)), "human", "guess", ["slice"]).select("slice", "n", "accuracy", "macro_f1")


def agg18_f1(spark: SparkSession, sf: str) -> DataFrame:
    rows = _labelled(spark, sf).withColumn("guess", F.when(F.col("sentiment_label") == "Uncertain", "Neutral").otherwise(F.col("sentiment_label")))
    return E.f1_scores(rows, "human", "guess").select("class", "tp", "fp", "fn", "f1")


def ml10_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    return E.calibrate(_labelled(spark, sf), "human")[0]


def ml10_cuts(spark: SparkSession, sf: str) -> DataFrame:
    return E.calibrate(_labelled(spark, sf), "human")[1]


def ml10_best(spark: SparkSession, sf: str) -> DataFrame:
    """The threshold and the cuts that agree best with the human labels."""
    return E.best_settings(_labelled(spark, sf), "human")


def ml9_quotas(spark: SparkSession, sf: str) -> DataFrame:
    return E.quotas(V.cleaned(spark, sf).filter(clean_mask()), "video_id", SAMPLE_ROWS)


def ml9_sample(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.cleaned(spark, sf).filter(clean_mask()).select("comment_id", "video_id")
    return E.stratified_sample(rows, "video_id", "comment_id", SAMPLE_ROWS).select("comment_id", "video_id")


QUERIES = {f.__name__: f for f in (
    agg5_fan_features, ml1_standard_scores, ml5_rule_labels, ml2_segments, ml6_segment_records, ml3_k_log, dq16_fan_map, tfidf_trending, stat6_video_shifts, stat7_volume,
    stat8_keyword_shifts, stat8_trending_shifts, stat9_alerts, agg17_alert_summary, dq2_top_alerts, stat5_corrections, agg18_metrics, agg18_f1, ml10_thresholds, ml10_cuts, ml10_best, ml9_quotas, ml9_sample,
)}

_SC = "WITH" + V.SCORED_SQL
_Z = {f: (f"ln(1 + greatest(coalesce({f}, 0), 0))" if f in N.LOGGED else f"CAST(coalesce({f}, 0) AS DOUBLE)") for f in N.FEATURES}
_FANS = "WITH f AS (SELECT DISTINCT * FROM fans WHERE author_channel_id IS NOT NULL), s AS (SELECT " + ", ".join(f"avg({x}) AS m_{f}, stddev_pop({x}) AS s_{f}" for f, x in _Z.items()) + " FROM f), z AS (SELECT author_channel_id, " + ", ".join(f"CASE WHEN s_{f} > 0 THEN ({x} - m_{f}) / s_{f} ELSE 0 END AS z_{f}" for f, x in _Z.items()) + " FROM f, s) "
_RULES = " ".join("WHEN " + " AND ".join(f"z_{f} {op} {b}" for f, op, b in cond) + f" THEN '{label}'" for label, cond in N.RULES)
_TERMS = """, tk AS (SELECT comment_id AS id, list_filter(regexp_extract_all(regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', '  ', 'g'), '(?:^| )([a-z]{3,})(?: |$)', 1), lambda t: t NOT IN """ + V.words_in(terms.STOPWORDS) + """) AS w FROM cl WHERE NOT is_spam AND NOT is_duplicate),
    tm AS (SELECT id, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))) AS word FROM tk),
    tf AS (SELECT id, word, count(*) AS tf FROM tm GROUP BY ALL), kept AS (SELECT word, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY word HAVING count(*) >= 2 ORDER BY cf DESC, word LIMIT 500),
    wt AS (SELECT id, word, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM tk)) / (1 + df)) + 1) AS x FROM tf JOIN kept USING (word)), nm AS (SELECT id, sqrt(sum(x * x)) AS norm FROM wt GROUP BY id)
    SELECT word, round(sum(x / norm) + 1e-9, 4) AS score, count(*) AS count FROM wt JOIN nm USING (id) GROUP BY word ORDER BY score DESC, word LIMIT 30"""
_TTEST = """, g AS (SELECT {key} AS item, count(*) AS n, avg(sentiment_score) AS mean, stddev_samp(sentiment_score) AS sd FROM {rows} WHERE {key} IS NOT NULL GROUP BY 1 HAVING count(*) >= {least}), mu AS (SELECT avg(sentiment_score) AS mu FROM cdf)
    SELECT item, n, CASE WHEN n > 1 THEN CASE WHEN sd = 0 THEN CASE WHEN mean = mu THEN NULL ELSE sign(mean - mu) * CAST('inf' AS DOUBLE) END ELSE round((mean - mu) / (sd / sqrt(n)) + 1e-9, 3) + 0.0 END END AS t, round(mean - mu + 1e-9, 4) + 0.0 AS delta, count(*) OVER () AS m FROM g, mu"""
_KHITS = ", h AS (SELECT unnest([" + ", ".join(f"CASE WHEN regexp_matches(lower(text), {V.q(T.keyword_pattern(k, False))}, 'i') THEN '{k}' END" for k in KEYWORDS) + "]) AS keyword, sentiment_score FROM cdf)"
_LAB = V.SCORED_SQL.replace(V.CLEANED_SQL, "")
_LABELLED = f"""WITH l0 AS (SELECT *, upper(left(trim(human_label, ' '), 1)) || lower(substr(trim(human_label, ' '), 2)) AS human FROM human_labels WHERE comment_id IS NOT NULL),
    l1 AS (SELECT * EXCLUDE (cleaned_text) FROM l0 WHERE human IN ('Positive', 'Neutral', 'Negative') QUALIFY row_number() OVER (PARTITION BY comment_id ORDER BY human, text NULLS LAST) = 1),
    l2 AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(coalesce(text, '')), {V.q(T.URL)}, ' ', 'gi'), {V.q(T.HANDLE)}, ' ', 'g'), '[{T.WS}]+', ' ', 'g'), ' ') AS cleaned_text FROM l1),
    cl AS (SELECT *, regexp_extract_all(lower(cleaned_text), '[\\p{{L}}\\p{{N}}]+') AS w, false AS is_spam, false AS is_duplicate FROM l2)""" + _LAB
_F1 = "CASE WHEN 2 * {tp} + {fp} + {fn} > 0 THEN 2 * {tp} / (2 * {tp} + {fp} + {fn}) {otherwise} END"


def _counts(rows: str, keys: str) -> str:
    k = keys + ", " if keys else ""
    return f"(SELECT {k}class, count(*) FILTER (human = class AND guess = class) AS tp, count(*) FILTER (human <> class AND guess = class) AS fp, count(*) FILTER (human = class AND guess <> class) AS fn, count(*) AS n FROM {rows}, (SELECT unnest(['Positive', 'Neutral', 'Negative']) AS class) GROUP BY ALL)"


_BOTTOM = "2 * tp + fp + fn"
_QUOTA = """, sz AS (SELECT video_id, count(*) AS size FROM cl WHERE NOT is_spam AND NOT is_duplicate AND video_id IS NOT NULL GROUP BY video_id),
    b AS (SELECT *, greatest(1, CAST(round_even(250 * size / (SELECT sum(size) FROM sz), 0) AS BIGINT)) AS base, row_number() OVER (ORDER BY size DESC, video_id) - 1 AS place, count(*) OVER () AS groups FROM sz),
    o AS (SELECT 250 - sum(base) AS off FROM b),
    qt AS (SELECT video_id, size, CAST(greatest(base + sign(off) * greatest(floor((abs(off) - place + groups - 1) / groups), 0), 0) AS BIGINT) AS slots FROM b, o)"""
SQL = {
    "agg5_fan_features": _SC + """, r AS (SELECT * FROM sc WHERE author IS NOT NULL AND author_channel_id IS NOT NULL), m AS (SELECT max(published) AS m FROM r)
        SELECT author, author_channel_id, count(*) AS comment_count, count(DISTINCT video_id) AS videos_commented, CAST(sum(like_count) AS BIGINT) AS likes_earned, count(DISTINCT strftime(published, '%G-W%V')) AS consistency,
        CAST(greatest(coalesce(floor((epoch_us(any_value(m)) - epoch_us(max(published))) / 86400000000), 0), 0) AS INT) AS recency, round(coalesce(avg(CASE WHEN sentiment_label <> 'Uncertain' THEN sentiment_score END), 0) + 1e-9, 4) AS avg_sentiment FROM r, m GROUP BY author, author_channel_id""",
    "ml1_standard_scores": _FANS + "SELECT author_channel_id, " + ", ".join(f"round(z_{f} + 1e-9, 4) AS z_{f}" for f in N.FEATURES) + " FROM z",
    "ml5_rule_labels": _FANS + f"SELECT author_channel_id, CASE {_RULES} ELSE '{N.FALLBACK}' END AS label FROM z",
    "tfidf_trending": "WITH" + V.CLEANED_SQL + _TERMS,
    "stat6_video_shifts": _SC + _TTEST.format(key="video_id", rows="cdf", least=A.MIN_VIDEO),
    "stat8_keyword_shifts": _SC + _KHITS + _TTEST.format(key="keyword", rows="h", least=A.MIN_MENTIONS),
    "stat7_volume": _SC + """, g AS (SELECT video_id AS item, count(*) AS n FROM sc WHERE video_id IS NOT NULL GROUP BY 1), s AS (SELECT avg(n) AS mean, stddev_samp(n) AS sd, count(*) AS groups FROM g)
        SELECT item, n, round((n - mean) / sd + 1e-9, 3) + 0.0 AS z, count(*) OVER () AS m, abs((n - mean) / sd) > 2 AS naive, abs((n - mean) / sd) >= 2.5 AS extreme FROM g, s WHERE groups >= 3 AND sd > 0""",
    "stat5_corrections": "WITH" + V.COMMENTS_SQL + """, per AS (SELECT video_id, count(*) AS n FROM cur WHERE video_id IS NOT NULL GROUP BY video_id), p AS (SELECT video_id, power((SELECT count(*) FROM per b WHERE b.n >= a.n) / (SELECT count(*) FROM per), 2) AS p FROM per a),
        r AS (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p, video_id) AS rank FROM p), k AS (SELECT max(rank) AS k FROM r WHERE p <= rank * 0.05::DOUBLE / m)
        SELECT video_id, rank, m, p < 0.05::DOUBLE / m AS bonferroni, coalesce(rank <= k, false) AS bh, round(least(p * m, 1) + 1e-12, 6) AS bonferroni_p, round(least(p * m / rank, 1) + 1e-12, 6) AS bh_p FROM r, k""",
    "agg18_metrics": _LABELLED + f""", gs AS (SELECT human, CASE WHEN sentiment_label = 'Uncertain' THEN 'Neutral' ELSE sentiment_label END AS guess, unnest(['all', CASE WHEN sentiment_label <> 'Uncertain' THEN 'confident' END, CASE WHEN regexp_matches(text, {V.q(T.SARCASM_SLICE)}, 'i') THEN 'sarcasm' END]) AS slice FROM sc), gr AS (SELECT * FROM gs WHERE slice IS NOT NULL)
        SELECT slice, max(n) AS n, round(sum(tp) / max(n) + 1e-9, 4) AS accuracy, round(avg(CASE WHEN {_BOTTOM} > 0 THEN 2 * tp / ({_BOTTOM}) END) + 1e-9, 4) AS macro_f1 FROM {_counts('gr', 'slice')} GROUP BY slice""",
    "agg18_f1": _LABELLED + f", gr AS (SELECT human, CASE WHEN sentiment_label = 'Uncertain' THEN 'Neutral' ELSE sentiment_label END AS guess FROM sc) SELECT class, tp, fp, fn, round(CASE WHEN {_BOTTOM} > 0 THEN 2 * tp / ({_BOTTOM}) ELSE 0 END + 1e-9, 4) AS f1 FROM {_counts('gr', '')}",
    "ml10_thresholds": _LABELLED + f""", gr AS (SELECT *, CASE WHEN greatest(neg_prob, neu_prob, pos_prob) < threshold THEN 'Uncertain' WHEN pos_prob = greatest(neg_prob, neu_prob, pos_prob) THEN 'Positive' WHEN neg_prob = greatest(neg_prob, neu_prob, pos_prob) THEN 'Negative' ELSE 'Neutral' END AS guess
        FROM sc, (SELECT unnest([{', '.join(f'{x}::DOUBLE' for x in E.THRESHOLDS)}]) AS threshold)), gc AS (SELECT * FROM gr WHERE guess <> 'Uncertain')
        SELECT threshold, round(avg(CASE WHEN {_BOTTOM} > 0 THEN 2 * tp / ({_BOTTOM}) ELSE 0 END) + 1e-9, 4) AS macro_f1, round(max(n) / (SELECT count(*) FROM sc) + 1e-9, 4) AS coverage, max(n) AS n_certain FROM {_counts('gc', 'threshold')} GROUP BY threshold""",
    "ml10_cuts": _LABELLED + f""", gr AS (SELECT *, CASE WHEN sentiment_score > pos_cut THEN 'Positive' WHEN sentiment_score < neg_cut THEN 'Negative' ELSE 'Neutral' END AS guess FROM sc, (SELECT unnest([{', '.join(f'{x}::DOUBLE' for x in E.CUTS)}]) AS pos_cut), (SELECT unnest([{', '.join(f'-{x}::DOUBLE' for x in E.CUTS)}]) AS neg_cut))
        SELECT pos_cut, neg_cut, round(avg(CASE WHEN {_BOTTOM} > 0 THEN 2 * tp / ({_BOTTOM}) ELSE 0 END) + 1e-9, 4) AS macro_f1 FROM {_counts('gr', 'pos_cut, neg_cut')} GROUP BY ALL""",
    "ml9_quotas": "WITH" + V.CLEANED_SQL + _QUOTA + " SELECT video_id, size, slots FROM qt",
    "ml9_sample": "WITH" + V.CLEANED_SQL + _QUOTA + """ SELECT comment_id, video_id FROM (SELECT comment_id, video_id, slots, row_number() OVER (PARTITION BY video_id ORDER BY md5(comment_id || ':42'), comment_id) AS place FROM cl JOIN qt USING (video_id) WHERE NOT is_spam AND NOT is_duplicate) WHERE place <= slots""",
}

_FINE = {k: SQL[k].replace("+ 1e-9, 4) AS macro_f1", "+ 1e-9, 10) AS macro_f1") for k in ("ml10_thresholds", "ml10_cuts")}
SQL["ml10_best"] = f"""WITH th AS ({_FINE["ml10_thresholds"]}), ct AS ({_FINE["ml10_cuts"]}),
    b AS (SELECT 'threshold' AS setting, threshold AS value, macro_f1 FROM th ORDER BY macro_f1 DESC, threshold LIMIT 1), c AS (SELECT * FROM ct ORDER BY macro_f1 DESC, pos_cut, neg_cut DESC LIMIT 1)
    SELECT setting, value, round(macro_f1, 4) AS macro_f1 FROM (SELECT * FROM b UNION ALL SELECT 'pos_cut', pos_cut, macro_f1 FROM c UNION ALL SELECT 'neg_cut', neg_cut, macro_f1 FROM c)"""
