"""The core against SQL, hand-made cases and invariants."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from commentarium import registry
from commentarium.functions import scalars as X
from commentarium.functions import stats
from commentarium.functions import text as T
from commentarium.operators import alerts, evaluation, fans, routing, scoring, sentiment, terms
from commentarium.operators.cleaning import clean_comments, delta
from commentarium.sources import landed
from commentarium.streaming import comments
from commentarium.tables import hashed_sample, latest

SCHEMA = "comment_id string, text string, ordinal bigint"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(name, check_sql):
    check_sql(registry.queries()[name], registry.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(name, spark, small):
    df = registry.queries()[name](spark, small)
    assert df.columns and df.count() >= 0


def cleaned(spark, texts):
    rows = [(str(k), t, k) for k, t in enumerate(texts)]
    return [r.asDict() for r in clean_comments(spark.createDataFrame(rows, SCHEMA)).orderBy("ordinal").collect()]


SPAM = [
    "see http://a.example/x for more", "go to HTTPS://b.example now", "more at www.c.example today", "thanks @some_user for this", "hello there @abc.def",
    "please subscribe to my page", "Check out my channel people", "check my profile everyone", "follow me for updates", "the link in bio works", "free bitcoin for all",
    "a giveaway starts today", "just DM me now", "write on WhatsApp please", "find us on telegram now", "earn $ 500 a day", "how to make money fast", "send it by cash app today",
    "who's watching in 2024", "whos here in 2025 then", "still watching in 2023 guys", "like if you're still watching", "early gang !!", "notification squad is here",
    "first", "🔥🔥🔥", "ok", "nice", "", None,
]
FINE = ["what a great video this was", "I loved the second chapter a lot", "the first half was better than the rest", "my gang of cats loves this show", "éfollow meé is no rule here"]


def test_spam_rules(spark):
    assert all(r["is_spam"] for r in cleaned(spark, SPAM))
    assert not any(r["is_spam"] for r in cleaned(spark, FINE))


def test_cleaned_text(spark):
    got = cleaned(spark, ["see http://a.example/x  now", "thanks @some_user   a lot", "love it 😍 so much", "été   deux", None])
    assert [r["cleaned_text"] for r in got] == ["see now", "thanks a lot", "love it 😍 so much", "été deux", ""]
    assert got[0]["text"] == "see http://a.example/x  now"


def test_duplicates(spark):
    got = cleaned(spark, ["Great video here", "great VIDEO here!!!", "great video 😍 here", "another one here", "great video here", "🔥", "😍"])
    assert [r["is_duplicate"] for r in got] == [False, True, True, False, True, False, True]


def test_language_gate_and_guess(spark):
    got = cleaned(spark, ["short one", "this is what we have for you and it was not my idea", "no es lo que los niños y las niñas quieren para una tarde", "это очень хорошее видео, спасибо"])
    assert [r["language"] for r in got] == ["und", "en", "es", "ru"]


def test_clean_of_nothing(spark):
    out = clean_comments(spark.createDataFrame([], SCHEMA))
    assert out.count() == 0 and dict(out.dtypes)["is_spam"] == "boolean"


def test_delta_splits(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("",), (None,)], "comment_id string")
    todo, done = delta(rows, spark.createDataFrame([("b",), ("",), (None,)], "comment_id string"), "comment_id")
    assert done.count() == 1 and todo.count() == 3


def test_latest_ties_and_nulls(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), (None, 9), ("b", None)], "k string, o bigint")
    assert sorted(map(tuple, latest(rows, "k", [F.col("o").desc_nulls_last()]).collect())) == [("a", 2), ("b", None)]


def test_hashed_sample_is_bounded_and_stable(spark):
    rows = spark.range(5000).withColumn("s", F.col("id").cast("string"))
    a, b = ({r["s"] for r in hashed_sample(rows, "s", 300).collect()} for _ in range(2))
    assert a == b and len(a) == 300
    assert hashed_sample(rows.limit(0), "s", 10).count() == 0


def test_durations_weeks_days(spark):
    rows = spark.createDataFrame([("PT1H2M3S",), ("PT45S",), ("P1DT2H",), ("",), (None,)], "d string")
    assert [r[0] for r in rows.select(X.parse_duration(F.col("d"))).collect()] == [3723, 45, 0, 0, 0]
    day = spark.createDataFrame([(datetime(2024, 12, 30, 1), datetime(2024, 12, 31, 0))], "a timestamp, b timestamp")
    assert day.select(X.iso_week(F.col("a")), X.whole_days(F.col("b"), F.col("a"))).first()[:] == ("2025-W01", 0)


def test_weighted_mean(spark):
    rows = spark.createDataFrame([("a", 1.0, 0), ("a", 0.0, 0), ("b", 1.0, 3), ("b", 0.0, 0), ("c", None, 5)], "g string, s double, l bigint")
    got = dict(map(tuple, rows.groupBy("g").agg(sentiment.weighted_mean(F.col("s"), F.col("l"))).collect()))
    assert got == {"a": 0.5, "b": 1.0, "c": 0.0}


def test_label_rule_and_ties(spark):
    rows = spark.createDataFrame([(0.5, 0.0, 0.5), (0.1, 0.2, 0.7), (0.6, 0.0, 0.4), (0.2, 0.6, 0.2), (0.6, 0.0, 0.6)], "n double, u double, p double")
    got = [r[0] for r in rows.select(scoring.label_of(F.col("n"), F.col("u"), F.col("p"))).collect()]
    assert got == ["Uncertain", "Positive", "Negative", "Neutral", "Positive"]


def test_corrections(spark):
    p = [0.001, 0.011, 0.02, 0.04, 0.9, None]
    rows = spark.createDataFrame([("f", str(k), x) for k, x in enumerate(p)], "family string, item string, p double")
    got = {r["item"]: r for r in stats.corrected(rows, "p", "family", "item").collect()}
    assert [k for k, r in got.items() if r["bonferroni"]] == ["0"]
    assert sorted(k for k, r in got.items() if r["bh"]) == ["0", "1", "2"]
    assert all(r["bh"] or not r["bonferroni"] for r in got.values())


@pytest.mark.parametrize("parts", [1, 5])
def test_numbered_in_several_partitions(spark, parts):
    rows = [(f"g{k % 3}", k * 37 % 101, f"i{k}") for k in range(300)] + [("g0", None, "x"), ("g0", None, "y")]
    df = spark.createDataFrame(rows, "g string, p int, i string").repartition(parts)
    order = [F.col("p").asc_nulls_last(), F.col("i").asc()]
    want = {}
    for g in ("g0", "g1", "g2", None):
        mine = sorted((r for r in rows if g is None or r[0] == g), key=lambda r: (r[1] is None, r[1] or 0, r[2]))
        want |= {(g, r[2]): k + 1 for k, r in enumerate(mine)}
    assert {(r["g"], r["i"]): r["place"] for r in stats.numbered(df, order, "place", "g").collect()} == {k: v for k, v in want.items() if k[0]}
    assert {(None, r["i"]): r["place"] for r in stats.numbered(df, order, "place").collect()} == {k: v for k, v in want.items() if not k[0]}
    assert stats.numbered(df.limit(0), order, "place", "g").count() == 0


def test_stream_forgets_and_counts_late_comments(spark, tmp_path):
    fields = "comment_id string, text string, published_at string, fetched_at timestamp"
    batches = [
        [("a", "x", "2024-01-01T00:00:00Z", datetime(2024, 1, 1)), ("b", "x", "2024-01-02T00:00:00Z", datetime(2024, 1, 2))],
        [("a", "x", "2024-01-01T00:00:00Z", datetime(2024, 1, 20)), ("old", "x", "2020-05-05T00:00:00Z", datetime(2024, 1, 21)), ("z", "x", "2024-06-01T00:00:00Z", datetime(2024, 6, 1))],
        [("late", "x", "2024-01-03T00:00:00Z", datetime(2024, 1, 3)), ("n", "x", "2024-06-02T00:00:00Z", datetime(2024, 6, 2))],
    ]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, fields).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = {r["week"]: r["comments"] for r in comments.drained(comments.weekly_counts(comments.read_comments(spark, str(tmp_path / "in"))), "complete").collect()}
    assert got["2024-01-01"] in (2, 3) and got["2020-05-04"] == 1 and sum(got.values()) in (5, 6)


def test_t_test_edges(spark):
    rows = spark.createDataFrame([(0.5, 0.0, 5, 0.5), (0.6, 0.0, 5, 0.5), (0.6, 0.1, 25, 0.55)], "m double, s double, n bigint, mu double")
    t = stats.t_statistic(F.col("m"), F.col("s"), F.col("n"), F.col("mu"))
    got = rows.withColumn("t", t).select("t", stats.t_p_value(F.col("t"), F.col("n")).alias("p")).collect()
    assert got[0]["p"] is None and got[1]["p"] == 0.0
    assert abs(got[2]["t"] - 2.5) < 1e-9 and abs(got[2]["p"] - 0.01965) < 1e-4


@pytest.mark.parametrize("n", [3, 10, 100])
def test_quotas_sum(spark, n):
    rows = spark.createDataFrame([(g, str(k)) for g, size in (("a", 50), ("b", 7), ("c", 1)) for k in range(size)], "g string, i string")
    assert evaluation.quotas(rows, "g", n).agg(F.sum("slots")).first()[0] == n


def test_metrics_by_hand(spark):
    rows = spark.createDataFrame([("Positive", "Positive"), ("Positive", "Negative"), ("Negative", "Negative")], "t string, g string")
    got = evaluation.metrics(rows, "t", "g").first()
    assert (got["accuracy"], got["macro_f1"]) == (0.6667, 0.6667)
    assert evaluation.metrics(rows, "t", "g", all_classes=True).first()["macro_f1"] == 0.4444


def test_landed_pages_and_csv(spark, tmp_path):
    page = {"id": "v1", "snippet": {"title": "T", "publishedAt": "2024-01-01T00:00:00Z"}, "statistics": {"viewCount": "7"}, "contentDetails": {"duration": "PT2M"}}
    (tmp_path / "v.json").write_text(json.dumps(page) + "\n" + json.dumps({"snippet": {}}))
    row = landed.videos(spark, str(tmp_path / "v.json")).collect()
    assert len(row) == 1 and row[0]["view_count"] == 7 and row[0]["like_count"] == 0 and row[0]["duration_secs"] == 120 and row[0]["tags"] == []
    lines = [{"id": f"c{k}", "videoId": "v1", "page_pos": k, "snippet": {"topLevelComment": {"snippet": {"textDisplay": "x"}}}} for k in range(3)]
    (tmp_path / "c.json").write_text("\n".join(map(json.dumps, lines)))
    got = landed.comments(spark, str(tmp_path / "c.json"), per_video=2).collect()
    assert [r["comment_id"] for r in got] == ["c0", "c1"] and got[0]["author"] == "Unknown"
    rows = spark.createDataFrame([("a", 'x "y", z', ["p", "q"])], "comment_id string, text string, tags array<string>")
    landed.write_csv(rows, str(tmp_path / "out"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "out")).first()[:] == ("a", 'x "y", z', "p|q")


def test_landed_lists_stop_and_keep_their_order(spark, tmp_path):
    item = lambda v: {"snippet": {"resourceId": {"videoId": v}}}
    pages = [
        {"page": 1, "nextPageToken": "p3", "items": [item("c"), item(None), item("")]}, {"page": 0, "nextPageToken": "p2", "items": [item("b"), item("a")]},
        {"page": 2, "items": [item("d")]}, {"page": 3, "items": [item("never")]},
    ]
    (tmp_path / "p.json").write_text("\n".join(map(json.dumps, pages)))
    read = lambda n: [r["video_id"] for r in landed.video_ids(spark, str(tmp_path / "p.json"), n).orderBy("video_pos").collect()]
    assert read(100) == ["b", "a", "c", "d"] and read(3) == ["b", "a", "c"]
    (tmp_path / "gap.json").write_text("\n".join(json.dumps(p) for p in pages if p["page"] != 1))
    assert landed.video_ids(spark, str(tmp_path / "gap.json")).count() == 2
    lines = [{"id": f"{v}{k}", "videoId": v, "page_pos": k, "snippet": {"topLevelComment": {"snippet": {"textDisplay": "the very same text"}}}} for v in "abz" for k in range(2)]
    (tmp_path / "c.json").write_text("\n".join(map(json.dumps, lines)))
    rows = landed.all_comments(spark, str(tmp_path / "c.json"), landed.video_ids(spark, str(tmp_path / "p.json")))
    assert [r["comment_id"] for r in rows.orderBy("ordinal").collect()] == ["b0", "b1", "a0", "a1"]
    assert [r["comment_id"] for r in clean_comments(rows).filter("NOT is_duplicate").collect()] == ["b0"]


def test_channel_by_handle_and_id(spark, tmp_path):
    (tmp_path / "ch.json").write_text("\n".join(json.dumps({"id": f"i{k}", "snippet": {"customUrl": f"@Name{k}"}}) for k in range(2)))
    path = str(tmp_path / "ch.json")
    assert [r["channel_id"] for r in landed.channel(spark, path, handle="@name1").collect()] == ["i1"]
    assert landed.channel(spark, path, channel_id="i0").count() == 1 and landed.channel(spark, path, channel_id="x").count() == 0


def test_labelling_sample_has_blank_labels(spark, tmp_path):
    rows = spark.createDataFrame([("a", "v", 1, "en", "x", "x", 9)], "comment_id string, video_id string, like_count bigint, language string, text string, cleaned_text string, more int")
    landed.write_labelling_sample(rows, str(tmp_path / "s"))
    got = landed.labelled(spark, str(tmp_path / "s")).collect()
    assert len(got) == 1 and not got[0]["human_label"] and got[0]["text"] == "x"


def unloadable():
    """A loader that fails, made inside a function so that it is sent to the tasks whole."""

    def load():
        raise OSError("no such model")

    return load


@pytest.mark.parametrize("first, other, want", [
    (routing.english_model, routing.word_list_model, ["Positive", "Neutral", "Positive", "Neutral"]),
    (routing.english_model, unloadable(), ["Positive", "Neutral", "Neutral", "Neutral"]),
    (unloadable(), unloadable(), ["Positive", "Positive", "Positive", "Neutral"]),
])
def test_routing_and_models_that_fail(spark, first, other, want):
    rows = spark.createDataFrame([("a", "great great good", "en"), ("b", "merci magnifique", None), ("c", "merci magnifique", "fr"), ("d", None, "xx")], "i string, t string, l string")
    got = routing.routed_scores(rows, "i", "t", F.col("l"), first, other, batch=1).orderBy("i").collect()
    assert [r["sentiment_label"] for r in got] == want and [r["route"] for r in got] == ["first", "first", "other", "other"]
    assert routing.routed_scores(rows.limit(0), "i", "t", F.col("l")).count() == 0


def test_segments_need_fans_and_log_the_choice(spark):
    def made(n, spread):
        return spark.range(n).select(F.col("id").cast("string").alias("author_channel_id"), F.col("id").cast("string").alias("author"), *[(F.col("id") % 2 * spread + F.col("id") % 3 * 0.01 * spread).alias(f) for f in fans.FEATURES])

    assert [x.count() for x in fans.segment(made(15, 50))] == [0, 0, 0] and fans.segment(made(15, 50), k=2)[0].count() == 0
    placed, records, log = fans.segment(made(40, 50))
    tried = log.orderBy("k").collect()
    assert placed.count() == 40 and [r["chosen"] for r in tried] == [r is max(tried, key=lambda r: r["silhouette"]) for r in tried]
    assert records.agg(F.sum("size"), F.round(F.sum("fans_pct"))).first()[:] == (40, 100.0)
    placed, _, log = fans.segment(made(40, 0))
    assert placed.count() == 40 and log.count() == 0


def test_terms_of_too_few_texts(spark):
    rows = spark.createDataFrame([("a", "telescope build telescope the")], "i string, t string")
    assert [r[:] for r in terms.trending(rows, "i", "t").collect()] == [("telescope", None, 2), ("build", None, 1)]
    assert terms.trending(rows.limit(0), "i", "t").count() == 0


def test_first_alerts_and_number_texts(spark):
    rows = spark.createDataFrame([("keyword", "k" * 60, 1234567, 0.5, True), ("velocity", "v", 3, 9.0, True), ("sentiment", "s", 30, -0.2, True), ("sentiment", "t", 30, 0.9, False), ("keyword", "x", 1, 0.1, True)], "family string, item string, n bigint, delta double, fired boolean")
    got = [r[:] for r in alerts.first_alerts(rows).collect()]
    assert got == [("sentiment", "s", "-0.200", "30"), ("velocity", "v", "+9.000", "3"), ("keyword", "k" * 55, "+0.500", "1,234,567")]


def test_topics_aggregate_where_enough_is_certain(spark):
    rows = spark.createDataFrame([("c%02d" % k, k % 2, 0, k, 1.0, "Positive" if k < 41 else "Uncertain") for k in range(50)], "comment_id string, topic int, like_count bigint, ordinal bigint, sentiment_score double, sentiment_label string")
    got = {r["topic"]: r for r in sentiment.per_topic(rows, "topic", least=21).collect()}
    assert (got[0]["has_sentiment"], got[1]["has_sentiment"], got[1]["weighted_sentiment"]) == (True, False, None)
    assert got[0]["examples"] == "c00,c02,c04" and got[0]["weighted_sentiment"] == 1.0


def test_keyword_patterns(spark):
    rows = spark.createDataFrame([("the drone  shot here",), ("drone shot",), ("drones hot",), (None,)], "text string")
    loose, strict = (T.matches(F.col("text"), T.keyword_pattern("drone shot", x)) for x in (True, False))
    assert [tuple(r) for r in rows.select(loose, strict).collect()] == [(True, False), (True, True), (False, False), (False, False)]


def other_comments(spark, folder):
    """Comments about a subject that no fixed list names; one term only in sad ones."""
    names = "video_id string, author string, author_channel_id string, text string, cleaned_text string, like_count bigint, reply_count bigint, published_at string, comment_id string, ordinal bigint"
    texts = [f"wonderful great telescope build number {w} love" if k % 2 else f"terrible awful eyepiece wobble number {w} hate" for k, w in enumerate(f"{a}{b}x" for a in "abcdefgh" for b in "mnopqrst")]
    rows = [(f"v{k % 3}", "a", "c", t, t, 1, 0, "2024-01-01T00:00:00Z", f"c{k}", k) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, names).write.parquet(f"{folder}/comments.parquet")
    spark.read.parquet("/root/testdata/sf0.001/videos.parquet").limit(5).write.parquet(f"{folder}/videos.parquet")
    return str(folder)


def test_keywords_come_from_the_comments(spark, small, tmp_path):
    sf, found = other_comments(spark, tmp_path), registry.queries()
    alerts = [r for r in found["stat9_alerts"](spark, sf).collect() if r["family"] == "keyword"]
    assert {"telescope", "eyepiece"} <= {r["item"] for r in alerts} and {r["m"] for r in alerts} == {len(alerts)}
    assert {r["item"]: r["fired"] for r in alerts}["eyepiece"]
    assert {r["family"]: r["m"] for r in found["agg17_alert_summary"](spark, sf).collect()}["keyword"] == len(alerts)
    assert {r["item"] for r in found["stat8_trending_shifts"](spark, sf).collect()} == {r["item"] for r in alerts}
    assert "keyword" in {r["what"] for r in found["dq3_trending_insights"](spark, sf).collect()}
    assert sentiment.keyword_hits(spark.read.parquet(f"{sf}/comments.parquet"), "text", {}).count() == 0


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
