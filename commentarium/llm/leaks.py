"""Problem 9: evaluation passages inside a corpus, by a distributed positional inverted index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from commentarium.session import written
from commentarium.tables import load

#: Consecutive words of a passage that make a leak.
PHRASE_WORDS = 12
#: Words by which parts of a passage may be shifted against each other and still count as one place.
SLOP = 6
#: A proximity match has this share of a passage's words in one place.
NEAR_SHARE = 0.6
#: Test terms up to this number are sent to every task; beyond it the index is joined by shuffle.
BROADCAST_TERMS = 200_000


def positions(df: DataFrame, ident: str, text: str) -> DataFrame:
    """``id``, ``pos`` and ``term``: runs of letters and numbers, lower-cased, in their order."""
    words = F.expr(rf"regexp_extract_all(lower(`{text}`), '[\\p{{L}}\\p{{N}}]+', 0)")
    return df.select(F.col(ident).alias("id"), F.posexplode(words).alias("pos", "term"))


def anchors(tests: DataFrame, frequency: DataFrame, phrase: int) -> DataFrame:
    """For every window of ``phrase`` words of a test passage, its word that is rarest in the corpus: ``item``, ``ipos``, ``term``.

    Words that the corpus doesn't have are passed over: such a window can't occur whole, but parts of it may.
    """
    known = tests.join(frequency, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = Window.partitionBy("item").orderBy("ipos").rowsBetween(0, phrase - 1)
    best = F.min(F.when(F.col("n") > 0, F.struct("n", "ipos", "term"))).over(w)
    windows = known.select("item", F.count("*").over(w).alias("words"), best.alias("best"))
    return windows.filter((F.col("words") == phrase) & F.col("best").isNotNull()).select("item", "best.ipos", "best.term").distinct()


def phrase_matches(corpus: DataFrame, tests: DataFrame, ident: str, text: str, item: str, passage: str, phrase: int = PHRASE_WORDS, near_share: float = NEAR_SHARE) -> DataFrame:
    """``ident``, ``item``, ``longest_run`` and ``covered_share`` of every corpus text with a passage or a good part of it.

    That is, ``phrase`` consecutive words of the passage (exact phrase) or ``near_share`` of its words within a few
    words of their places (proximity).

    Postings (term, text, position) are stored for all terms that the tests use. Every window of a passage is looked
    up by its rarest term; each posting found gives an offset between text and passage, and the other terms'
    postings are intersected at their offset-adjusted positions. Runs of consecutive hits give the exact phrase;
    ``covered_share`` is the largest part of the passage's words that is hit at offsets less than ``SLOP`` apart.

    Case, punctuation, markup, blanks and line breaks between words don't matter. Null, empty and blank texts,
    passages of fewer than ``phrase`` words and null ids have no matches; repeated ids count as one text only if
    their rows are alike. An empty table gives no rows; other columns are ignored, whatever their names.
    """
    items = positions(tests.filter(F.col(item).isNotNull()), item, passage).toDF("item", "ipos", "term")
    vocabulary = items.select("term").distinct()
    few = items.count() <= BROADCAST_TERMS  # of which terms and anchors are parts
    if few:
        vocabulary = F.broadcast(vocabulary)
    words = positions(corpus.filter(F.col(ident).isNotNull()), ident, text)
    postings = written(words.join(vocabulary, "term", "left_semi").select("term", "id", "pos"), "postings")
    frequency = postings.groupBy("term").agg(F.count("*").alias("n"))
    starts = anchors(items, frequency, phrase)
    # never the postings are sent to all, whatever their compressed size
    sought = postings.join(F.broadcast(starts), "term") if few else postings.join(starts.hint("merge"), "term")
    found = sought.select("id", "item", (F.col("pos") - F.col("ipos")).alias("shift")).distinct()
    wanted = found.join(items, "item").select("id", "item", "shift", "ipos", "term", (F.col("shift") + F.col("ipos")).alias("pos"))
    hits = wanted.join(postings.hint("merge"), ["id", "pos", "term"], "left_semi").select("id", "item", "shift", "ipos")
    w = Window.partitionBy("id", "item", "shift").orderBy("ipos")
    runs = hits.distinct().withColumn("run", F.col("ipos") - F.row_number().over(w))
    lengths = runs.groupBy("id", "item", "shift", "run").agg(F.count("*").alias("length"), F.collect_set("ipos").alias("at"))
    size = items.groupBy("item").agg(F.count("*").alias("words"))
    place = Window.partitionBy("id", "item").orderBy("shift").rangeBetween(0, SLOP - 1)
    near = lengths.withColumn("covered", F.size(F.array_distinct(F.flatten(F.collect_list("at").over(place)))))
    best = near.groupBy("id", "item").agg(F.max("length").alias("longest_run"), F.max("covered").alias("covered"))
    out = best.join(size, "item").filter((F.col("longest_run") >= phrase) | (F.col("covered") >= near_share * F.col("words")))
    return out.select(F.col("id").alias(ident), F.col("item").alias(item), "longest_run", F.round(F.col("covered") / F.col("words"), 4).alias("covered_share"))


def p9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with a passage or a good part of it: the longest run of words and the share of the passage in one place."""
    return phrase_matches(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_items"), "doc_id", "text", "item_id", "passage")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_passages(spark, sf_dir).filter(F.col("longest_run") >= PHRASE_WORDS).select("doc_id", "item_id")


QUERIES = {"p9_found": p9_found, "p9_passages": p9_passages}

SQL = {
    "p9_found": """
        WITH dw AS (
            SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE doc_id IS NOT NULL),
        d AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 11], ' ') AS gram
              FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM dw WHERE len(w) >= 12)),
        iw AS (SELECT item_id, regexp_extract_all(lower(passage), '[\\p{L}\\p{N}]+') AS w FROM eval_items),
        t AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 11], ' ') AS gram
              FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM iw WHERE len(w) >= 12))
        SELECT DISTINCT doc_id, item_id FROM d JOIN t USING (gram)
    """,
}
