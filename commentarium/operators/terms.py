"""Terms that stand out, by TF-IDF over one- and two-word terms; all of it relational."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commentarium.session import written

# Words that never count as terms.
STOPWORDS = (
    "the a an and or but in on at to for of with as is was are were be been being have has had do does did will would could should may "
    "might shall can i me my we our you your he she his her it its they their this that these those what which who how when where why all "
    "just so if up out not no like get go got going know think see let much more very really also about from into than then there too "
    "some any one two new s t re ve ll d m im u ur r lol dont cant wont hes shes thats yeah yep yes nah oh hey hi bro man guy"
).split()
MAX_TERMS, MIN_DF = 500, 2
KEYWORDS = 20


def single_words(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?<![\p{L}\p{N}_])[a-z]{3,}(?![\p{L}\p{N}_])"), 0), lambda t: ~t.isin(STOPWORDS))


def term_scores(df: DataFrame, ident: str, text: str, max_terms: int = MAX_TERMS, min_df: int = MIN_DF) -> DataFrame:
    """``word, score, count``: sum over texts of the L2-normalised (1 + ln tf)(ln((1+N)/(1+df)) + 1); count is the number of texts.

    Terms are runs of three and more ASCII letters that are no stop words, and pairs of neighbours among them; kept
    are those in ``min_df`` texts, of these the ``max_terms`` with most occurrences. Only this bounded list is sent to
    every task. ``ident`` is unique.
    """
    w = single_words(F.col(text))
    pairs = F.when(F.size("w") > 1, F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.element_at("w", i), F.element_at("w", i + 1)))).otherwise(F.array().cast("array<string>"))
    texts = written(df.select(F.col(ident).alias("id"), w.alias("w")).select("id", F.concat("w", pairs).alias("t")), "words")  # read three times below
    once = F.transform(F.array_distinct("t"), lambda x: F.struct(x.alias("word"), F.lit(1).alias("df"), F.lit(0).alias("cf")))
    each = F.transform("t", lambda x: F.struct(x.alias("word"), F.lit(0).alias("df"), F.lit(1).alias("cf")))
    # counted in the tasks first, so that words are shuffled and not occurrences
    vocabulary = texts.select(F.inline(F.concat(once, each))).groupBy("word").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).filter(F.col("df") >= min_df)
    kept = vocabulary.orderBy(F.desc("cf"), "word").limit(max_terms)
    n = texts.agg(F.count("*").alias("n_docs"))
    idf = kept.join(F.broadcast(n)).select("word", (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf"))
    tf = texts.select("id", F.explode("t").alias("word")).join(F.broadcast(idf), "word").groupBy("id", "word").agg(F.count("*").alias("tf"), F.max("idf").alias("idf"))
    weights = tf.withColumn("x", (1 + F.log("tf")) * F.col("idf"))
    norms = weights.groupBy("id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return weights.join(norms, "id").groupBy("word").agg(F.sum(F.col("x") / F.col("norm")).alias("score"), F.count("*").alias("count"))


def trending(df: DataFrame, ident: str, text: str, top: int = 30) -> DataFrame:
    """The ``top`` terms with the highest scores; where no term is in enough texts, the most frequent single words, without score."""
    ranked = term_scores(df, ident, text).withColumn("score", F.round(F.col("score") + 1e-9, 4))
    ranked = written(ranked.orderBy(F.desc("score"), "word").limit(top), "terms")
    if not ranked.isEmpty():
        return ranked.orderBy(F.desc("score"), "word")
    words = df.select(F.explode(single_words(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("count"))
    return words.select("word", F.lit(None).cast("double").alias("score"), "count").orderBy(F.desc("count"), "word").limit(top)


def keywords(df: DataFrame, ident: str, text: str, top: int = KEYWORDS) -> list[str]:
    """The ``top`` terms that stand out, best first; a bounded list, as each becomes a pattern of its own."""
    return [r["word"] for r in trending(df, ident, text, top).collect()]
