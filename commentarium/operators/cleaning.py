"""Comment cleaning: composed text, spam rules, language, repeats."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commentarium.functions import text as T
from commentarium.session import written

# Frequent small words of each language, enough to tell sentences apart.
STOPWORDS = {
    "de": "der die das und ist nicht ich du wir ihr mit für auf dem den ein eine war hat von wird bei dass",
    "en": "the and is was with this that you for are have has it of to in on at not my we they from what",
    "es": "el la los las y es que de con para una por no muy lo se del al mi esta pero como más",
    "fr": "le la les et est que de des pour une pas je tu nous vous du au avec dans ce qui sur mais",
    "it": "il lo la gli e è che di per una non mi con del della ho ha sono alla questo ma come più",
    "pt": "o a os as e é que de com para uma não do da em no na eu você mas como mais muito",
}


def language_by_stopwords(clean: Column) -> Column:
    """Two-letter code of the language with most small words, ties to the first code; 'ru' for mostly Cyrillic; else 'und'."""
    def judged(w: Column) -> Column:
        counts = [F.struct(T.count_of(w, s.split()).alias("n"), F.lit(-k).alias("k"), F.lit(code).alias("code")) for k, (code, s) in enumerate(STOPWORDS.items())]
        cyrillic = F.size(F.filter(w, lambda t: t.rlike(r"^\p{IsCyrillic}+$")))
        return F.struct(F.array_max(F.array(*counts)).alias("best"), (cyrillic * 2 > F.size(w)).alias("cyrillic"))

    # the words are made once and bound by the outer transform
    seen = F.transform(F.array(T.words(clean)), judged)[0]
    guess = F.when(seen["cyrillic"], "ru").otherwise(F.when(seen["best"]["n"] > 0, seen["best"]["code"]).otherwise("und"))
    return F.when(F.length(clean) < T.MIN_LANGUAGE_LENGTH, "und").otherwise(guess)


def clean_comments(df: DataFrame, order: str = "ordinal", detector: Callable[[Column], Column] | None = language_by_stopwords) -> DataFrame:
    """Adds cleaned_text, is_spam, spam_reason, language and is_duplicate.

    A comment is a duplicate if an earlier one in ``order`` (unique) has the same text up to case, symbols and
    punctuation, spam included. The first of each text is found by a combined minimum and joined on ``order``, so the
    many comments of one text (or of none) never meet in one task. ``detector`` may be any expression of the cleaned text.
    """
    out = df.withColumn("cleaned_text", T.cleaned(F.col("text")))
    out = out.withColumn("__low", F.lower(F.coalesce("text", F.lit(""))))
    out = out.withColumn("spam_reason", T.spam_reason(F.coalesce("text", F.lit("")), F.col("__low"), F.col("cleaned_text"))).drop("__low")
    out = out.withColumn("is_spam", F.col("spam_reason").isNotNull()).withColumn("repeat_key", T.repeat_key(F.col("cleaned_text")))
    if detector is not None:
        out = out.withColumn("language", detector(F.col("cleaned_text")))
    out = written(out, "cleaned")  # texts are cleaned once, though two branches read them
    firsts = out.groupBy("repeat_key").agg(F.min(order).alias(order)).select(order, F.lit(False).alias("later"))
    return out.join(firsts, order, "left").withColumn("is_duplicate", F.coalesce("later", F.lit(True))).drop("later")


def clean_mask() -> Column:
    return ~F.col("is_spam") & ~F.col("is_duplicate")


def delta(df: DataFrame, done: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows still to be scored, rows already done): those with a non-empty key in ``done`` pass through."""
    ids = done.select(key).filter(F.col(key).isNotNull() & (F.col(key) != "")).distinct()
    return df.join(ids, key, "left_anti"), df.join(ids, key, "left_semi")
