"""Sentiment and emotion of comments: a pluggable scorer and the rules that turn its numbers into labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commentarium.functions import text as T

UNCERTAIN_BELOW = 0.55
# Words of praise, of blame and of denial in the languages of the comments.
POSITIVE = (
    "amazing beautiful brilliant charming clever crisp flawless gorgeous good great heartwarming helpful hilarious inspiring love "
    "relaxing thank thanks underrated best awesome excellent favourite genial increíble excelente fenomenal gracias mejor hermoso "
    "bueno maravilloso obrigado ótimo incrível melhor lindo inesquecível merci magnifique superbe génial agréable meilleur sublime "
    "danke schön großartig wunderschön ausgezeichnet beeindruckend grazie bello brillante meraviglioso splendido спасибо лучшее супер красиво шедевр"
).split()
NEGATIVE = (
    "annoying awful bad boring confusing disappointing dull lazy messy overrated painful rushed sloppy terrible unwatchable hate worst "
    "unsubscribed ugly stupid pathetic worthless terrible decepcionante aburrido horrible fatal interminable malo peor insoportable "
    "pouco ruim chato péssimo horrível ridicule mauvais ennuyeux décevant nul pénible médiocre insupportable langweilig schlecht "
    "schrecklich enttäuschend furchtbar nervig unerträglich lieblos pessimo noioso brutto deludente orribile mediocre ужас скука слабо позор провал"
).split()
DENIAL = "not no never nothing no nunca não nunca pas jamais nicht nie keine non mai не никогда".split()
EMOTIONS = {
    "anger": "hate angry furious idiot stupid worthless disgusting shut rage odio colère wut",
    "disgust": "disgusting gross filthy ugly nasty ridicule asqueroso dégueulasse eklig schifoso",
    "fear": "afraid scared scary terrifying worried nightmare miedo peur angst paura страшно",
    "joy": "amazing love beautiful hilarious happy goosebumps brilliant gorgeous excelente magnifique wunderschön bello супер",
    "neutral": "",
    "sadness": "sad miss cry disappointing disappointed sorry triste désolé traurig peccato жаль",
    "surprise": "wow expected unbelievable suddenly surprised incredible sorprende incroyable unglaublich incredibile невероятно",
}


def label_of(neg: Column, neu: Column, pos: Column, threshold: float | Column = UNCERTAIN_BELOW) -> Column:
    """The likeliest class, ties to Positive, then Negative; Uncertain below the threshold."""
    top = F.greatest(neg, neu, pos)
    return F.when(top < threshold, "Uncertain").when(pos == top, "Positive").when(neg == top, "Negative").otherwise("Neutral")


def label_of_compound(score: Column, cut: float = 0.05) -> Column:
    return F.when(score >= cut, "Positive").when(score <= -cut, "Negative").otherwise("Neutral")


def label_by_cuts(score: Column, positive: Column | float, negative: Column | float) -> Column:
    return F.when(score > positive, "Positive").when(score < negative, "Negative").otherwise("Neutral")


def lexicon_scores(df: DataFrame, text: str = "cleaned_text") -> DataFrame:
    """Adds neg_prob, neu_prob, pos_prob, sentiment_score, sentiment_label and emotion, from word lists.

    A word of praise after a denial counts as blame and the other way round. Any scorer that adds the same columns
    may take its place.
    """
    out = df.withColumn("w", T.words(F.col(text)))
    before = lambda i: F.coalesce(F.get("w", i - 1), F.lit("")).isin(DENIAL)
    praise = F.size(F.filter("w", lambda t, i: (t.isin(POSITIVE) & ~before(i)) | (t.isin(NEGATIVE) & before(i))))
    blame = F.size(F.filter("w", lambda t, i: (t.isin(NEGATIVE) & ~before(i)) | (t.isin(POSITIVE) & before(i))))
    out = out.withColumn("n_pos", praise).withColumn("n_neg", blame)
    rest = F.when(F.col("n_pos") + F.col("n_neg") == 0, 1.0).otherwise(0.3)
    total = F.col("n_pos") + F.col("n_neg") + 0.2 + rest
    out = out.withColumn("neg_prob", F.round((F.col("n_neg") + 0.1) / total + 1e-9, 4)).withColumn("pos_prob", F.round((F.col("n_pos") + 0.1) / total + 1e-9, 4))
    out = out.withColumn("neu_prob", F.round(rest / total + 1e-9, 4))
    out = out.withColumn("sentiment_score", F.round(F.col("pos_prob") - F.col("neg_prob"), 4))
    out = out.withColumn("sentiment_label", label_of(F.col("neg_prob"), F.col("neu_prob"), F.col("pos_prob")))
    counts = [T.count_of(F.col("w"), s.split()).alias(e) for e, s in EMOTIONS.items()]
    out = out.withColumn("e", F.struct(*counts))
    best = F.array_max(F.array(*[F.struct(F.col(f"e.{e}").alias("n"), F.lit(-k).alias("k"), F.lit(e).alias("name")) for k, e in enumerate(EMOTIONS)]))
    out = out.withColumn("emotion", F.when(best["n"] > 0, best["name"]).otherwise("neutral"))
    return out.drop("w", "e")


def emotion_shares(df: DataFrame, text: str = "cleaned_text") -> DataFrame:
    """Adds emotion_<name> for each emotion: its part of the emotional words; all to neutral where there are none."""
    out = df.withColumn("w", T.words(F.col(text)))
    out = out.withColumn("e", F.struct(*[T.count_of(F.col("w"), s.split()).alias(e) for e, s in EMOTIONS.items()]))
    total = sum((F.col(f"e.{e}") for e in EMOTIONS), F.lit(0))
    part = lambda e: F.when(total == 0, F.lit(1.0 if e == "neutral" else 0.0)).otherwise(F.round(F.col(f"e.{e}") / total + 1e-9, 4))
    return out.withColumns({f"emotion_{e}": part(e) for e in EMOTIONS}).drop("w", "e")


def scores_where(df: DataFrame, wanted: Column, text: str = "cleaned_text") -> DataFrame:
    """All rows of ``df``, with scores only where ``wanted`` holds; by condition, so that nothing is joined back."""
    names = ("neg_prob", "neu_prob", "pos_prob", "sentiment_score", "sentiment_label", "emotion")
    return lexicon_scores(df, text).withColumns({c: F.when(wanted, F.col(c)) for c in names}).drop("n_pos", "n_neg")
