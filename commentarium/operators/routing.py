"""Scoring by models in Python: comments are routed to a model by their language and scored in batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commentarium.operators import scoring

#: A model takes texts and gives a row of three probabilities (negative, neutral, positive) for each.
Model = Callable[[list[str]], np.ndarray]
BATCH = 32
FIRST_LANGUAGES = ("en", "und")
WORD = regex.compile(r"[\p{L}\p{N}]+")
ENGLISH = (
    frozenset(scoring.POSITIVE[: scoring.POSITIVE.index("favourite") + 1]),
    frozenset(scoring.NEGATIVE[: scoring.NEGATIVE.index("worthless") + 1]),
)


def word_list_model(positive: frozenset[str] = frozenset(scoring.POSITIVE), negative: frozenset[str] = frozenset(scoring.NEGATIVE)) -> Model:
    """Counts words of praise and of blame; stands where trained models may be given."""

    def score(texts: list[str]) -> np.ndarray:
        words = [WORD.findall(t.lower()) for t in texts]
        pos = np.array([sum(w in positive for w in ws) for ws in words], dtype=float)
        neg = np.array([sum(w in negative for w in ws) for ws in words], dtype=float)
        rest = np.where(pos + neg == 0, 1.0, 0.3)
        total = pos + neg + 0.2 + rest
        return np.stack([(neg + 0.1) / total, rest / total, (pos + 0.1) / total], axis=1).reshape(-1, 3)

    return score


def english_model() -> Model:
    return word_list_model(*ENGLISH)


def _rounded(x: np.ndarray) -> np.ndarray:
    return np.floor((x + 1e-9) * 1e4 + 0.5) / 1e4


def _scoring(first: Callable[[], Model], other: Callable[[], Model], batch: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models: dict[str, Model] = {}

        def model(route: str) -> Model:
            if route not in models:
                try:
                    models[route] = first() if route == "first" else other()
                except Exception:
                    models[route] = word_list_model() if route == "first" else model("first")
            return models[route]

        for frame in frames:
            frame = frame.reset_index(drop=True)
            probabilities = np.zeros((len(frame), 3))
            for route, places in frame.groupby("route").indices.items():
                texts = frame["text"].iloc[places].tolist()
                for k in range(0, len(texts), batch):
                    probabilities[places[k : k + batch]] = model(route)(texts[k : k + batch])
            p = _rounded(probabilities)
            yield pd.DataFrame({"id": frame["id"], "route": frame["route"], "neg_prob": p[:, 0], "neu_prob": p[:, 1], "pos_prob": p[:, 2]})

    return run


def routed_scores(
    df: DataFrame, ident: str, text: str, language: Column, first: Callable[[], Model] = english_model, other: Callable[[], Model] = word_list_model, batch: int = BATCH
) -> DataFrame:
    """``ident, route, neg_prob, neu_prob, pos_prob, sentiment_score, sentiment_label`` of every row.

    Rows in English or no known language go to the model that ``first`` loads, the rest to that of ``other``. A task
    loads a model when its first row needs it; one that cannot be loaded is replaced by the first, and that by the word
    lists. Inside a task rows lie by route and length, so that a batch holds texts of like length. Null texts count as
    empty, a null language as unknown, repeated rows are scored each.
    """
    route = F.when(F.coalesce(language, F.lit("und")).isin(*FIRST_LANGUAGES), "first").otherwise("other")
    rows = df.select(F.col(ident).alias("id"), route.alias("route"), F.coalesce(F.col(text), F.lit("")).alias("text")).sortWithinPartitions("route", F.length("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInPandas(_scoring(first, other, batch), f"id {kind}, route string, neg_prob double, neu_prob double, pos_prob double")
    out = out.withColumn("sentiment_score", F.round(F.col("pos_prob") - F.col("neg_prob"), 4))
    return out.withColumn("sentiment_label", scoring.label_of(F.col("neg_prob"), F.col("neu_prob"), F.col("pos_prob"))).withColumnRenamed("id", ident)
