"""Problem 7: language of each text and of each part in another language, by segmentation-marginalised unigrams."""

from __future__ import annotations

import os
import pickle
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commentarium.llm.lookalikes import Rewriter
from commentarium.session import ship_bytes
from commentarium.tables import hashed_sample, load

TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
PIECE_FILE = "piece_bpe_32k.model"
#: Most labelled rows the model is fitted on: clean samples, and comments whose label it then agrees with.
TRAIN_ROWS, MORE_ROWS = 20_000, 12_000
#: Longest stretch of a word that is learned or scored at once; longer words are taken in stretches.
STRETCH = 40
ROUNDS = 4
#: Taken off each expected count, so that what one word alone shows weighs less; probability of a character no piece covers.
DISCOUNT, UNKNOWN = 0.3, 1e-7
#: Share of the background in every language's pieces; share of the uniform in the background.
BACKGROUND, UNIFORM = 0.08, 0.02
#: Evidence of a word is cut off here, so that no single word decides; cost of changing the language between words.
WORD_LIMIT, CHANGE = 5.0, 9.0
#: A word belongs to a language if it fits that much better than on average; a part in another language has so many of them.
LEXICAL, SENTENCE_WORDS = 1.2, 5
MIN_CHARS, MIN_WORDS = 20, 6
# Names and three-letter codes of the languages as labels spell them.
LABELS = {
    "en": "en eng english", "es": "es spa spanish español castellano", "pt": "pt por portuguese português",
    "fr": "fr fra fre french français", "de": "de deu ger german deutsch", "it": "it ita italian italiano",
    "ru": "ru rus russian русский",
}
EDGE = regex.compile(r"^[^\p{L}]+|[^\p{L}]+$")
#: Characters that only look like those of a word; runs of single letters.
DISGUISED = re.compile("[̀-ͯ​-‏­⁠﻿＀-￯ﬀ-ﬆ\U0001d400-\U0001d7ff]|[a-zA-Z]\\w*[Ͱ-ӿ]|[Ͱ-ӿ]\\w*[a-zA-Z]")
SPELLED = re.compile(r"(?:(?<=\s)|^)(?:[^\W\d_]\s){3,}[^\W\d_](?=\s|$)")
SKIPPED = regex.compile(r"^[#@]|://|^www\.|^[^\p{L}]*$")
PRIME = np.uint64(1099511628211)


@lru_cache(maxsize=1)
def _rewriter() -> Rewriter:
    return Rewriter({})


def normal_word(token: str) -> str:
    """A token as it is scored: lower-cased, without look-alike characters and what surrounds its letters; empty for tags, handles, links and numbers."""
    if DISGUISED.search(token):
        token = _rewriter().rewrite(token)[0]
    return "" if SKIPPED.search(token) else EDGE.sub("", token.lower())


def split_words(text: str) -> list[str]:
    """A text's words at white space; letters of words that are spelled out one by one are marked as numbers are."""
    if SPELLED.search(text):
        text = SPELLED.sub(lambda m: regex.sub(r"\S", "0", m.group()), text)
    return text.split()


def read_pieces(path: str) -> list[str]:
    """Pieces of the public vocabulary that a lower-cased word can hold."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i)))
    return sorted({p for p in found if p == p.lower() and "▁" not in p[1:]})


def _codes(words: list[str]) -> np.ndarray:
    """Code points of the words with a word start before each, padded with zeros."""
    width = max(map(len, words)) + 1
    out = np.zeros((len(words), width), dtype=np.uint32)
    out[:, 0] = 0x2581
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    out[:, 1:][np.arange(width - 1) < lengths[:, None]] = flat
    return out


class Pieces:
    """Finds which stretches of words are pieces, for many words at once."""

    def __init__(self, pieces: list[str]):
        self.size, self.longest = len(pieces), max(map(len, pieces), default=0)
        hashed = np.array([self._hash(p) for p in pieces], dtype=np.uint64)
        order = np.argsort(hashed)
        self.sorted, self.index = hashed[order], order

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(PRIME) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def spans(self, codes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For each begin and length, the words that have a piece there and which: (begin, length, words, pieces)."""
        rows, width = codes.shape
        for begin in range(width):
            h = np.zeros(rows, dtype=np.uint64)
            live = codes[:, begin] > 0
            for length in range(1, min(self.longest, width - begin) + 1):
                live = live & (codes[:, begin + length - 1] > 0)
                if not live.any():
                    break
                h = h * PRIME + codes[:, begin + length - 1].astype(np.uint64) + np.uint64(1)
                at = np.minimum(np.searchsorted(self.sorted, h), self.size - 1)
                hit = np.flatnonzero(live & (self.sorted[at] == h))
                if len(hit):
                    yield begin, length, hit, self.index[at[hit]]


def forward(codes: np.ndarray, pieces: Pieces, prob: np.ndarray, unknown: float) -> np.ndarray:
    """alpha[word, position, language]: probability of the word up to the position, summed over all segmentations."""
    rows, width = codes.shape
    alpha = np.zeros((rows, width + 1, prob.shape[1]))
    alpha[:, 0] = 1
    done = 0
    for begin, length, hit, piece in pieces.spans(codes):
        while done < begin:  # a character that no piece covers costs the same in every language
            done += 1
            alpha[:, done] += alpha[:, done - 1] * unknown
        alpha[hit, begin + length] += alpha[hit, begin] * prob[piece]
    while done < width:
        done += 1
        alpha[:, done] += alpha[:, done - 1] * unknown
    return alpha


class Model:
    """Piece probabilities of each language, and of names in the last column."""

    def __init__(self, languages: list[str], pieces: list[str], prob: np.ndarray):
        self.languages, self.names, self.prob = languages, pieces, prob
        self.pieces = Pieces(pieces)

    def log_probs(self, words: list[str]) -> np.ndarray:
        """Log probability of each word in each language and as a name."""
        out = np.zeros((len(words), self.prob.shape[1]))
        parts = [(i, w[k : k + STRETCH]) for i, w in enumerate(words) for k in range(0, len(w), STRETCH)]
        parts.sort(key=lambda x: len(x[1]))
        for at in range(0, len(parts), 4096):
            block = parts[at : at + 4096]
            codes = _codes([w for _, w in block])
            lengths = (codes > 0).sum(axis=1)
            alpha = forward(codes, self.pieces, self.prob, UNKNOWN)
            np.add.at(out, [i for i, _ in block], np.log(alpha[np.arange(len(block)), lengths] + 1e-300))
        return out

    def evidence(self, words: list[str]) -> np.ndarray:
        """Log probability of each word in each language, less the mean over languages.

        A word that is likelier a name is worth the same in all languages. Nothing lies more than ``WORD_LIMIT``
        below the best.
        """
        if not words:
            return np.zeros((0, len(self.languages)))
        logs = self.log_probs(words)
        out = np.maximum(logs[:, :-1], logs[:, -1:])
        out = np.maximum(out, out.max(axis=1, keepdims=True) - WORD_LIMIT)
        return out - out.mean(axis=1, keepdims=True)


def _expectation(weights: dict[tuple[str, int], float], classes: int, pieces: list[str]) -> np.ndarray:
    """Piece probabilities of each class from weighted words, by expected counts over all segmentations."""
    words = sorted({w for w, _ in weights})
    place = {w: i for i, w in enumerate(words)}
    weight = np.zeros((len(words), classes))
    for (word, k), n in weights.items():
        weight[place[word], k] += n
    table = Pieces(pieces)
    codes = _codes(words)
    lengths = (codes > 0).sum(axis=1)
    spans = list(table.spans(codes))
    prob = np.full((len(pieces), classes), 1 / len(pieces))
    for _ in range(ROUNDS):
        alpha = forward(codes, table, prob, 1e-12)
        beta = np.zeros_like(alpha)
        beta[np.arange(len(words)), lengths] = 1
        done = codes.shape[1]
        for begin, length, hit, piece in reversed(spans):
            while done > begin:
                done -= 1
                beta[:, done] += beta[:, done + 1] * 1e-12
            beta[hit, begin] += prob[piece] * beta[hit, begin + length]
        whole = alpha[np.arange(len(words)), lengths] + 1e-300
        expected = np.zeros_like(prob)
        for begin, length, hit, piece in spans:
            np.add.at(expected, piece, alpha[hit, begin] * prob[piece] * beta[hit, begin + length] / whole[hit] * weight[hit])
        own = np.maximum(expected - DISCOUNT, 0)
        own /= np.maximum(own.sum(axis=0, keepdims=True), 1e-12)
        ground = (1 - UNIFORM) * own.mean(axis=1, keepdims=True) + UNIFORM / len(pieces)
        prob = (1 - BACKGROUND) * own + BACKGROUND * ground
    return prob


def train(samples: list[tuple[str, str]], pieces: list[str]) -> Model:
    """Fit by expectation maximisation on texts with their languages.

    Words that stand with a capital inside sentences most of the time train a model of names instead, which takes
    part as a class of its own. German writes all nouns so; there a word is a name if it is one in another language,
    or if a first model without these words finds it likelier a name than German.
    """
    languages = sorted({lang for lang, _ in samples})
    counts: dict[tuple[str, str], int] = {}
    capital: dict[tuple[str, str], int] = {}
    for lang, text in samples:
        if text.isupper():
            continue
        fresh = True
        for token in text.split():
            whole = normal_word(token)
            for word in (whole[k : k + STRETCH] for k in range(0, len(whole), STRETCH)):
                counts[word, lang] = counts.get((word, lang), 0) + 1
                if not fresh and len(word) > 2 and "'" not in word and EDGE.sub("", token)[:1].isupper():
                    capital[word, lang] = capital.get((word, lang), 0) + 1
            fresh = token[-1] in ".!?…" or token[0] in "-—"
    totals: dict[str, list[int]] = {}
    for (word, lang), n in counts.items():
        if lang != "de":
            held = totals.setdefault(word, [0, 0])
            held[0] += capital.get((word, lang), 0)
            held[1] += n
    names = {w for w, (c, n) in totals.items() if 2 * c > n}
    last = len(languages)
    weights: dict[tuple[str, int], float] = {}
    unsure: dict[str, int] = {}
    for (word, lang), n in counts.items():
        if word in names:
            weights[word, last] = weights.get((word, last), 0) + n
        elif lang == "de" and 2 * capital.get((word, lang), 0) > n:
            unsure[word] = n
        else:
            weights[word, languages.index(lang)] = n
    model = Model(languages, pieces, _expectation(weights, last + 1, pieces))
    if unsure:
        german = languages.index("de")
        words = list(unsure)
        logs = model.log_probs(words)
        for word, log in zip(words, logs):
            weights[word, german if log[german] >= log[last] else last] = unsure[word]
        model = Model(languages, pieces, _expectation(weights, last + 1, pieces))
    return model


def decode(scores: np.ndarray, lengths: np.ndarray, change: float = CHANGE) -> np.ndarray:
    """Best language of every word, for padded texts (text, word, language), where each change of language costs."""
    n, width, langs = scores.shape
    back = np.zeros((n, width, langs), dtype=np.int8)
    best = scores[:, 0].copy()
    finals = best.copy()
    for t in range(1, width):
        top = best.argmax(axis=1)
        moved = best[np.arange(n), top] - change
        stay = best >= moved[:, None]
        back[:, t] = np.where(stay, np.arange(langs), top[:, None])
        best = np.where(stay, best, moved[:, None]) + scores[:, t]
        ended = lengths == t + 1
        finals[ended] = best[ended]
    path = np.zeros((n, width), dtype=np.int8)
    state = finals.argmax(axis=1)
    for t in range(width - 1, -1, -1):
        inside = t < lengths
        path[inside, t] = state[inside]
        state = np.where(inside, back[np.arange(n), t, state], state) if t else state
    return path


@lru_cache(maxsize=2)
def _model(name: str) -> Model:
    with open(SparkFiles.get(name), "rb") as f:
        return Model(*pickle.load(f))


def _segments(texts: list[list[int]], evidence: np.ndarray) -> Iterator[tuple[int, int, int, int, int, float, bool]]:
    """(text, language, first word, last word, words of the language, confidence, whether the text's main one)."""
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    order = np.argsort(lengths, kind="stable")
    order = order[lengths[order] > 0]
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * lengths[order[end]] <= 400_000:
            end += 1
        rows = order[at:end]
        width = int(lengths[rows].max())
        index = np.zeros((len(rows), width), dtype=np.int64)
        index[np.arange(width) < lengths[rows][:, None]] = np.fromiter((w for r in rows for w in texts[r]), dtype=np.int64)
        scores = evidence[index]
        scores[np.arange(width) >= lengths[rows][:, None]] = 0
        path = decode(scores, lengths[rows])
        fits = np.take_along_axis(scores, path[:, :, None].astype(np.int64), axis=2)[:, :, 0] >= LEXICAL
        for k, r in enumerate(rows):
            n = int(lengths[r])
            p = path[k, :n]
            cuts = np.flatnonzero(p[1:] != p[:-1]) + 1
            runs = []
            for a, b in zip([0, *cuts], [*cuts, n]):
                lang, sums = int(p[a]), scores[k, a:b].sum(axis=0)
                rest = np.delete(sums, lang)
                confidence = 1 / (1 + np.exp(min(60.0, rest.max() - sums[lang])))
                runs.append((int(r), lang, int(a), int(b) - 1, int(fits[k, a:b].sum()), float(confidence), sums[lang]))
            main = max(runs, key=lambda x: (x[4], x[6]))[1]
            if scores[k, :n].any():
                for run in runs:
                    yield (*run[:6], run[1] == main)
        at = end


def _labelling(name: str, every: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(name)
        known: dict[str, int] = {}
        evidence = np.zeros((0, len(model.languages)))
        for batch in batches:
            if len(known) > 500_000:
                known, evidence = {}, evidence[:0]
            fresh, texts = [], []
            by_token: dict[str, int] = {}
            for text in batch.column(1).to_pylist():
                row = []
                for token in split_words(text):
                    k = by_token.get(token)
                    if k is None:
                        word = normal_word(token)
                        k = known.get(word)
                        if k is None:
                            k = known[word] = len(known)
                            fresh.append(word)
                        by_token[token] = k
                    row.append(k)
                texts.append(row)
            if fresh:
                evidence = np.concatenate([evidence, model.evidence(fresh)])
            found = list(_segments(texts, evidence))
            if every:
                found += [(k, None, None, None, 0, 0.0, True) for k in sorted(set(range(len(texts))) - {x[0] for x in found})]
            rows, langs, first, last, words, sure, main = zip(*found) if found else ([],) * 7
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows, pa.int64())),
                    pa.array([None if x is None else model.languages[x] for x in langs], pa.string()),
                    *(pa.array(x, pa.int32()) for x in (first, last, words)),
                    pa.array(sure, pa.float64()),
                    pa.array(main, pa.bool_()),
                ],
                names=["id", "lang", "first_word", "last_word", "words", "confidence", "main"],
            )

    return run


def fit(samples: DataFrame, lang: str, text: str, order: str, piece_file: str | None = None, rows: int = TRAIN_ROWS) -> Model:
    """A model of at most ``rows`` labelled rows; rows without language or text are left out."""
    usable = samples.filter(F.col(lang).isNotNull() & (F.trim(text) != "")).orderBy(order).select(lang, text).limit(rows)
    return train([(r[0], r[1]) for r in usable.collect()], read_pieces(piece_file or os.path.join(TOKENIZER_DIR, PIECE_FILE)))


def refit(model: Model, samples: list[tuple[str, str]], labelled: DataFrame, ident: str, label: str, text: str, rows: int = MORE_ROWS) -> Model:
    """The model fitted again with up to ``rows`` labelled texts (those with the smallest hash of their id).

    Labels may be wrong: a text counts only if the model finds the label's language, and no other, in it.
    """
    usable = labelled.filter(F.col(label).isin(model.languages) & (F.trim(text) != ""))
    bounded = hashed_sample(usable.select(ident, label, text), ident, rows).select(label, text).distinct()
    texts = sorted((r[0], r[1]) for r in bounded.collect())
    index, words = {}, []
    coded = []
    for _, t in texts:
        row = []
        for token in split_words(t):
            word = normal_word(token)
            if word not in index:
                index[word] = len(words)
                words.append(word)
            row.append(index[word])
        coded.append(row)
    found: dict[int, set[str]] = {}
    for r, lang, _, _, n, confidence, main in _segments(coded, model.evidence(words)):
        if n and (main or n >= SENTENCE_WORDS):
            found.setdefault(r, set()).add(model.languages[lang] if confidence > 0.9 else "")
    agreed = [(lang, t) for k, (lang, t) in enumerate(texts) if found.get(k) == {lang}]
    return train([*samples, *agreed], model.names)


def segments(df: DataFrame, ident: str, text: str, model: Model, every: bool = False) -> DataFrame:
    """``ident, lang, first_word, last_word, words, confidence, main`` of every part of every text in one language.

    Words are split at white space. A word's probability in a language sums over all its segmentations into pieces
    of the fixed vocabulary (forward algorithm); over the text, the best sequence of languages is found where each
    change costs, so single foreign words don't change it. ``words`` counts those that clearly belong to the
    language (names, numbers and tags don't) and may be 0, where the confidence tells how weak the guess is; ``main``
    marks the language with most of them.

    Null, empty and wordless texts give no rows, with ``every`` one without language and with confidence 0; null ids stay null; repeated rows give repeated rows; an empty table
    gives no rows; other columns are ignored, whatever their names. Texts are read whole, however long.
    """
    name = ship_bytes(df.sparkSession, pickle.dumps((model.languages, model.names, model.prob)), ".languages")
    rows = (df if every else df.filter(F.col(text).isNotNull())).select(F.col(ident).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, lang string, first_word int, last_word int, words int, confidence double, main boolean"
    return rows.mapInArrow(_labelling(name, every), schema).withColumnRenamed("id", ident)


def label_code(label: str):
    """The two-letter code that a label names in any of its spellings; null where it names none of the known languages."""
    spelled = F.lower(F.regexp_extract(F.trim(F.col(label)), r"^([\p{L}]+)", 1))
    pairs = [F.lit(x) for code, names in LABELS.items() for name in names.split() for x in (name, code)]
    return F.element_at(F.create_map(*pairs), spelled)


def comment_segments(spark: SparkSession, sf_dir: str, every: bool) -> DataFrame:
    """Parts of every comment, or of those with at least ``MIN_CHARS`` and ``MIN_WORDS``; the model is fitted on the latter in both cases."""
    samples = load(spark, sf_dir, "language_samples")
    model = fit(samples, "lang", "text", "sample_id")
    rows = load(spark, sf_dir, "comments").filter(F.col("comment_id").isNotNull())
    coded = rows.select("comment_id", label_code("language").alias("label"), "cleaned_text")
    long = coded.filter((F.length("cleaned_text") >= MIN_CHARS) & (F.size(F.split(F.trim("cleaned_text"), r"\s+")) >= MIN_WORDS))
    clean = [(r[0], r[1]) for r in samples.orderBy("sample_id").select("lang", "text").limit(TRAIN_ROWS).collect()]
    model = refit(model, clean, long, "comment_id", "label", "cleaned_text")
    keyed = (coded if every else long).select(F.struct("comment_id", "label").alias("key"), "cleaned_text")
    return segments(keyed, "key", "cleaned_text", model, every).select("key.comment_id", "key.label", "lang", "first_word", "last_word", "words", "confidence", "main")


def p7_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of each part of each comment, however short; a comment without words has one row without language and with confidence 0."""
    return comment_segments(spark, sf_dir, True).drop("label", "main").distinct()


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of which a comment of some length has a sentence and which its label doesn't name. Text and label never differ between deliveries."""
    parts = comment_segments(spark, sf_dir, False).filter(F.col("words") > 0)
    there = parts.filter(F.col("main") | (F.col("words") >= SENTENCE_WORDS))
    return there.filter(F.col("label").isNull() | (F.col("label") != F.col("lang"))).select("comment_id", "lang").distinct()


QUERIES = {"p7_found": p7_found, "p7_segments": p7_segments}
SQL: dict[str, str] = {}
