"""Problem 4: scores for abusive, hateful and sexual content, by averaged subword embeddings and a linear softmax."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commentarium.llm.lookalikes import Rewriter
from commentarium.llm.wordings import filled
from commentarium.session import ship_bytes
from commentarium.tables import load

CATEGORIES = ("abusive", "hateful", "sexual")
CLASSES = ("none", *CATEGORIES)
#: Most labelled rows, and most rows known to be harmless, that the model is fitted on.
TRAIN_ROWS, HARMLESS_ROWS = 50_000, 5_000
#: Buckets of hashed features, size of an embedding, lengths of character n-grams.
BUCKETS, DIM, GRAMS = 1 << 17, 24, (3, 4, 5)
#: Features of nothing that are averaged in, so that a word or two alone don't decide.
FEW = 40
EPOCHS, BATCH, RATE, DECAY, SEED = 6, 256, 0.01, 1e-4, 7
#: A phrase of ``PHRASE`` words, taken every ``STRIDE`` words of a sentence and at its end, that this share of all texts holds counts as harmless.
PHRASE, STRIDE, COMMON = 4, 2, 0.001
#: How often a labelled example is shown, each time with other names, and its weight against a harmless stretch.
COPIES, LABELLED_WEIGHT = 4, 10.0
#: The weight of a general wording against a harmless stretch.
GENERAL_WEIGHT = 10.0
#: Stretches drawn from a harmless sentence; pairs made of a common phrase and another one.
STRETCHES, PAIRS = 6, 8
#: The weight of a common phrase, and of each word of those and of harmless texts, alone: many comments are nothing else.
ALONE = 3.0
#: Words of short stretches, which are a third of them.
SHORT = (1, 3)
#: Groups whose names are put before and after a common phrase.
GROUPED = 1
#: A capitalised word in at most so many labelled texts counts as a name, which may be any.
NAME_TEXTS = 2
#: Labelled examples whose label a model of the other half finds less likely than this count as wrongly labelled.
DOUBTED_BELOW = 0.05
#: Models that are averaged.
MODELS = 3
#: Words in a window inside a sentence; a text's score is that of its worst window, so that long texts don't dilute it.
WINDOWS = (7, 14)
#: A category applies from this probability on.
THRESHOLD = 0.64
# Digits and signs written for letters.
LEET = str.maketrans("0134578@$", "oieastbas")

SPELLED = regex.compile(r"(?<![\p{L}\p{N}])([\p{L}\p{N}])(?:([ ._*\-])([\p{L}\p{N}])(?=\2|(?![\p{L}\p{N}])))(?:\2[\p{L}\p{N}](?![\p{L}\p{N}]))+")
REPEATED = regex.compile(r"(.)\1{2,}")
#: Quick looks that tell whether one of the slower patterns can match.
MAY_BE_SPELLED, MAY_BE_REPEATED = re.compile(r"(?:^|[^\w])\w([ ._*\-])\w\1\w"), re.compile(r"(.)\1\1")
TOKEN = re.compile(r"(?:[^\W_]|[*@$])+")
SENTENCE_END = re.compile(r"[.!?…]+(?=\s|$)|\n+")
NAME = re.compile(r"\b[A-ZÀ-ÖØ-Þ][^\W\d_]*[^\W\d_A-ZÀ-ÖØ-Þ][^\W\d_]*")
PARTS = regex.compile(r"[\p{L}\p{N}]")
#: Characters in disguise: accents apart, invisible, full-width, ligature and mathematical forms, words of two scripts.
SUSPECT = re.compile("[̀-ͯ​-‏­⁠﻿＀-￯ﬀ-ﬆ\U0001d400-\U0001d7ff]|[a-zA-Z]\\w*[Ͱ-ӿ]|[Ͱ-ӿ]\\w*[a-zA-Z]")


@lru_cache(maxsize=1)
def _rewriter() -> Rewriter:
    return Rewriter({})


def plain(text: str) -> str:
    """Lower-cased text with disguises taken off: look-alike characters, words spelled out in single letters, stretched letters."""
    if not text.isascii() and SUSPECT.search(text):
        text = _rewriter().rewrite(unicodedata.normalize("NFC", text))[0]
    text = text.lower()
    if MAY_BE_SPELLED.search(text):
        text = SPELLED.sub(lambda m: "".join(PARTS.findall(m.group())), text)
    return REPEATED.sub(r"\1", text) if MAY_BE_REPEATED.search(text) else text


def plain_word(word: str) -> str:
    """A word with letters for the digits and signs between them; figures stay figures, all as one."""
    if word.isdigit():
        return "0"
    return word.translate(LEET) if any(c.isalpha() for c in word) and not word.isalpha() else word


def tokens(text: str) -> list[str]:
    return [plain_word(w) for w in TOKEN.findall(plain(text))]


def sentences(text: str) -> list[str]:
    """Plain sentences of a text."""
    return [s for s in SENTENCE_END.split(plain(text)) if s]


def _spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _rolled(codes: np.ndarray, begin: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the ``n`` characters from each place on."""
    h = np.full(len(begin), n, dtype=np.uint64)
    for k in range(n):
        h = h * np.uint64(0x100000001B3) + codes[begin + k]
    return _spread(h)


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, number of buckets of each word, hash of each word): the word and its character n-grams, begin and end marked.

    Unseen misspellings share most n-grams with the word that is meant.
    """
    marked = [f"<{w}>" for w in words]
    sizes = np.fromiter(map(len, marked), dtype=np.int64, count=len(marked))
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    starts = np.cumsum(sizes) - sizes
    power = np.cumsum(codes * _spread(np.arange(len(codes), dtype=np.uint64) - np.repeat(starts, sizes).astype(np.uint64) + np.uint64(1)), dtype=np.uint64)
    ends = starts + sizes - 1
    whole = _spread(power[ends] - np.where(starts > 0, power[starts - 1], np.uint64(0)) + sizes.astype(np.uint64))
    word, place = [np.arange(len(words))], [whole % np.uint64(BUCKETS)]
    row = np.repeat(np.arange(len(words)), sizes)
    for n in GRAMS:
        begin = np.flatnonzero(np.arange(len(codes)) + n <= (starts + sizes)[row])
        word.append(row[begin])
        place.append(_rolled(codes, begin, n) % np.uint64(BUCKETS))
    word, place = np.concatenate(word), np.concatenate(place).astype(np.int64)
    order = np.argsort(word, kind="stable")
    return place[order], np.bincount(word, minlength=len(words)), whole


def pair_bucket(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Buckets of pairs of neighbouring words, from the words' hashes."""
    h = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0x7F4A7C15))
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(27))) % np.uint64(BUCKETS)).astype(np.int64)


def _text_features(texts: list[list[str]]) -> list[np.ndarray]:
    """All buckets of each text: words, n-grams and pairs of neighbouring words."""
    words = sorted({w for t in texts for w in t})
    index = {w: k for k, w in enumerate(words)}
    place, sizes, hashes = word_features(words)
    own = np.split(place, np.cumsum(sizes)[:-1])
    out = []
    for t in texts:
        at = np.array([index[w] for w in t], dtype=np.int64)
        out.append(np.concatenate([*(own[k] for k in at), pair_bucket(hashes[at[:-1]], hashes[at[1:]])]))
    return out


def _optimise(rows: list[np.ndarray], labels: np.ndarray, weight: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Embeddings and softmax trained jointly by Adam with weighted cross entropy; logits of every bucket, the bias last."""
    used = np.unique(np.concatenate(rows))
    place = np.zeros(BUCKETS, dtype=np.int64)
    place[used] = np.arange(len(used))
    rows = [place[f] for f in rows]
    table = rng.normal(0, 0.05, (len(used), DIM)).astype(np.float32)
    out, bias = rng.normal(0, 0.1, (DIM, len(CLASSES))).astype(np.float32), np.zeros(len(CLASSES), dtype=np.float32)
    params = [table, out, bias]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    weight = weight / weight.mean()
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            sizes = np.array([len(rows[i]) for i in chosen])
            flat = np.concatenate([rows[i] for i in chosen])
            starts = np.cumsum(sizes) - sizes
            keep = (rng.random(len(flat)) > 0.3).astype(np.float32)  # left out at random, so that no feature decides alone
            held = (np.add.reduceat(keep, starts) + FEW)[:, None]
            mean = np.add.reduceat(table[flat] * keep[:, None], starts, axis=0) / held
            logits = mean @ out + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(chosen)), labels[chosen]] -= 1
            p = (p * (weight[chosen] / len(chosen))[:, None]).astype(np.float32)
            each = np.repeat((p @ out.T) / held, sizes, axis=0) * keep[:, None]
            by = np.argsort(flat, kind="stable")
            cut = np.flatnonzero(np.append(True, flat[by][1:] != flat[by][:-1]))
            grad_table = DECAY * table
            grad_table[flat[by][cut]] += np.add.reduceat(each[by], cut, axis=0)
            step += 1
            for k, g in enumerate((grad_table, mean.T @ p + DECAY * out, p.sum(axis=0))):
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                params[k] -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    logits = np.zeros((BUCKETS + 1, len(CLASSES)), dtype=np.float32)
    logits[used] = table @ out
    logits[-1] = bias
    return logits


def _names_and_groups(examples: list[tuple[str, str]], harmless: list[str]) -> tuple[Counter, list[str], list[str]]:
    """(labelled texts that hold each name, names of people and places, names of groups): groups are often named, mostly with hatred."""
    held, hated = Counter(), Counter()
    for text, label in examples:
        for n in set(NAME.findall(text)):
            held[n] += 1
            hated[n] += label == "hateful"
    groups = sorted(n for n, k in held.items() if k > NAME_TEXTS and 2 * hated[n] > k)
    names = sorted({m.group() for text in harmless for m in NAME.finditer(text) if m.start()}) or sorted(n for n, k in held.items() if k <= NAME_TEXTS)
    return held, names, groups


def _shown(examples: list[tuple[str, str]], harmless: list[str], rng: np.random.Generator) -> list[tuple[list[str], int, float, int]]:
    """(words, class, weight, example's number) of labelled examples, several times each: with other names, and with harmless words around them.

    Names must not tell anything, and comments go on about other things. Nor must names of groups, which the labels
    show with hatred only, so every second time harmless texts get those.
    """
    held, names, groups = _names_and_groups(examples, harmless)

    def renamed(text: str, instead: list[str]) -> str:
        return NAME.sub(lambda m: instead[int(rng.integers(len(instead)))] if held[m.group()] <= NAME_TEXTS else m.group(), text)

    around = [w for w in (tokens(t) for t in [*(t for t, y in examples if y == CLASSES[0]), *harmless]) if w] or [["so"]]
    out = []
    for number, (text, label) in enumerate(examples):
        y = CLASSES.index(label)
        for k in range(COPIES):
            instead = groups if groups and not y and k % 2 else names
            words = tokens(renamed(text, instead) if k and instead else text)
            if not words:
                break
            out.append((words, y, LABELLED_WEIGHT / COPIES, number))
            if y:
                other = around[int(rng.integers(len(around)))]
                half = LABELLED_WEIGHT / COPIES / 2
                out += [([*other[-3:], *words], y, half, number), ([*words, *other[:3]], y, half, number)]
    return out


def _general(examples: list[tuple[str, str]], harmless: list[str], rng: np.random.Generator) -> list[tuple[list[str], int, float]]:
    """(words, class, weight) of the general wordings, with names from harmless texts and the groups that the labels show."""
    _, names, groups = _names_and_groups(examples, harmless)
    around = [w for w in map(tokens, harmless) if w] or [["so"]]
    out = []
    for text, label in filled(names, groups, COPIES, rng):
        words, y = tokens(text), CLASSES.index(label)
        if not words:
            continue
        out.append((words, y, GENERAL_WEIGHT / COPIES))
        if y:
            other = around[int(rng.integers(len(around)))]
            half = GENERAL_WEIGHT / COPIES / 2
            out += [([*other[-3:], *words], y, half), ([*words, *other[:3]], y, half)]
    return out


def _background(harmless: list[str], phrases: list[str], groups: list[str], rng: np.random.Generator) -> list[tuple[list[str], float]]:
    """(words, weight) of stretches of harmless sentences; their words alone; common phrases alone, joined where they overlap, with a group's name, and followed by another one."""
    out = []
    for text in harmless:
        for sentence in sentences(text):
            if words := tokens(sentence):
                for size in (int(n) for n in rng.choice([*WINDOWS, *WINDOWS, *SHORT], STRETCHES)):
                    at = int(rng.integers(0, max(1, len(words) - size + 1)))
                    out.append(words[at : at + size])
    common = [w for p in phrases if (w := tokens(p))]
    alone = [*common, *([w] for w in sorted({w for words in (*map(tokens, harmless), *common) for w in words}))]
    begin = defaultdict(list)  # phrases by their first words, to join those that overlap into longer stretches
    for words in common:
        for k in range(1, len(words)):
            begin[k, tuple(words[:k])].append(words)
    for words in common:
        shared = {PHRASE - 1, PHRASE - STRIDE} if len(words) == PHRASE else set()
        out += [[*words, *after[k:]] for k in sorted(shared) for after in begin[k, tuple(words[-k:])]]
        out += [[*words, *common[int(rng.integers(len(common)))]] for _ in range(PAIRS)]
        for name in (tokens(groups[int(rng.integers(len(groups)))]) for _ in range(GROUPED if groups else 0)):
            out += [[*words, *name], [*name, *words]]
    return [*((words, 1.0) for words in out), *((words, ALONE) for words in alone)]


def train(examples: list[tuple[str, str]], harmless: list[str], phrases: list[str]) -> np.ndarray:
    """Logits of every bucket (embedding times softmax weights), with the bias as a last row.

    ``harmless`` are texts known to be so; ``phrases`` are common in the corpus, so taken for harmless. No other text
    is: what neither the labels nor those show stays open, and rare wordings aren't taught as harmless. General wordings
    in seven languages are added for what the labels don't show. Names of groups are shown in harmless texts too. Labels that a model of the other half of the labels
    finds unlikely are left out as wrong; the rest trains several models, whose logits are averaged.
    """
    rng = np.random.default_rng(SEED)
    known, background = _shown(examples, harmless, rng), _background(harmless, phrases, _names_and_groups(examples, harmless)[2], rng)
    if not known:
        return np.zeros((BUCKETS + 1, len(CLASSES)), dtype=np.float32)
    features = _text_features([w for w, *_ in known])
    others = [*_general(examples, harmless, rng), *((words, 0, w) for words, w in background)]
    more = _text_features([w for w, _, _ in others])

    def fitted(chosen: np.ndarray) -> np.ndarray:
        labels = np.array([known[k][1] for k in chosen] + [y for _, y, _ in others])
        weight = np.array([known[k][2] for k in chosen] + [w for _, _, w in others])
        return _optimise([*(features[k] for k in chosen), *more], labels, weight, rng)

    of = np.array([number for *_, number in known])
    likely = np.zeros(len(known))
    for part in range(2):
        judged = np.flatnonzero(of % 2 == part)
        if not len(judged) or len(judged) == len(known):
            likely[judged] = 1
            continue
        logits = fitted(np.flatnonzero(of % 2 != part))
        sums = np.stack([logits[features[k]].sum(axis=0) / (len(features[k]) + FEW) for k in judged]) + logits[-1]
        p = np.exp(sums - sums.max(axis=1, keepdims=True))
        likely[judged] = (p / p.sum(axis=1, keepdims=True))[np.arange(len(judged)), [known[k][1] for k in judged]]
    agreed = (np.bincount(of, likely) / np.maximum(np.bincount(of), 1))[of] >= DOUBTED_BELOW
    chosen = np.flatnonzero(agreed) if agreed.any() else np.arange(len(known))
    return np.mean([fitted(chosen) for _ in range(MODELS)], axis=0)


@lru_cache(maxsize=2)
def _logits(name: str) -> np.ndarray:
    return np.memmap(SparkFiles.get(name), dtype=np.float32, mode="r").reshape(-1, len(CLASSES))


class Scorer:
    """Scores many texts at once; remembers the features of words."""

    def __init__(self, logits: np.ndarray):
        self.logits = np.asarray(logits)
        self.known: dict[str, int] = {}
        self.written: dict[str, int] = {}  # the same by the word as it stands in the text
        self.sums = np.zeros((0, len(CLASSES)), dtype=np.float32)
        self.sizes, self.hashes = np.zeros(0, dtype=np.float32), np.zeros(0, dtype=np.uint64)

    def _learn(self, fresh: list[str]) -> None:
        place, sizes, hashes = word_features(fresh)
        sums = np.add.reduceat(self.logits[place], np.cumsum(sizes) - sizes, axis=0)
        self.sums = np.concatenate([self.sums, sums])
        self.sizes = np.concatenate([self.sizes, sizes.astype(np.float32)])
        self.hashes = np.concatenate([self.hashes, hashes])

    def score(self, texts: list[str]) -> np.ndarray:
        """The probabilities of ``CATEGORIES``, each in the text's window where it is likeliest. Windows lie within sentences."""
        if len(self.known) > 500_000:
            self.__init__(self.logits)
        fresh, index, lengths, of = [], [], [], []
        for place, text in enumerate(texts):
            for sentence in sentences(text):
                words = TOKEN.findall(sentence)
                if not words:
                    continue
                lengths.append(len(words))
                of.append(place)
                for w in words:
                    k = self.written.get(w)
                    if k is None:
                        norm = plain_word(w)
                        k = self.known.get(norm)
                        if k is None:
                            k = self.known[norm] = len(self.known)
                            fresh.append(norm)
                        self.written[w] = k
                    index.append(k)
        if fresh:
            self._learn(fresh)
        out = np.zeros((len(texts), len(CATEGORIES)), dtype=np.float64)
        if not index:
            return out
        at, n = np.array(index, dtype=np.int64), np.array(lengths, dtype=np.int64)
        starts = np.cumsum(n) - n
        begin = np.repeat(starts, n)
        stop = begin + np.repeat(n, n)
        pairs = np.zeros((len(at), len(CLASSES)), dtype=np.float64)  # of each word with the one after it
        pairs[:-1] = self.logits[pair_bucket(self.hashes[at[:-1]], self.hashes[at[1:]])]
        zero = np.zeros((1, len(CLASSES)))
        total = np.concatenate([zero, np.cumsum(self.sums[at], axis=0, dtype=np.float64)])
        paired = np.concatenate([zero, np.cumsum(pairs, axis=0)])
        counted = np.concatenate([[0.0], np.cumsum(self.sizes[at], dtype=np.float64)])
        here = np.arange(len(at))
        for window in WINDOWS:
            # windows start at every word, or end with the sentence
            left = np.maximum(np.minimum(here, stop - window), begin)
            right = np.minimum(left + window, stop)
            sums = total[right] - total[left] + paired[np.maximum(right - 1, left)] - paired[left]
            logits = sums / (counted[right] - counted[left] + right - left - 1 + FEW)[:, None] + self.logits[-1]
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            np.maximum.at(out, of, np.maximum.reduceat(p[:, 1:] / p.sum(axis=1, keepdims=True), starts, axis=0))
        return out


def _scoring(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(_logits(name))
        for batch in batches:
            if batch.num_rows:
                scores = scorer.score(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, scores.T)], names=["id", *CATEGORIES])

    return run


def common_phrases(corpus: DataFrame, text: str) -> list[str]:
    """Phrases that at least ``COMMON`` of all texts hold, counted over all of them; figures count as 0.

    A text of w words holds at most w / STRIDE + 2 phrases a sentence, so there are at most (mean words / STRIDE + 2
    mean sentences) / COMMON common ones, whatever the number of texts.
    """
    held = corpus.filter(F.col(text).isNotNull()).select(F.regexp_replace(F.lower(text), r"\p{Nd}+", "0").alias("t"))
    n = held.count()
    parts = held.select(F.monotonically_increasing_id().alias("k"), F.explode(F.split("t", r"[.!?…]+(?=\s|$)|\n+")).alias("s"))
    words = parts.select("k", F.filter(F.split("s", r"[^\p{L}\p{N}]+"), lambda w: w != "").alias("w")).filter(F.size("w") > 0)
    last = F.greatest(F.size("w") - PHRASE, F.lit(0))
    starts = F.array_union(F.sequence(F.lit(0), last, F.lit(STRIDE)), F.array(last))
    phrases = words.select("k", F.explode(F.transform(starts, lambda i: F.concat_ws(" ", F.slice(F.col("w"), i + 1, PHRASE)))).alias("p"))
    common = phrases.groupBy("p").agg(F.count("*").alias("n")).filter(F.col("n") >= max(2, COMMON * n))
    return sorted(r[0] for r in common.select("p").collect())


def fit(examples: DataFrame, text: str, label: str, order: str, corpus: DataFrame, corpus_text: str, harmless: DataFrame | None = None) -> np.ndarray:
    """A model of at most ``TRAIN_ROWS`` labelled rows, ``HARMLESS_ROWS`` harmless texts and the phrases common in the whole corpus.

    ``harmless`` has texts as its only column. Rows without text or with another label are left out.
    """
    usable = examples.filter(F.col(label).isin(list(CLASSES)) & F.col(text).isNotNull()).orderBy(order).select(text, label).limit(TRAIN_ROWS)
    clean = [] if harmless is None else sorted(r[0] for r in harmless.filter(F.col(harmless.columns[0]).isNotNull()).orderBy(harmless.columns[0]).limit(HARMLESS_ROWS).collect())
    return train([(r[0], r[1]) for r in usable.collect()], clean, common_phrases(corpus, corpus_text))


def abuse_scores(df: DataFrame, ident: str, text: str, logits: np.ndarray) -> DataFrame:
    """``ident`` and a probability per category for every row.

    A text's words, their character n-grams and pairs of words are looked up in the trained table and averaged over
    windows within sentences; for each category the worst window counts, so several may apply. Null and empty texts score 0; null ids stay null; repeated rows give repeated
    rows; an empty table gives no rows; other columns are ignored, whatever their names. Texts are read whole.
    """
    name = ship_bytes(df.sparkSession, logits.astype(np.float32).tobytes(), ".logits")
    rows = df.select(F.col(ident).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = ", ".join([f"id {kind}", *(f"{c} double" for c in CATEGORIES)])
    return rows.mapInArrow(_scoring(name), schema).withColumnRenamed("id", ident)


def _comment_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "comments").filter(F.col("comment_id").isNotNull())
    clean = load(spark, sf_dir, "language_samples").select("text")
    logits = fit(load(spark, sf_dir, "abuse_labels"), "text", "label", "example_id", rows, "text", clean)
    keyed = rows.select(F.struct("comment_id", "video_id").alias("key"), "text")
    scores = abuse_scores(keyed, "key", "text", logits)
    return scores.select("key.comment_id", "key.video_id", *(F.round(c, 4).alias(c) for c in CATEGORIES))


def p4_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each comment's score per category. Text and video of a comment never differ between deliveries."""
    return _comment_scores(spark, sf_dir).drop("video_id").dropDuplicates(["comment_id"])


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each video's number of comments and the share of them that each category applies to."""
    rows = _comment_scores(spark, sf_dir).filter(F.col("video_id").isNotNull()).dropDuplicates(["comment_id"])
    rates = [F.round(F.avg((F.col(c) >= THRESHOLD).cast("double")), 4).alias(f"{c}_rate") for c in CATEGORIES]
    return rows.groupBy("video_id").agg(F.count("*").alias("comments"), *rates)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("score")) for c in CATEGORIES])
    long = _comment_scores(spark, sf_dir).select("comment_id", F.explode(fields).alias("f"))
    return long.filter(F.col("f.score") >= THRESHOLD).select("comment_id", "f.category").distinct()


QUERIES = {"p4_found": p4_found, "p4_scores": p4_scores, "p4_rates": p4_rates}
SQL: dict[str, str] = {}
