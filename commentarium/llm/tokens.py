"""Problem 8: encoding a corpus with a public byte-level BPE through a minimal acyclic transducer."""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commentarium.session import ship_bytes, written
from commentarium.tables import load

#: Where the public vocabularies lie; override with the environment or the ``rank_file`` parameter.
TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
RANK_FILE = "byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Most words the lexicon holds; bounds what the driver gathers and what every executor fetches.
LEXICON_WORDS = 50_000
#: Words a task remembers between batches.
REMEMBERED = 200_000


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Rank lines ``base64 rank`` to a map of byte strings to ids."""
    pairs = (line.split() for line in data.splitlines() if line)
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word by the exact merges: always the pair of lowest rank, leftmost first. n log n in its bytes."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    end, prev, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = []

    def offer(left: int) -> None:
        right = end[left]
        if right < n and (rank := ranks.get(word[left : end[right]])) is not None:
            heap.append((rank, left, end[right])) if not ready else heapq.heappush(heap, (rank, left, end[right]))

    ready = False
    for i in range(n - 1):
        offer(i)
    heapq.heapify(heap)
    ready = True
    while heap:
        _, left, stop = heapq.heappop(heap)
        if not alive[left]:
            continue
        right = end[left]
        if right >= n or end[right] != stop:
            continue
        alive[right] = False
        end[left] = stop
        if stop < n:
            prev[stop] = left
        offer(left)
        if prev[left] >= 0:
            offer(prev[left])
    ids, at = [], 0
    while at < n:
        ids.append(ranks[word[at : end[at]]])
        at = end[at]
    return ids


def build_transducer(words: list[bytes], ranks: dict[bytes, int]) -> np.ndarray:
    """Compile distinct words into a minimal acyclic automaton that outputs each word's ids.

    Words are added in byte order; as soon as a branch can no longer change, its states are merged with equal ones,
    so equal suffixes share states. Each edge carries how many words sort before the ones it leads to; their sum
    along a path numbers the word, and the number finds its ids. Everything lies in one int32 array, to be
    memory-mapped: counts, edge keys (state * 256 + byte, sorted), targets, skips, final states, offsets, ids.
    """
    words = sorted(set(words))
    register: dict[tuple, int] = {}
    frozen: list[tuple[bool, tuple]] = []  # by state: final, edges (byte, state)

    def freeze(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(frozen)
            frozen.append(key)
        return register[key]

    path: list[list] = [[False, []]]
    last = b""
    for word in words:
        common = len(os.path.commonprefix([last, word]))
        while len(path) > common + 1:
            child = freeze(path.pop())
            path[-1][1].append((last[len(path) - 1], child))
        path.extend([False, []] for _ in word[common:])
        path[-1][0] = True
        last = word
    while len(path) > 1:
        child = freeze(path.pop())
        path[-1][1].append((last[len(path) - 1], child))
    root = freeze(path[0])

    count = [0] * len(frozen)  # words reachable; children are frozen before parents
    keys, targets, skips = [], [], []
    for state, (final, edges) in enumerate(frozen):
        seen = int(final)
        for byte, to in edges:
            keys.append(state * 256 + byte)
            targets.append(to)
            skips.append(seen)
            seen += count[to]
        count[state] = seen
    coded = [merge_word(w, ranks) for w in words]
    offsets = np.cumsum([0, *map(len, coded)])
    head = [len(keys), len(frozen), len(words), int(offsets[-1]), root]
    parts = [head, keys, targets, skips, [int(f) for f, _ in frozen], offsets, [i for ids in coded for i in ids]]
    return np.concatenate([np.asarray(p, dtype=np.int32) for p in parts])


class Transducer:
    """Looks many words up at once in the array of ``build_transducer``."""

    def __init__(self, data: np.ndarray):
        edges, states, words, ids, self.root = (int(x) for x in data[:5])
        cuts = np.cumsum([5, edges, edges, edges, states, words + 1, ids])
        self.keys, self.targets, self.skips, self.final, self.offsets, self.ids = (data[a:b] for a, b in zip(cuts, cuts[1:]))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 where the lexicon doesn't have it. All words advance by one byte a step."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        found = np.full(len(words), -1, dtype=np.int64)
        if not len(self.keys):
            return found
        text = np.frombuffer(b"".join(words), dtype=np.uint8)
        begin = np.cumsum(lengths) - lengths
        at, live = 0, np.flatnonzero(lengths > 0)
        state = np.full(len(live), self.root, dtype=np.int64)
        number = np.zeros(len(live), dtype=np.int64)
        while len(live):
            key = state * 256 + text[begin[live] + at]
            edge = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[edge] == key
            live, edge = live[ok], edge[ok]
            state, number = self.targets[edge].astype(np.int64), number[ok] + self.skips[edge]
            at += 1
            ended = lengths[live] == at
            done = ended & (self.final[state] == 1)
            found[live[done]] = number[done]
            live, state, number = live[~ended], state[~ended], number[~ended]
        return found


@lru_cache(maxsize=4)
def _opened(lexicon: str, rank_name: str) -> tuple[Transducer, dict[bytes, int]]:
    data = np.memmap(SparkFiles.get(lexicon), dtype=np.int32, mode="r")
    with open(SparkFiles.get(rank_name), "rb") as f:
        return Transducer(data), read_ranks(f.read())


def encode_words(words: list[bytes], transducer: Transducer, ranks: dict[bytes, int]) -> list[np.ndarray]:
    """Ids of each word: from the lexicon, or by the exact merges where it has none."""
    numbers = transducer.numbers(words)
    out = []
    for word, k in zip(words, numbers):
        if k >= 0:
            out.append(np.asarray(transducer.ids[transducer.offsets[k] : transducer.offsets[k + 1]]))
        else:
            out.append(np.asarray(merge_word(word, ranks), dtype=np.int32))
    return out


def _encoder(lexicon: str, rank_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer, ranks = _opened(lexicon, rank_name)
        split = regex.compile(PATTERN).findall
        place: dict[str, int] = {}
        flat, sizes, starts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            if len(place) > REMEMBERED:
                place, flat, sizes, starts = {}, np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
            fresh: list[bytes] = []
            indices, lengths = [], []
            for text in batch.column(1).to_pylist():
                words = split(text) if text else []
                lengths.append(len(words))
                for w in words:
                    k = place.get(w)
                    if k is None:
                        k = place[w] = len(place)
                        fresh.append(w.encode())
                    indices.append(k)
            if fresh:
                coded = encode_words(fresh, transducer, ranks)
                flat = np.concatenate([flat, *coded])
                sizes = np.concatenate([sizes, np.fromiter(map(len, coded), np.int64, len(coded))])
                starts = np.cumsum(sizes) - sizes
            index = np.asarray(indices, dtype=np.int64)
            n = sizes[index]
            ends = np.cumsum(n)
            gather = np.repeat(starts[index] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)
            bounds = np.concatenate([[0], ends])[np.cumsum([0, *lengths])]
            ids = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat[gather], pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["id", "ids"])

    return run


def frequent_words(df: DataFrame, text: str, most: int = LEXICON_WORDS) -> list[str]:
    """The words that occur most often over all texts, at most ``most``: those above a power of two that so few reach.

    They only choose what the lexicon holds, never what comes out, so a pattern close to the tokenizer's will do
    here and the count stays in the JVM. The driver gets the number of words per power of two, then the words.
    """
    words = df.select(F.explode(F.expr(rf"regexp_extract_all({_quoted(text)}, ' ?\\p{{L}}+| ?\\p{{N}}+| ?[^\\s\\p{{L}}\\p{{N}}]+', 0)")).alias("w"))
    counted = words.groupBy("w").agg(F.count("*").alias("n")).withColumn("power", F.floor(F.log2("n")).cast("int"))
    counted = written(counted, "words")
    sizes = sorted(((r[0], r[1]) for r in counted.groupBy("power").count().collect()), reverse=True)
    held, least = 0, None
    for power, n in sizes:
        if held + n > most:
            break
        held, least = held + n, power
    if least is None:
        return []
    return sorted(r[0] for r in counted.filter(F.col("power") >= least).select("w").collect())


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def encode_corpus(df: DataFrame, ident: str, text: str, rank_file: str | None = None, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """``ident`` and ``ids`` of every row's text, without special tokens.

    Empty and null texts give an empty list; strings that look like special tokens are ordinary text. Repeated and
    null identifiers come out as they went in, one row per row. An empty table gives no rows. Other columns don't
    come out. Very long texts are encoded whole; a single very long word costs n log n.
    """
    spark = df.sparkSession
    with open(rank_file or os.path.join(TOKENIZER_DIR, RANK_FILE), "rb") as f:
        raw = f.read()
    words = [w.encode() for w in frequent_words(df, text, lexicon_words)]
    lexicon = ship_bytes(spark, build_transducer(words, read_ranks(raw)).tobytes(), ".lexicon")
    rank_name = ship_bytes(spark, raw, ".ranks")
    rows = df.select(F.col(_quoted(ident)).alias("id"), F.col(_quoted(text)).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_encoder(lexicon, rank_name), f"id {kind}, ids array<int>").toDF(ident, "ids")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(load(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {"p8_ids": p8_ids}
SQL: dict[str, str] = {}
