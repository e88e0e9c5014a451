"""Problem 3: groups of texts that differ by small edits, by order MinHash and banded alignment."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commentarium.session import ship_bytes, written
from commentarium.tables import load

#: A pair is found when it shares this part of its words, both texts having at least so many.
MIN_SHARE, MIN_WORDS = 0.7, 30
#: Sketches of a text, each of the two smallest labelled words in text order.
SKETCHES, KEPT = 40, 2
#: Powers of rarity by which the sketches draw words, in turn: most look at rare words, some also at commoner ones.
RARITY = (1.0, 1.0, 0.6)
#: Buckets of more texts than this go the exact way (shared rare words) instead of being paired within one task.
LARGEST_BUCKET = 1 << 16
#: Pairs compared at a time, and rows of a bucket up to which buckets of one size are compared together.
PAIRS, SMALL_BUCKET = 200_000, 256
#: Counters of how many texts hold a labelled word; a fixed number, so its size doesn't grow with the data.
COUNTERS = 1 << 20
#: Half width of the alignment band, in words.
BAND = 12
#: Most elements of a padded matrix at a time.
CELLS = 4_000_000


def _mix(x: np.ndarray) -> np.ndarray:
    """Fixed value: the finaliser of a public 64-bit hash; spreads every input bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of a list column without nulls."""
    offsets = lists.offsets.to_numpy()
    values = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    return values.astype(np.int64).view(np.uint64), np.diff(offsets)


def labelled(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Word hashes with the number of the occurrence within the text mixed in, in text order."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    order = np.lexsort((np.arange(len(values)), values, row))
    v, r = values[order], row[order]
    new = np.ones(len(v), dtype=bool)
    new[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    starts = np.flatnonzero(new)
    times = np.arange(len(v)) - np.repeat(starts, np.diff(np.append(starts, len(v))))
    out = np.empty_like(values)
    out[order] = _mix(v + times.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return out


def _counter(labels: np.ndarray) -> np.ndarray:
    return (labels & np.uint64(COUNTERS - 1)).astype(np.int64)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(COUNTERS, dtype=np.int64)
    for batch in batches:
        total += np.bincount(_counter(_flat(batch.column(0))[0]), minlength=COUNTERS)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"at": pa.array(used, pa.int32()), "n": pa.array(total[used], pa.int64())})


def frequency_file(texts: DataFrame) -> str:
    """Count in how many texts each labelled word (by counter) occurs, and let every task map the counts into memory."""
    counted = texts.select("labels").mapInArrow(_frequencies, "at int, n long").groupBy("at").agg(F.sum("n").alias("n"))
    table = counted.toArrow()
    total = np.zeros(COUNTERS, dtype=np.int64)
    total[table["at"].to_numpy()] = table["n"].to_numpy()
    return ship_bytes(texts.sparkSession, np.minimum(total, 2**31 - 1).astype(np.int32).tobytes(), ".counts")


@lru_cache(maxsize=4)
def _counts(name: str) -> np.ndarray:
    return np.memmap(SparkFiles.get(name), dtype=np.int32, mode="r")


def _blocks(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Rows in groups of similar length, so that padding them makes no large matrix."""
    order, at = np.argsort(lengths, kind="stable"), 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * lengths[order[end]] <= CELLS:
            end += 1
        yield order[at:end]
        at = end


def sketch_keys(labels: np.ndarray, lengths: np.ndarray, counts: np.ndarray, sketches: int = SKETCHES) -> np.ndarray:
    """Order-MinHash keys, one column a sketch.

    Every sketch orders a text's labelled words by a hash of its own and keeps the ``KEPT`` smallest in text order.
    Words are drawn in proportion to a power of their rarity (1 / number of texts), since words that many texts share
    would only fill buckets with texts that aren't alike; words of one text alone can't be shared and are drawn last.
    """
    begin = np.cumsum(lengths) - lengths
    keys = np.zeros((len(lengths), sketches), dtype=np.uint64)
    held = counts[_counter(labels)].astype(np.float64)
    cost = np.where(held <= 1, 1e15, held)
    for rows in _blocks(lengths):
        width = max(int(lengths[rows].max()), KEPT) if len(rows) else 0
        at = begin[rows][:, None] + np.arange(width)
        real = np.arange(width) < lengths[rows][:, None]
        at = np.where(real, at, 0)
        block, prices = labels[at], {p: np.where(real, cost[at] ** p, np.inf) for p in set(RARITY)}
        for j in range(sketches):
            uniform = ((_mix(block ^ _mix(np.array([j + 1], dtype=np.uint64))) >> np.uint64(11)).astype(np.float64) + 1) / 2.0**53
            drawn = -np.log(uniform) * prices[RARITY[j % len(RARITY)]]
            drawn[~real] = np.inf
            first = np.argpartition(drawn, KEPT - 1, axis=1)[:, :KEPT] if width > KEPT else np.tile(np.arange(width), (len(rows), 1))
            first.sort(axis=1)
            chosen = np.take_along_axis(block, first, axis=1)
            key = np.full(len(rows), j + 1, dtype=np.uint64)
            for k in range(chosen.shape[1]):
                key = _mix(key * np.uint64(31) + chosen[:, k])
            keys[rows, j] = key
    return keys


def _sketching(counts_name: str, sketches: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _counts(counts_name)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = sketch_keys(*_flat(batch.column(1)), counts, sketches)
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), sketches)))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), ids], names=["key", "rid"])

    return run


def _met_often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key: those whose key another row has. Holds one batch and the last row before it."""
    held, met = None, False  # the last row so far, and whether its key came before it
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        before = int(held.column(0)[0].as_py()) if held is not None else None
        follows = np.append(before is not None and keys[0] == before, keys[1:] == keys[:-1])
        if held is not None and (met or follows[0]):
            yield held
        often = follows[:-1] | follows[1:]
        if often.any():
            yield batch.slice(0, len(keys) - 1).filter(pa.array(often))
        held, met = batch.slice(len(keys) - 1), bool(follows[-1])
    if met:
        yield held


def _alike(n: np.ndarray, m1: np.ndarray, m2: np.ndarray, left, right, min_share: float) -> np.ndarray:
    """Whether pairs may share enough words: a bit that only one text has is a word that only it has, so this loses none."""
    a1, a2, b1, b2 = m1[left], m2[left], m1[right], m2[right]
    count = lambda x, y: (np.bitwise_count(x) + np.bitwise_count(y)).astype(np.int32)
    most = np.minimum(n[left] - count(a1 & ~b1, a2 & ~b2), n[right] - count(b1 & ~a1, b2 & ~a2))
    return most >= (min_share - 1e-12) * (n[left] + n[right] - most)


def _places(starts: np.ndarray, sizes: np.ndarray, rest: tuple, min_share: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs within runs that may be alike, from ``n, m1, m2`` in ``rest`` (of all pairs without), not many at a time."""
    for size in np.unique(sizes[sizes <= SMALL_BUCKET]):
        own, (i, j) = starts[sizes == size, None], np.triu_indices(size, 1)
        most = max(1, PAIRS // len(i))
        for k in range(0, len(own), most):
            left, right = (own[k : k + most] + i).ravel(), (own[k : k + most] + j).ravel()
            if rest:
                likely = _alike(*rest, left, right, min_share)
                left, right = left[likely], right[likely]
            yield left, right
    for start, size in zip(starts[sizes > SMALL_BUCKET], sizes[sizes > SMALL_BUCKET]):
        step = max(1, PAIRS // size)
        for k in range(start, start + size, step):
            rows, others = np.arange(k, min(k + step, start + size))[:, None], np.arange(k + 1, start + size)[None, :]
            later = others > rows
            i, j = np.nonzero(later & _alike(*rest, rows, others, min_share) if rest else later)
            yield i + k, j + k + 1


def _paired(batches: Iterator[pa.RecordBatch], min_share: float = MIN_SHARE) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key: pairs within each run of equal keys; of runs that are too large, each row alone (b null).

    Rows may have ``n, m1, m2`` of their texts after ``key, rid``; then only pairs that may be alike come out, so that
    what is written follows the copies and not the buckets. Holds one batch and the open run, of which no more rows
    than a bucket may have.
    """

    def emit(keys: np.ndarray, ids: pa.Array, rest: tuple) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        sizes = np.diff(np.append(starts, len(keys)))
        fit = (sizes > 1) & (sizes <= LARGEST_BUCKET)
        for left, right in _places(starts[fit], sizes[fit], rest, min_share):
            if len(left):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(left)), ids.take(pa.array(right))], names=["a", "b"])
        large = np.repeat(sizes > LARGEST_BUCKET, sizes)
        if large.any():
            a = ids.filter(pa.array(large))
            yield pa.RecordBatch.from_arrays([a, pa.nulls(len(a), pa.string())], names=["a", "b"])

    parts, waiting, overflow = [], 0, None  # batches of the open run, joined only when it ends

    def joined(own: list[pa.RecordBatch]) -> tuple[np.ndarray, pa.Array, tuple]:
        columns = [pa.concat_arrays(c) for c in zip(*(b.columns for b in own))]
        rest = [c.to_numpy() for c in columns[2:]]
        return columns[0].to_numpy(), columns[1], tuple([rest[0].astype(np.int32), *(m.view(np.uint64) for m in rest[1:])] if rest else ())

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        if overflow is not None:  # the rest of a run already known to be too large
            same = int(np.searchsorted(keys != overflow, True)) if keys[0] == overflow else 0
            if same:
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(0, same), pa.nulls(same, pa.string())], names=["a", "b"])
                keys, batch = keys[same:], batch.slice(same)
            if not len(keys):
                continue
            overflow = None
        last = len(keys) - int(np.searchsorted((keys != keys[-1])[::-1], True)) if keys[0] != keys[-1] else 0
        if parts and (last or keys[0] != open_key):
            same = int(np.searchsorted(keys != open_key, True)) if keys[0] == open_key else 0
            yield from emit(*joined([*parts, batch.slice(0, same)]))
            parts, waiting, keys, batch, last = [], 0, keys[same:], batch.slice(same), last - same
        if last > 0:
            yield from emit(*joined([batch.slice(0, last)]))
            batch = batch.slice(last)
        open_key = int(keys[-1])
        parts.append(batch)
        waiting += batch.num_rows
        if waiting > LARGEST_BUCKET:
            yield from emit(*joined(parts))
            overflow, parts, waiting = open_key, [], 0
    if parts:
        yield from emit(*joined(parts))


def aligned_words(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray, band: int = BAND) -> np.ndarray:
    """Words that two texts have in common in the same order, as far as a diagonal band shows; padded rows, many pairs at once."""
    n, wide = a.shape[0], 2 * band + 1
    best = np.zeros((n, wide + 1), dtype=np.int32)  # column d: position i + d - band of b; the last is a border
    padded = np.pad(b, ((0, 0), (band, band + a.shape[1])))
    inside = np.arange(padded.shape[1])[None, :] - band
    inside = (inside >= 0) & (inside < lb[:, None])
    for i in range(a.shape[1]):
        # b's words under the band in this row, one column to the left as the match ends there
        same = (padded[:, i : i + wide] == a[:, i : i + 1]) & inside[:, i : i + wide] & (i < la)[:, None]
        step = best[:, :wide] + same
        step[:, :-1] = np.maximum(step[:, :-1], best[:, 1:wide])
        best[:, :wide] = np.maximum.accumulate(step, axis=1)
    return best[:, :wide].max(axis=1)


def _padded(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    out = np.zeros((len(lengths), int(lengths.max())), dtype=np.uint64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = values
    return out


def _verified(min_share: float):
    """Pairs that share enough words: as many as the alignment finds in order or, where that is too few, in any order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            (va, la), (vb, lb) = _flat(batch.column(2)), _flat(batch.column(3))
            begin_a, begin_b = np.cumsum(la) - la, np.cumsum(lb) - lb
            matched = np.zeros(len(la), dtype=np.int64)
            for rows in _blocks(np.maximum(la, lb) + 2 * BAND):
                xa = np.concatenate([va[x : x + y] for x, y in zip(begin_a[rows], la[rows])])
                xb = np.concatenate([vb[x : x + y] for x, y in zip(begin_b[rows], lb[rows])])
                matched[rows] = aligned_words(_padded(xa, la[rows]), la[rows], _padded(xb, lb[rows]), lb[rows])
            aligned = matched / np.maximum(la, lb)
            enough = np.ceil(min_share * (la + lb) / (1 + min_share) - 1e-9)
            for k in np.flatnonzero(matched < enough):  # moved sentences or far shifts; labels don't repeat within a text
                matched[k] = len(np.intersect1d(va[begin_a[k] : begin_a[k] + la[k]], vb[begin_b[k] : begin_b[k] + lb[k]], assume_unique=True))
            keep = pa.array(matched >= enough)
            share = pa.array(matched / (la + lb - matched))
            columns = [batch.column(0), batch.column(1), share, pa.array(np.round(aligned, 4))]
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in columns], names=["a", "b", "share", "aligned"])

    return run


def _rare_prefixes(counts_name: str, min_share: float):
    """The rarest words of a text of which any text similar enough shares at least one (prefix filter)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _counts(counts_name)
        for batch in batches:
            labels, lengths = _flat(batch.column(1))
            row = np.repeat(np.arange(len(lengths)), lengths)
            order = np.lexsort((labels, counts[_counter(labels)], row))
            place = np.arange(len(order)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            keep = place < np.repeat(lengths - np.ceil(min_share * lengths - 1e-9).astype(np.int64) + 1, lengths)
            ids, n, m1, m2 = (batch.column(c).take(pa.array(row[keep])) for c in ("rid", "n", "m1", "m2"))
            yield pa.RecordBatch.from_arrays([pa.array(labels[order][keep].view(np.int64)), ids, n, m1, m2], names=["key", "rid", "n", "m1", "m2"])

    return run


def _labelling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        values, lengths = _flat(batch.column(3))
        labels = labelled(values, lengths)
        starts = np.cumsum(lengths) - lengths
        bit = np.uint64(1) << (labels & np.uint64(63))
        high = (labels & np.uint64(64)) > 0
        maps = [np.bitwise_or.reduceat(np.where(high == h, bit, np.uint64(0)), starts).view(np.int64) for h in (False, True)]
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)), pa.int32()), pa.array(labels.view(np.int64)))
        names = ["b1", "b2", "rid", "labels", "n", "m1", "m2"]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists, pa.array(lengths, pa.int32()), *map(pa.array, maps)], names=names)


def classes_of_copies(df: DataFrame, ident: str, text: str, min_words: int) -> tuple[DataFrame, DataFrame]:
    """(representatives ``rid, labels, n, m1, m2``; membership ``rid, id``) of texts with the same words, counted with repetition.

    ``labels`` are the hashes of a text's ``n`` words, each with the number of its occurrence, in text order; ``m1``
    and ``m2`` are a map of 128 bits with a bit for each label.
    """
    words = F.expr(rf"regexp_extract_all(lower(`{text}`), '[\\p{{L}}\\p{{N}}]+', 0)")
    rows = df.filter(F.col(ident).isNotNull()).select(F.col(ident).cast("string").alias("id"), words.alias("words"))
    rows = rows.filter(F.size("words") >= min_words)
    rows = rows.select("id", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes")).withColumn("bag", F.array_sort("hashes"))
    long = rows.select("id", F.xxhash64("bag").alias("b1"), F.xxhash64(F.lit(7), "bag").alias("b2"), "hashes")
    kept = long.groupBy("b1", "b2").agg(F.min(F.struct("id", "hashes")).alias("r")).select("b1", "b2", "r.id", "r.hashes")
    texts = written(kept.mapInArrow(_labelling, "b1 long, b2 long, rid string, labels array<long>, n int, m1 long, m2 long"), "texts")
    members = long.select("id", "b1", "b2").distinct().join(texts.select("b1", "b2", "rid"), ["b1", "b2"]).select("rid", "id")
    return texts.drop("b1", "b2"), members


def similar_classes(texts: DataFrame, min_share: float = MIN_SHARE, sketches: int = SKETCHES) -> DataFrame:
    """``a, b, share, aligned`` of all pairs of representatives that share ``min_share`` of their words.

    Candidates are first compared by their maps (a bit that only one text has is a word that only it has, so this
    bound loses nothing), where they meet and before anything is written about them: their number grows faster than
    the texts. Then they are aligned: a pair whose alignment matches enough words in order is accepted with that
    share. Only where it doesn't, as sentences were moved, are words counted in any order. ``aligned`` is the part of
    the longer text that the banded alignment matches.
    """
    counts = frequency_file(texts)
    rows = texts.select("rid", "labels").mapInArrow(_sketching(counts, sketches), "key long, rid string")
    often = written(rows.repartition("key").sortWithinPartitions("key").mapInArrow(_met_often, "key long, rid string"), "often")
    mapped = often.join(texts.select("rid", "n", "m1", "m2"), "rid").select("key", "rid", "n", "m1", "m2")
    met = written(mapped.repartition("key").sortWithinPartitions("key").mapInArrow(partial(_paired, min_share=min_share), "a string, b string"), "met")
    pairs = met.filter(F.col("b").isNotNull()).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    crowded = met.filter(F.col("b").isNull()).select(F.col("a").alias("rid")).distinct()
    prefixes = texts.join(crowded, "rid", "left_semi").select("rid", "labels", "n", "m1", "m2").mapInArrow(_rare_prefixes(counts, min_share), "key long, rid string, n int, m1 long, m2 long")
    x, y = prefixes.toDF("key", "a", "na", "a1", "a2"), prefixes.toDF("key", "b", "nb", "b1", "b2")
    only = lambda x, y: F.expr(f"bit_count({x}1 & ~{y}1) + bit_count({x}2 & ~{y}2)")
    most = F.least(F.col("na") - only("a", "b"), F.col("nb") - only("b", "a"))
    near = x.join(y, "key").filter((F.col("a") < F.col("b")) & (most / (F.col("na") + F.col("nb") - most) >= min_share - 1e-12))
    likely = pairs.unionByName(near.select("a", "b")).distinct()
    lists = texts.select("rid", "labels")
    first = likely.join(lists.toDF("a", "la"), "a")
    both = first.join(lists.toDF("b", "lb"), "b").select("a", "b", "la", "lb")
    return both.mapInArrow(_verified(min_share), "a string, b string, share double, aligned double")


def near_copy_classes(df: DataFrame, ident: str, text: str, min_share: float = MIN_SHARE, min_words: int = MIN_WORDS) -> DataFrame:
    """``id, class_id, links`` of every text of ``min_words`` words: its class and how many other texts are near copies.

    A class is the texts with the same words; ``class_id`` is its smallest id. Copies are never paired with each
    other: links are counted from the sizes of classes. Null ids and null, empty or short texts have no row.
    """
    texts, members = classes_of_copies(df, ident, text, min_words)
    members = written(members, "members")
    sizes = written(members.groupBy("rid").agg(F.count("*").alias("size")), "sizes")
    links = written(similar_classes(texts, min_share).select("a", "b"), "links")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(sizes.toDF("b", "size"), "b").groupBy(F.col("a").alias("rid")).agg(F.sum("size").alias("near"))
    linked = sizes.join(near, "rid", "left").select("rid", (F.col("size") - 1 + F.coalesce("near", F.lit(0))).alias("links"))
    return members.join(linked, "rid").select("id", F.col("rid").alias("class_id"), "links")


def near_copies(df: DataFrame, ident: str, text: str, min_share: float = MIN_SHARE, min_words: int = MIN_WORDS) -> DataFrame:
    """``a < b``: all pairs of ids whose texts have ``min_words`` words each and share ``min_share`` of them.

    Order MinHash: each sketch keeps the smallest occurrence-labelled words of a text in text order; texts with an
    equal sketch are candidates, verified by banded alignment and, where parts were moved, by the words they share. Texts with the same words are one class, compared once. Texts in buckets that are too
    large are compared by their rare words instead, which misses none.

    Null ids and null, empty or short texts have no pairs. Repeated ids count once per different text. No id pairs
    with itself. An empty table gives no rows; other columns are ignored, whatever their names.
    """
    texts, members = classes_of_copies(df, ident, text, min_words)
    members = written(members, "members")
    links = similar_classes(texts, min_share).select("a", "b")
    repeated = written(members.groupBy("id").count().filter("count > 1").select("id", F.lit(True).alias("again")), "repeated")
    some = repeated.limit(1).count() > 0
    if some:  # only ids with several texts can give a pair twice
        members = members.join(repeated, "id", "left").select("rid", "id", F.coalesce("again", F.lit(False)).alias("again"))
    else:
        members = members.withColumn("again", F.lit(False))
    a, b = members.toDF("a", "ia", "aa"), members.toDF("b", "ib", "ab")
    across = links.join(a, "a").join(b, "b").select("ia", "ib", "aa", "ab")
    copies = members.groupBy("rid").count().filter("count > 1").select("rid")
    within = members.join(copies, "rid", "left_semi")
    same = within.toDF("a", "ia", "aa").join(within.toDF("a", "ib", "ab"), "a").filter("ia < ib").select("ia", "ib", "aa", "ab")
    both = across.unionByName(same).filter("ia <> ib")
    ordered = both.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"), (F.col("aa") | F.col("ab")).alias("again"))
    if not some:
        return ordered.select("a", "b")
    return ordered.filter("NOT again").select("a", "b").unionByName(ordered.filter("again").select("a", "b").distinct())


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A comment's text never differs between its deliveries, so each counts once."""
    rows = load(spark, sf_dir, "comments").select("comment_id", "cleaned_text")
    return near_copies(rows, "comment_id", "cleaned_text").toDF("comment_a", "comment_b")


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each comment of 30 words with its class of same words and the number of other comments nearly the same."""
    rows = load(spark, sf_dir, "comments").select("comment_id", "cleaned_text")
    return near_copy_classes(rows, "comment_id", "cleaned_text").toDF("comment_id", "class_id", "links")


QUERIES = {"p3_found": p3_found, "p3_groups": p3_groups}

_WORDS = """
        WITH t AS (SELECT comment_id, any_value(cleaned_text) AS text FROM comments WHERE comment_id IS NOT NULL AND cleaned_text IS NOT NULL GROUP BY comment_id),
        w AS (SELECT comment_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM t),
        n AS (SELECT comment_id, len(w) AS n, w FROM w WHERE len(w) >= 30),
        c AS (SELECT comment_id, n, word, count(*) AS c FROM (SELECT comment_id, n, unnest(w) AS word FROM n) GROUP BY ALL),
        s AS (SELECT a.comment_id AS comment_a, b.comment_id AS comment_b, any_value(a.n + b.n) AS n, sum(least(a.c, b.c)) AS s
              FROM c a JOIN c b ON a.word = b.word AND a.comment_id < b.comment_id GROUP BY ALL),
        p AS (SELECT comment_a, comment_b FROM s WHERE s >= 0.7 * (n - s))
"""
SQL = {
    "p3_found": f"{_WORDS} SELECT comment_a, comment_b FROM p",
    "p3_groups": f"""{_WORDS},
        k AS (SELECT comment_id, min(comment_id) OVER (PARTITION BY list_sort(w)) AS class_id FROM n),
        l AS (SELECT id, count(*) AS links FROM (SELECT comment_a AS id FROM p UNION ALL SELECT comment_b FROM p) GROUP BY id)
        SELECT comment_id, class_id, coalesce(links, 0)::BIGINT AS links FROM k LEFT JOIN l ON l.id = comment_id
    """,
}
