"""Problem 1: frequency of every distinct term, by recursive radix spilling."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commentarium.tables import current_comments, current_videos, load

#: Distinct terms a task combines before it hands them on.
COMBINED = 500_000
#: Rows of partial counts a task keeps in memory; beyond it splits them by hash bits into files.
IN_MEMORY_ROWS = 2_000_000
FANOUT_BITS = 4
RARE_BELOW, COMMON_SHARE = 3, 0.1


def _merged(tables: list[pa.Table]) -> pa.Table:
    t = pa.concat_tables(tables).group_by("term", use_threads=False).aggregate([("occ", "sum"), ("rec", "sum")])
    return t.rename_columns(["term", "occ", "rec"])


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Before the shuffle: lists of terms, one per record, to partial counts of each term of this task."""
    held, rows = [], 0
    for batch in batches:
        lists = batch.column(0)
        pairs = pa.table({"record": pc.list_parent_indices(lists), "term": pc.list_flatten(lists)})
        pairs = pairs.filter(pc.is_valid(pairs["term"]))
        within = pairs.group_by(["record", "term"], use_threads=False).aggregate([([], "count_all")])
        counted = within.group_by("term", use_threads=False).aggregate([("count_all", "sum"), ("count_all", "count")])
        held.append(counted.rename_columns(["term", "occ", "rec"]))
        rows += len(counted)
        if rows > COMBINED:
            held = [_merged(held)]
            rows = len(held[0])
            if rows > COMBINED // 2:
                yield from held.pop().to_batches(65_536)
                rows = 0
    if held:
        yield from _merged(held).to_batches(65_536)


def _scratch() -> str:
    """A folder for this task's own spill files, in the place Spark gives its executors for theirs."""
    local = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None
    return tempfile.mkdtemp(prefix="radix-", dir=local)


def _aggregate(source: object, scratch: str) -> Iterator[pa.RecordBatch]:
    """One partition's totals, aggregated by DuckDB, which spills into ``scratch`` when memory is short."""
    con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": scratch})
    try:
        con.register("part", source)
        done = con.sql("SELECT term, CAST(sum(occ) AS BIGINT) AS occ, CAST(sum(rec) AS BIGINT) AS rec FROM part GROUP BY term")
        yield from done.to_arrow_reader(65_536)
    finally:
        con.close()


def _radix(batches: Iterator[pa.RecordBatch], schema: pa.Schema, scratch: str, used_bits: int, most: int) -> Iterator[pa.RecordBatch]:
    """Totals of a stream of partial counts with hashes; splits it by the next hash bits into files while it is too large."""
    held, rows, paths, writers = [], 0, {}, {}
    shift = 64 - used_bits - FANOUT_BITS

    def spill(batch: pa.RecordBatch) -> None:
        bits = (batch.column(batch.schema.get_field_index("hash")).to_numpy().view(np.uint64) >> np.uint64(shift)) & np.uint64((1 << FANOUT_BITS) - 1)
        for b in np.unique(bits):
            if b not in writers:
                paths[b] = tempfile.mktemp(prefix=f"{used_bits}-{b}-", suffix=".arrow", dir=scratch)
                writers[b] = [pa.ipc.new_stream(pa.OSFile(paths[b], "wb"), schema), 0]
            part = batch.filter(pa.array(bits == b))
            writers[b][0].write_batch(part)
            writers[b][1] += part.num_rows

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows > most and shift >= 0:
            for b in held:
                spill(b)
            held = []
    if not writers:
        if held:
            yield from _aggregate(pa.Table.from_batches(held, schema), scratch)
        return
    for b in held:
        spill(b)
    for writer, _ in writers.values():
        writer.close()
    for b, (_, n) in writers.items():
        with pa.OSFile(paths[b], "rb") as f:
            reader = pa.ipc.open_stream(f)
            yield from _radix(iter(reader), schema, scratch, used_bits + FANOUT_BITS, most) if n > most else _aggregate(reader, scratch)
        os.remove(paths[b])


def _totals(used_bits: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        scratch = _scratch()
        try:

            def chained() -> Iterator[pa.RecordBatch]:
                yield first
                yield from batches

            yield from _radix(chained(), first.schema, scratch, used_bits, most)
        finally:
            shutil.rmtree(scratch, ignore_errors=True)

    return run


def term_counts(terms: DataFrame, column: str, in_memory_rows: int = IN_MEMORY_ROWS) -> DataFrame:
    """``term``, ``occurrences`` and ``records`` of every distinct term; one row of ``terms`` is one record with a list of terms.

    Each task first combines its own terms. The partial counts are shuffled by the high bits of the terms' hash
    (radix partitions); a task that gets more than it may hold splits them by the next bits into files of its own,
    again and again, and DuckDB aggregates each piece out-of-core. A term that occurs everywhere arrives once per
    task, so no term makes a partition large. Spill files live as long as their task, as Spark's own do.

    Null lists are records without terms, null terms don't count, the empty term does. Repeated rows are records
    of their own. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    bits = max(4, (int(terms.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length() + 2)
    lists = terms.select(F.coalesce(F.col(column), F.array().cast("array<string>")).alias("terms"))
    partial = lists.mapInArrow(_combine, "term string, occ long, rec long").withColumn("hash", F.xxhash64("term"))
    radix = F.shiftrightunsigned("hash", 64 - bits)
    totals = partial.repartition(radix).mapInArrow(_totals(bits, in_memory_rows), "term string, occ long, rec long")
    return totals.toDF("term", "occurrences", "records")


def marked(counts: DataFrame, records: int, rare_below: int = RARE_BELOW, common_share: float = COMMON_SHARE) -> DataFrame:
    """``mark``: 'rare' in fewer than ``rare_below`` records, else 'common' in at least ``common_share`` of all ``records``, else null."""
    common = F.col("records") >= F.lit(common_share) * F.lit(records)
    return counts.withColumn("mark", F.when(F.col("records") < rare_below, "rare").when(common, "common"))


def text_terms(column: str = "text"):
    """The longest runs of letters and numbers of a lower-cased text."""
    return F.expr(rf"regexp_extract_all(lower(`{column}`), '[\\p{{L}}\\p{{N}}]+', 0)")


def tag_terms(column: str = "tags"):
    """Lower-cased tags without U+0020 at either end; null and empty ones left out."""
    return F.filter(F.transform(F.col(column), lambda t: F.trim(F.lower(t))), lambda t: t != "")


def p1_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term of the comments' texts and the videos' tags with its counts and mark."""
    comments, videos = load(spark, sf_dir, "comments"), load(spark, sf_dir, "videos")
    n_comments = comments.agg(F.countDistinct("comment_id")).first()[0]
    n_videos = videos.agg(F.countDistinct("video_id")).first()[0]
    texts = current_comments(comments, ["text"]).select(text_terms().alias("terms"))
    tags = current_videos(videos, ["tags"]).select(tag_terms().alias("terms"))
    found = marked(term_counts(texts, "terms"), n_comments).withColumn("field_name", F.lit("text"))
    found = found.unionByName(marked(term_counts(tags, "terms"), n_videos).withColumn("field_name", F.lit("tags")))
    return found.select("field_name", "term", "occurrences", "records", "mark")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_terms(spark, sf_dir).filter(F.col("mark").isNotNull()).select("field_name", "term", "mark")


QUERIES = {"p1_found": p1_found, "p1_terms": p1_terms}

_COUNTS = """
    WITH cur AS (
        SELECT comment_id, text FROM comments WHERE comment_id IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY comment_id ORDER BY ordinal DESC) = 1),
    vid AS (
        SELECT video_id, tags FROM videos WHERE video_id IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY fetched_at DESC NULLS LAST, view_count DESC NULLS LAST) = 1),
    t AS (
        SELECT 'text' AS field_name, comment_id AS record, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM cur
        UNION ALL
        SELECT 'tags', video_id, trim(lower(tag), ' ') FROM (SELECT video_id, unnest(tags) AS tag FROM vid)),
    n AS (SELECT (SELECT count(*) FROM cur) AS text, (SELECT count(*) FROM vid) AS tags),
    c AS (
        SELECT field_name, term, count(*) AS occurrences, count(DISTINCT record) AS records
        FROM t WHERE term <> '' GROUP BY ALL),
    m AS (
        SELECT c.*, CASE WHEN records < 3 THEN 'rare'
                         WHEN records >= 0.1 * CASE field_name WHEN 'text' THEN n.text ELSE n.tags END THEN 'common' END AS mark
        FROM c, n)
"""

SQL = {
    "p1_terms": _COUNTS + "SELECT field_name, term, occurrences, records, mark FROM m",
    "p1_found": _COUNTS + "SELECT field_name, term, mark FROM m WHERE mark IS NOT NULL",
}
