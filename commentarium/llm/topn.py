"""Problem 5: the N highest-scoring items of every group, by secondary sort."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commentarium.tables import load


def _heads(keys: list[str], n: int):
    """A task that streams sorted Arrow batches and lets the first ``n`` rows of each run of equal keys through.

    It holds one batch and the last key with its count, never a group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            change = np.zeros(batch.num_rows, dtype=bool)
            change[0] = True
            columns = [batch.column(k) for k in keys]
            for c in columns:
                change[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(change)
            at = np.arange(batch.num_rows) - np.repeat(starts, np.diff(np.append(starts, batch.num_rows)))
            first = tuple(c[0].as_py() for c in columns)
            if first == last:
                end = starts[1] if len(starts) > 1 else batch.num_rows
                at[:end] += seen
            last = tuple(c[-1].as_py() for c in columns)
            seen = int(at[-1]) + 1
            yield batch.filter(pa.array(at < n))

    return run


def top_n_per_group(df: DataFrame, group: str, score: str, ident: str, n: int) -> DataFrame:
    """The ``n`` rows of each ``group`` with the highest ``score``; of equal scores the smaller ``ident`` first.

    Every task first sorts the rows it has by group, score and identifier, and streams them in Arrow batches that let
    ``n`` rows a group through. Only these are hash-partitioned by the group, sorted within partitions and streamed
    the same way. So a group of any size is cut down where its rows lie, and none is ever buffered.

    Null groups belong to no group and null scores never count: such rows don't come out. A null identifier sorts
    after all others. Repeated rows are rows of their own. NaN scores sort highest, as in Spark. An empty table
    gives no rows. All columns of ``df`` come out, whatever their names.
    """
    if n <= 0:
        return df.limit(0)
    names = df.columns
    inner = df.toDF(*[f"c{i}" for i in range(len(names))])
    g, s, i = (f"c{names.index(x)}" for x in (group, score, ident))
    rows = inner.filter(F.col(g).isNotNull() & F.col(s).isNotNull())
    order = [F.col(s).desc(), F.col(i).asc_nulls_last()]
    first = rows.sortWithinPartitions(g, *order).mapInArrow(_heads([g], n), rows.schema)
    second = first.repartition(g).sortWithinPartitions(g, *order).mapInArrow(_heads([g], n), rows.schema)
    return second.toDF(*names)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five current comments of each video with the most likes."""
    comments = load(spark, sf_dir, "comments").filter(F.col("comment_id").isNotNull())
    current = comments.groupBy("comment_id").agg(F.max(F.struct("ordinal", "video_id", "like_count")).alias("row"))
    rows = current.select("row.video_id", "comment_id", "row.like_count")
    return top_n_per_group(rows, "video_id", "like_count", "comment_id", 5).select("video_id", "comment_id")


QUERIES = {"p5_found": p5_found}

SQL = {
    "p5_found": """
        WITH cur AS (
            SELECT * FROM comments WHERE comment_id IS NOT NULL
            QUALIFY row_number() OVER (PARTITION BY comment_id ORDER BY ordinal DESC) = 1),
        ranked AS (
            SELECT video_id, comment_id,
                   row_number() OVER (PARTITION BY video_id ORDER BY like_count DESC, comment_id ASC) AS rk
            FROM cur WHERE video_id IS NOT NULL AND like_count IS NOT NULL)
        SELECT video_id, comment_id FROM ranked WHERE rk <= 5
    """,
}
