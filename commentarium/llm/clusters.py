"""Problem 2: clusters of similar records, by neighbour descent and modularity-based community detection."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from commentarium.session import written
from commentarium.tables import distinct_fans, load

#: Neighbours of a record, all of which it is linked to, and reverse neighbours that take part in a local join.
NEIGHBOURS, REVERSE = 10, 10
#: Pairs that a local join holds at a time, so that a task's memory doesn't follow the size of its batches.
PAIRS = 100_000
#: Descent ends when a round changes less than this share of all neighbours.
CHANGED = 0.01
#: Starting neighbours come from windows of so many records along space-filling curves with so many shifts.
WINDOW, CURVES = 512, 2
#: Edges longer than this many times the median distance to the last neighbour join nothing.
LONGEST_EDGE = 8.0
#: A cluster's records lie about as close as all do, and are more than one record's neighbours; others are stray records.
LOOSEST = 4.5
TYPICAL = 5
BITS = 14


def standardised(df: DataFrame, features: list[str], counts: list[str], ident: str) -> DataFrame:
    """``id`` and ``v``: features with mean 0 and deviation 1 over all records; nulls count as 0.

    Counts are spread evenly over the unit around them (by a hash of the id, so always alike) before their logarithm
    is taken; else records with equal small counts would lie in layers that have no neighbours in each other.
    """
    exprs = []
    for f in features:
        x = F.coalesce(F.col(f).cast("double"), F.lit(0.0))
        if f in counts:
            spread = F.pmod(F.xxhash64(F.col(ident), F.lit(f)), F.lit(1_000_003)) / 1_000_003.0 - 0.5
            x = F.log1p(F.greatest(x, F.lit(0.0)) + spread)
        exprs.append(x.alias(f"f_{f}"))
    raw = df.select(F.col(ident).alias("id"), *exprs)
    cols = [f"f_{f}" for f in features]
    stats = raw.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
    scaled = [(F.col(c) - F.lit(stats[f"m_{c}"] or 0.0)) / F.lit(stats[f"s_{c}"] or 1.0) for c in cols]
    return raw.select("id", F.array(*scaled).alias("v"))


def _matrix(lists: pa.ListArray) -> np.ndarray:
    n = len(lists)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1) if n else np.zeros((0, 1))


def _curve(shift: int):
    """Positions along a space-filling curve (interleaved bits) whose grid is shifted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _matrix(b.column(1))
            bits = min(BITS, 62 // max(1, v.shape[1]))
            cells = np.clip((v + 8 + 0.37 * shift) / 17, 0, 1 - 1e-9)
            cells = (cells * (1 << bits)).astype(np.int64)
            code = np.zeros(len(v), dtype=np.int64)
            for bit in range(bits - 1, -1, -1):
                for k in range(v.shape[1]):
                    code = (code << 1) | ((cells[:, k] >> bit) & 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(code)], names=["id", "v", "code"])

    return run


def _nearest_in_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From records in the order of a curve: each one's nearest within a window around it. Holds one window."""
    half, quarter = WINDOW // 2, WINDOW // 4
    ids, vectors, lead = pa.array([], pa.string()), None, 0

    def emit(block: pa.Array, v: np.ndarray, begin: int, end: int) -> pa.RecordBatch:
        k = min(NEIGHBOURS, len(v) - 1)
        d = ((v[begin:end, None, :] - v[None, :, :]) ** 2).sum(axis=2)
        d[np.arange(end - begin), np.arange(begin, end)] = np.inf
        at = np.argpartition(d, k - 1, axis=1)[:, :k]
        return pa.RecordBatch.from_arrays(
            [block.take(pa.array(np.repeat(np.arange(begin, end), k))), block.take(pa.array(at.ravel())), pa.array(np.sqrt(np.take_along_axis(d, at, axis=1)).ravel())],
            names=["id", "nid", "d"],
        )

    for b in batches:
        ids = pa.concat_arrays([ids, b.column(0)])
        vectors = _matrix(b.column(1)) if vectors is None else np.concatenate([vectors, _matrix(b.column(1))])
        while len(ids) >= WINDOW:
            yield emit(ids.slice(0, WINDOW), vectors[:WINDOW], lead, half + quarter)
            ids, vectors, lead = ids.slice(half), vectors[half:], quarter
    if vectors is not None and len(ids) > 1 and lead < len(ids):
        yield emit(ids, vectors, lead, len(ids))


def _best(pairs: DataFrame) -> DataFrame:
    """``id, nbrs``: the nearest ``NEIGHBOURS`` of each id, of equal distances the smaller id."""
    met = F.slice(F.array_sort(F.collect_set(F.struct("d", "nid"))), 1, NEIGHBOURS)
    return pairs.groupBy("id").agg(met.alias("nbrs"))


def _local_join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Among the neighbours and reverse neighbours of one record, pairs nearer than what one of them knows.

    Holds a batch and at most ``PAIRS`` pairs of it (or those of one record, if they are more).
    """
    for b in batches:
        lists = b.column(0)
        offsets = lists.offsets.to_numpy()
        offsets = offsets - offsets[0]
        flat = lists.flatten()
        ids, v, radius = flat.field("m"), _matrix(flat.field("v")), flat.field("r").to_numpy(zero_copy_only=False)
        sizes = np.diff(offsets)
        for size in np.unique(sizes[sizes > 1]):
            i, j = np.triu_indices(size, 1)
            starts, most = offsets[:-1][sizes == size], max(1, PAIRS // len(i))
            for begin in range(0, len(starts), most):
                at = starts[begin : begin + most, None] + np.arange(size)
                a, c = at[:, i].ravel(), at[:, j].ravel()
                d = np.sqrt(((v[a] - v[c]) ** 2).sum(axis=1))
                near, back = d < radius[a], d < radius[c]
                left, right = np.concatenate([a[near], c[back]]), np.concatenate([c[near], a[back]])
                if len(left):
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(left)), ids.take(pa.array(right)), pa.array(np.concatenate([d[near], d[back]]))], names=["id", "nid", "d"]
                    )


def neighbour_graph(points: DataFrame, changed: float = CHANGED) -> DataFrame:
    """``id, nid, d``: approximate nearest neighbours of every record by neighbour descent.

    Starting neighbours come from windows along shifted space-filling curves. In each round every record introduces
    its neighbours and reverse neighbours to each other; pairs nearer than those known take their place, until a round
    changes less than ``changed`` of all neighbours. Lists are bounded by the number of neighbours, whatever the data.
    """
    schema = "id string, nid string, d double"
    starts = None
    for shift in range(CURVES):
        coded = points.mapInArrow(_curve(shift), "id string, v array<double>, code long")
        met = coded.repartitionByRange("code").sortWithinPartitions("code", "id").mapInArrow(_nearest_in_windows, schema)
        starts = met if starts is None else starts.unionByName(met)
    known = written(_best(starts), "knn")
    while True:
        radius = F.when(F.size("nbrs") < NEIGHBOURS, F.lit(float("inf"))).otherwise(F.element_at("nbrs", -1)["d"])
        places = known.select("id", radius.alias("r")).join(points, "id")
        edges = known.select("id", F.explode("nbrs").alias("n")).select("id", "n.nid", "n.d")
        nearest = Window.partitionBy("nid").orderBy("d", "id")
        back = edges.withColumn("k", F.row_number().over(nearest)).filter(F.col("k") <= REVERSE).select(F.col("nid").alias("p"), F.col("id").alias("m"))
        members = edges.select(F.col("id").alias("p"), F.col("nid").alias("m")).unionByName(back).distinct()
        met = members.join(places.withColumnRenamed("id", "m"), "m").groupBy("p").agg(F.collect_list(F.struct("m", "v", "r")).alias("ms"))
        found = met.select("ms").mapInArrow(_local_join, schema)
        before = known.select("id", F.col("nbrs.nid").alias("was"))
        known = written(_best(edges.unionByName(found.filter("id <> nid"))).join(before, "id", "left"), "knn")
        rate = known.agg(F.sum(F.size(F.array_except("nbrs.nid", F.coalesce("was", F.array().cast("array<string>"))))) / F.sum(F.size("nbrs"))).first()[0]
        if rate is None or rate < changed:
            return known.select("id", F.explode("nbrs").alias("n")).select("id", "n.nid", "n.d")


def _merged_once(graph: DataFrame) -> DataFrame:
    """``id, to, k`` of vertices that join another community, and of that one: its label and its degree.

    Joining ``a`` and ``b`` raises modularity at every resolution below ``w * 2m / (ka * kb)``. Each vertex looks for
    the neighbour with the highest such resolution; two that choose each other join if it is above 1, and so do those
    that chose one of the two. Ties are settled by a hash of the pair, so that some two always choose each other.
    """
    pair = F.xxhash64(F.least("a", "b"), F.greatest("a", "b"))
    choice = graph.filter("a <> b AND r > 1").groupBy("a").agg(F.max(F.struct("r", pair.alias("pair"), F.col("b"))).alias("best"), F.first("ka").alias("ka"))
    choice = choice.select(F.col("a").alias("id"), F.col("best.b").alias("choice"), F.col("ka").alias("k"))
    other = choice.select(F.col("id").alias("choice"), F.col("choice").alias("back"))
    looked = choice.join(other, "choice").withColumn("mutual", F.col("id") == F.col("back"))
    pairs = looked.filter("mutual").select("id", F.least("id", "choice").alias("to"), "k")
    followers = looked.filter("NOT mutual").join(pairs.select(F.col("id").alias("choice"), "to"), "choice").select("id", "to", "k")
    members = pairs.unionByName(followers)
    return members.join(members.groupBy("to").agg(F.sum("k").alias("kt")), "to").select("id", "to", F.col("kt").alias("k"))


def _by_resolution(total: float):
    """The rest of the hierarchy over the communities that modularity leaves at resolution 1, and the cut through it.

    Two communities at a time join, those with the highest resolution at which that still gains. The cut lies in the
    widest range (on a logarithmic scale) of resolutions over which nothing joins.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links: dict[str, dict[str, float]] = {}
        degree: dict[str, float] = {}
        for batch in batches:
            for a, b, w, ka in zip(*(batch.column(k).to_pylist() for k in range(4))):
                degree[a] = ka
                own = links.setdefault(a, {})
                if a != b:
                    own[b] = w
        at = {x: 1.0 for x in links}  # when a community came to be; resolutions never rise along the hierarchy
        heap = [(-w * total / (degree[a] * degree[b]), a, b) for a, n in links.items() for b, w in n.items() if a < b]
        heapq.heapify(heap)
        joins: list[tuple[float, str, str]] = []
        parent: dict[str, str] = {}
        while heap:
            r, a, b = heapq.heappop(heap)
            if a not in links or b not in links or -links[a].get(b, 0.0) * total / (degree[a] * degree[b]) != r:
                continue
            at[a] = min(at[a], at[b], -r)
            joins.append((at[a], a, b))
            degree[a] += degree.pop(b)
            for x, w in links.pop(b).items():
                del links[x][b]
                if x != a:
                    links[a][x] = links[x][a] = links[a].get(x, 0.0) + w
            for x, w in links[a].items():
                heapq.heappush(heap, (-w * total / (degree[a] * degree[x]), *sorted((a, x))))
        steps = [1.0, *sorted((r for r, _, _ in joins), reverse=True), 2.0 / total]
        widest = max(range(len(steps) - 1), key=lambda k: (np.log(steps[k] / steps[k + 1]), k)) if joins else 0
        for r, a, b in joins:
            if r >= steps[widest]:
                parent[b] = a

        def root(x: str) -> str:
            while x in parent:
                x = parent[x]
            return x

        ids = sorted({x for _, a, b in joins for x in (a, b)} | set(links))
        yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.string()), "c": pa.array([root(x) for x in ids], pa.string())})

    return run


def communities(edges: DataFrame) -> DataFrame:
    """``id, community`` of all vertices of a weighted graph ``a, b, w`` (both directions), by modularity.

    Communities grow by joins of tables, whatever the size of the graph, until at resolution 1 no two neighbours raise
    modularity by joining. As many as are left then depends on the resolution limit (about the square root of the
    number of edges, at most), so one task takes them further: it chooses the resolution at which the division is
    most stable. Every round joins the two neighbours with the highest resolution at least, so the rounds end.
    """
    degree = edges.groupBy("a").agg(F.sum("w").alias("k"))
    total = degree.agg(F.sum("k")).first()[0] or 1.0
    raised = (F.col("w") * F.lit(total) / (F.col("ka") * F.col("kb"))).alias("r")
    weighed = edges.join(degree.toDF("a", "ka"), "a").join(degree.toDF("b", "kb"), "b")
    graph = written(weighed.select("a", "b", "w", "ka", "kb", raised), "edges")
    label = None
    while True:
        joined = written(_merged_once(graph), "joined")
        if joined.limit(1).count() == 0:
            break
        if label is None:
            label = edges.select(F.col("a").alias("id"), F.col("a").alias("c")).distinct()
        label = written(label.join(joined.select(F.col("id").alias("c"), "to"), "c", "left").select("id", F.coalesce("to", "c").alias("c")), "label")
        ends = graph.join(joined.toDF("a", "ta", "na"), "a", "left").join(joined.toDF("b", "tb", "nb"), "b", "left")
        a, b = F.coalesce("ta", "a").alias("a"), F.coalesce("tb", "b").alias("b")
        sums = ends.groupBy(a, b).agg(F.sum("w").alias("w"), F.max(F.coalesce("na", "ka")).alias("ka"), F.max(F.coalesce("nb", "kb")).alias("kb"))
        graph = written(sums.select("a", "b", "w", "ka", "kb", raised), "edges")
    if label is None:
        label = edges.select(F.col("a").alias("id"), F.col("a").alias("c")).distinct()
    merged = graph.select("a", "b", "w", "ka").coalesce(1).mapInArrow(_by_resolution(total), "c string, community string")
    return label.join(merged, "c").select("id", "community")


def similarity_clusters(df: DataFrame, ident: str, features: list[str], counts: list[str]) -> DataFrame:
    """``id, leader_id, degree`` of every record that belongs to a cluster; ``degree`` is its weight inside the cluster.

    Records are linked to their approximate nearest neighbours, long links left out, and divided by modularity.
    Communities with no more records than one has neighbours, or with scattered ones, are no clusters. ``leader_id`` is the smallest id of the cluster.

    Null ids are left out and repeated ids count once; null features count as 0; equal records lie together. Tables
    with fewer records than a cluster needs, and the empty table, give no rows; other columns are ignored.
    """
    rows = df.filter(F.col(ident).isNotNull()).dropDuplicates([ident])
    points = written(standardised(rows, features, counts, ident), "points")
    knn = neighbour_graph(points)
    reach = written(knn.groupBy("id").agg(F.max("d").alias("r")), "reach")
    usual = reach.agg(F.percentile_approx("r", 0.5, 10_000)).first()[0]
    if usual is None:
        return points.select("id", F.col("id").alias("leader_id"), F.lit(0.0).alias("degree")).limit(0)
    short = knn.filter(F.col("d") <= LONGEST_EDGE * usual)
    both = short.select(F.col("id").alias("a"), F.col("nid").alias("b")).unionByName(short.select(F.col("nid").alias("a"), F.col("id").alias("b")))
    graph = written(both.groupBy("a", "b").agg(F.count("*").cast("double").alias("w")), "graph")
    label = written(communities(graph), "communities")
    found = label.join(reach, "id").groupBy("community").agg(
        F.count("*").alias("size"), F.percentile_approx("r", 0.5, 1000).alias("r"), F.min("id").alias("leader_id")
    )
    dense = found.filter((F.col("size") > NEIGHBOURS) & (F.col("r") <= LOOSEST * usual)).select("community", "leader_id")
    members = label.join(F.broadcast(dense) if dense.count() < 100_000 else dense, "community").select("id", "leader_id")
    a, b = members.toDF("a", "leader_id"), members.toDF("b", "other")
    degree = graph.join(a, "a").join(b, "b").filter("leader_id = other").groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("degree"))
    return members.join(degree, "id", "left").select("id", "leader_id", F.coalesce("degree", F.lit(0.0)).alias("degree"))


def described(clusters: DataFrame, typical: int = TYPICAL) -> DataFrame:
    """``leader_id, size, typical``: each cluster's size and its members of highest internal weighted degree, best first."""
    order = Window.partitionBy("leader_id").orderBy(F.desc("degree"), "id")
    best = clusters.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= typical)
    tops = best.groupBy("leader_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "id"))), lambda x: x["id"]).alias("typical"))
    return clusters.groupBy("leader_id").agg(F.count("*").alias("size")).join(tops, "leader_id")


FEATURES, COUNTS = ["comment_count", "likes_earned", "avg_sentiment", "recency"], ["comment_count", "likes_earned"]


def _fan_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_clusters(distinct_fans(load(spark, sf_dir, "fans")), "author_channel_id", FEATURES, COUNTS)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fan_clusters(spark, sf_dir).select(F.col("id").alias("author_channel_id"), "leader_id")


def p2_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cluster of fans with its size and most typical fans."""
    return described(written(_fan_clusters(spark, sf_dir), "clusters"))


QUERIES = {"p2_found": p2_found, "p2_clusters": p2_clusters}
SQL: dict[str, str] = {}
