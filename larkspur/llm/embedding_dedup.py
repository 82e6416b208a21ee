"""Near-duplicate embeddings through a pivot-permutation index.

A vector is described by its nearest reference points (pivots) in order of nearness. An inverted
list per (label, pivot) holds the vectors described by that pivot. Vectors that share at least ``shared`` of their
``nearest`` pivots are candidates, and are verified by their cosine in double precision.

A pair meets once: in the list of its smallest shared pivot. Lists with more than ``BLOCK`` members are
divided by their members' next pivot, to lists per (label, two pivots), then three: a pair goes to that of its
smallest two or three. What shares that many pivots and is still longer is met in pairs of blocks, each a
task's group of its own. The number of pivots follows the number of vectors up to ``MAX_PIVOTS``; beyond, the lists
of several pivots, of which there are far more, keep short.

Pivots are a sample's vectors that aren't near each other, measured by how far apart the sample's vectors are, so that
vectors within a narrow cone have as many as others. How many pivots describe a vector, and how many a pair must share, is
fitted on pairs made at exactly the least cosine, from the sample's vectors towards others of it.

Vectors that are equal are one class from the start, whatever their number, and what leaves a list
are sums per class and a spanning forest, not pairs.

Links need a cosine of at least 0.98, exactly; pairs the index misses are not links (measured
recall: see the README).

Defined results: a null label, or a vector that is null, zero or holds a null or non-finite
component, links with nothing; vectors of different lengths don't link; rows that repeat a vec_id
count as vectors of their own: they link when they are near, and sharing the id alone connects nothing; a vector without a vec_id links like any
other, is never the kept one, and where all that are reachable have none, component_id is null; an empty table gives an empty table; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, durable, gathered, lookup, read
from .components import components
from .embeddings import matrix, sample, usable
from .simhash import forest

COSINE = 0.98
#: (nearest, shared): pivots that describe a vector, and of them those that candidates share. The first that finds RECALL of the made pairs is taken.
CHOICES = ((8, 3), (8, 2), (12, 2), (16, 2), (16, 1), (24, 1))
RECALL = 0.98
#: Pairs that are made to choose.
MADE = 1024
#: Pivots are farther apart than this share of the sample's median distance (1 - cosine): among near ones, which is nearest is chance.
APART = 0.2
#: Vectors per pivot, and bounds of the number of pivots. Pivots are sent to every task: at most MAX_PIVOTS.
PER_PIVOT, MIN_PIVOTS, MAX_PIVOTS = 64, 64, 8192
#: Members of a list that meet in one group.
BLOCK = 2048

KEY = ("label", "g", "level", "last", "low", "high")
OUT = "u long, v long, links long"


def describe(x: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """The nearest pivots of unit vectors, nearest first."""
    k = min(nearest, len(pivots))
    sims = x @ np.pad(pivots, ((0, 0), (0, x.shape[1] - pivots.shape[1]))).T
    best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    return np.take_along_axis(best, np.argsort(-np.take_along_axis(sims, best, 1), axis=1, kind="stable"), 1)


def _describe(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, nearest: int) -> Iterator[pa.RecordBatch]:
    for b in gathered(batches, 4000):
        x = matrix(b.column("embedding"), pivots.shape[1])
        best = describe(x / np.linalg.norm(x, axis=1, keepdims=True), pivots, nearest)
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("label", "cid", "n", "embedding")), pa.array(list(best.astype(np.int32)), pa.list_(pa.int32()))], ["label", "cid", "n", "embedding", "pivots"])


def _verify(batches: Iterator[pa.RecordBatch], shared: int, cosine: float) -> Iterator[pa.RecordBatch]:
    """Links inside each group, which comes together in order."""

    def solve(t: pa.RecordBatch) -> pa.RecordBatch:
        level, last, low, high = (t.column(c)[0].as_py() for c in KEY[2:])
        cid, n, block = (t.column(c).to_numpy() for c in ("cid", "n", "block"))
        marks = np.stack([np.sort(p) for p in t.column("pivots").to_numpy(zero_copy_only=False)])
        x = matrix(t.column("embedding"))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        left = np.flatnonzero(block == low)
        right = np.flatnonzero(block == high)
        names, place = np.unique(marks, return_inverse=True)
        holds = np.zeros((len(cid), len(names)), np.float32)
        holds[np.arange(len(cid))[:, None], place.reshape(marks.shape)] = 1
        first = holds * (names <= last)  # a pair that shares others up to the last is in their list
        links = np.zeros(len(cid), np.int64)

        def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for i in range(0, len(left), 512):
                rows = left[i : i + 512]
                near = (holds[rows] @ holds[right].T >= shared) & (first[rows] @ first[right].T == level)
                if low == high:
                    near &= rows[:, None] < right[None, :]
                a, b = np.nonzero(near)
                for k in range(0, len(a), 100_000):
                    u, v = rows[a[k : k + 100_000]], right[b[k : k + 100_000]]
                    good = (x[u] * x[v]).sum(axis=1) >= cosine
                    u, v = u[good], v[good]
                    np.add.at(links, u, n[v])
                    np.add.at(links, v, n[u])
                    yield u, v

        kept = np.array(forest(pairs(), len(cid)), np.int64).reshape(-1, 2)
        some = np.flatnonzero(links)
        u = np.r_[cid[kept[:, 0]], cid[some]]
        v = np.r_[cid[kept[:, 1]], cid[some]]
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(np.r_[np.zeros(len(kept), np.int64), links[some]])], ["u", "v", "links"])

    held: list[pa.RecordBatch] = []
    last = None

    def whole() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for b in batches:
        keys = np.stack([b.column(c).to_numpy().astype(np.int64) for c in KEY], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if j > i:
                now = tuple(keys[i].tolist())
                if held and now != last:
                    if (t := whole()).num_rows > 1:
                        yield solve(t)
                    held = []
                held.append(b.slice(i, j - i))
                last = now
    if held and (t := whole()).num_rows > 1:
        yield solve(t)


def pivot_count(vectors: int) -> int:
    n = MIN_PIVOTS
    while n * PER_PIVOT < vectors and n < MAX_PIVOTS:
        n *= 2
    return n


def spread(points: np.ndarray, apart: float = APART) -> np.ndarray:
    """Of unit vectors, those that no earlier one kept is near to."""
    some = points[:512]
    far = 1 - (some @ some.T)[np.triu_indices(len(some), 1)]
    least = apart * float(np.median(far)) if len(far) else 0.0
    kept: list[int] = []
    for i in range(len(points)):
        if not kept or 1 - (points[kept] @ points[i]).max() > least:
            kept.append(i)
    return points[kept]


def choose(points: np.ndarray, pivots: np.ndarray, cosine: float, recall: float = RECALL) -> tuple[int, int]:
    """(nearest, shared) that find pairs at the least cosine: made from each point towards another."""
    x = np.resize(points, (MADE, points.shape[1])) if len(points) < MADE else points[:MADE]
    z = x[(np.arange(len(x)) * 7919 + 13) % len(x)]
    away = z - (z * x).sum(1, keepdims=True) * x
    size = np.linalg.norm(away, axis=1)
    x, away = x[size > 1e-6], (away / np.maximum(size, 1e-300)[:, None])[size > 1e-6]
    if not len(x):
        return CHOICES[0]
    y = cosine * x + np.sqrt(1 - cosine**2) * away
    for nearest, shared in CHOICES:
        a, b = describe(x, pivots, nearest), describe(y, pivots, nearest)
        common = (a[:, :, None] == b[:, None, :]).sum((1, 2))
        if (common >= min(shared, len(pivots))).mean() >= recall:
            break
    return nearest, shared


def links(classes: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """(u, v, links) over classes (label, cid, n, embedding): forest rows with links 0, and rows u = v with a class's links."""
    spark = classes.sparkSession
    many = classes.count()
    points = sample(classes, max(pivot_count(many), MADE), by=("label", "embedding")) if many else np.empty((0, 0))
    if not len(points):
        return spark.createDataFrame([], OUT)
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    pivots = spread(points[: pivot_count(many)])
    nearest, shared = choose(points, pivots, cosine)
    nearest, shared = min(nearest, len(pivots)), min(shared, len(pivots))
    kind = classes.schema["embedding"].dataType.simpleString()
    described = arrow(classes, _describe, f"label long, cid long, n long, embedding {kind}, pivots array<int>", pivots=pivots, nearest=nearest)
    described = durable(described.withColumn("pivots", F.array_sort("pivots")))
    level, rest, met = 0, described.select("*", F.lit(-1).alias("at"), F.col("label").alias("g")), []
    while rest is not None:
        level += 1
        # the place, among a vector's pivots, of the next that it may share; as many as are still to be shared must follow
        more = F.sequence(F.col("at") + 1, F.lit(nearest - shared + level - 1))
        lists = rest.filter(F.col("at") + 1 <= nearest - shared + level - 1).withColumn("at", F.explode(more)).withColumn("last", F.col("pivots")[F.col("at")])
        lists = lists.withColumn("g", F.xxhash64("g", "last"))
        sizes = lists.groupBy("label", "g", "last").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).withColumn("level", F.lit(level))
        lists = lists.join(sizes, ["label", "g", "last"])
        if level < shared and sizes.filter("blocks > 1").limit(1).count():
            rest = durable(lists.filter("blocks > 1").select("label", "cid", "n", "embedding", "pivots", "at", "g"))
            lists = lists.filter("blocks = 1")
        else:
            rest = None
        lists = lists.withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
        lists = lists.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        lists = lists.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
        met.append(lists.select(*KEY, "block", "cid", "n", "pivots", "embedding"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = reduce(DataFrame.unionByName, met).repartition(n, *KEY).sortWithinPartitions(*KEY)
    return arrow(dealt, _verify, OUT, shared=shared, cosine=cosine)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", **options) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row."""
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").alias("embedding"), F.col(f"`{label_col}`").cast("long").alias("raw"))
    good = F.coalesce(usable() & F.col("raw").isNotNull(), F.lit(False))
    # vectors of another length are another label
    rows = rows.withColumn("label", F.when(good, F.xxhash64("raw", F.size("embedding"))))
    rows = rows.withColumns({"a": F.when(good, F.xxhash64("label", "embedding")), "b": F.when(good, F.xxhash64(F.lit(7), "embedding", "label"))})
    # by the vectors themselves, with a number of their own that is fixed once it is written: an id may stand for several vectors; a and b find the class again
    classes = rows.filter("label is not null").groupBy("label", "embedding", "a", "b").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    classes = durable(classes.withColumn("cid", F.monotonically_increasing_id()))
    found = durable(links(classes.select("label", "cid", "n", "embedding"), **options))
    joined = components(found.filter("u != v"))
    more = found.filter("u = v").groupBy("u").agg(F.sum("links").alias("links")).withColumnRenamed("u", "cid")
    placed = classes.select("a", "b", "cid", "n", "least").join(more, "cid", "left").join(joined.withColumnRenamed("node", "cid"), "cid", "left")
    placed = durable(placed.select("a", "b", "least", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "cid").alias("component")))
    known = lookup(placed, placed.groupBy("component").agg(F.min("least").alias("component_id")), ["component"])
    out = lookup(rows.select("vec_id", "a", "b"), known.select("a", "b", "links", "component_id"), ["a", "b"])
    component = F.when(F.col("a").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))
