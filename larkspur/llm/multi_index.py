"""Approximate nearest neighbours by an inverted multi-index.

A vector's two halves are quantised separately, each to one of ``centres`` centroids fitted on a
bounded sample; a pair of centroids is a cell, and an inverted list per cell holds its vectors. A
query walks through cells by the summed distance of its halves to their centroids, with a heap (the
next cell is always one step along either half from a cell already taken), until the lists hold
enough vectors, and ranks those by their exact inner product.

Lists are stored in shards of about ``SHARD`` vectors: cells in the order of their centroids fill one shard after
the other, and a cell larger than a shard is divided over several by a hash. A query goes only to the shards
that hold cells it takes, and each shard returns the best it has. How many vectors a query takes is a share of
all, fitted on the sample so that the sample's own neighbours are found with ``RECALL``; the number of centroids follows
the number of vectors. What is sent is thus (queries) x (shards that their cells are in): few where vectors
cluster, up to all where they point everywhere alike.

Defined results: vectors that are null, zero, or with a null or non-finite component take no part, neither do null ids;
a shorter vector is as if filled up with zeros; rows that repeat a vec_id are queries and candidates of their own, each with its own
rank 1, 2, ...; ties go to the smaller vec_id; fewer candidates than asked for are all returned; products are in double
precision of the column's own values; an empty table gives an empty table; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow, drop, durable, gathered, read
from .embeddings import matrix, sample, usable
from .repeats import mix

NEAREST = 20
#: Centroids of a half: as many as give cells of about 64 vectors, within these bounds.
FEWEST, MOST = 16, 256
#: Vectors, at most, that centroids and the share are fitted on.
SAMPLE = 8192
#: Queries of the sample that the share is fitted on.
ASKED = 256
RECALL = 0.97
SHARD = 4096

FOUND = "query long, query_id long, vec_id long, score double"


def centroids(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """k-means from evenly spaced rows; empty centroids stay where they are."""
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        at = ((c**2).sum(1) - 2 * x @ c.T).argmin(1)
        n = np.bincount(at, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


class Cells:
    """The quantiser of both halves, and how many vectors each cell holds."""

    def __init__(self, left: np.ndarray, right: np.ndarray, counts: np.ndarray | None = None) -> None:
        self.left, self.right, self.counts = left, right, counts

    def far(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of the halves to their centroids."""
        half = self.left.shape[1]
        a, b = x[:, :half], x[:, half:]
        return tuple((y**2).sum(1)[:, None] + (c**2).sum(1) - 2 * y @ c.T for y, c in ((a, self.left), (b, self.right)))

    def of(self, x: np.ndarray) -> np.ndarray:
        a, b = self.far(x)
        return a.argmin(1) * len(self.right) + b.argmin(1)

    def walk(self, a: np.ndarray, b: np.ndarray, enough: int) -> list[int]:
        """Cells by summed distance until they hold ``enough`` vectors: the multi-sequence traversal."""
        left, right = np.argsort(a, kind="stable").tolist(), np.argsort(b, kind="stable").tolist()
        da, db = np.sort(a).tolist(), np.sort(b).tolist()
        counts, width = self.counts, len(right)
        taken = [0] * len(left)  # how many cells of each row are taken: always a staircase
        heap = [(da[0] + db[0], 0, 0)]
        out, held = [], 0
        while heap and held < enough:
            _, i, j = heapq.heappop(heap)
            cell = left[i] * width + right[j]
            taken[i] = j + 1
            if counts[cell]:
                out.append(cell)
                held += counts[cell]
            if j + 1 < width and (i == 0 or taken[i - 1] > j + 1):
                heapq.heappush(heap, (da[i] + db[j + 1], i, j + 1))
            if i + 1 < len(left) and taken[i + 1] == j:
                heapq.heappush(heap, (da[i + 1] + db[j], i + 1, j))
        return out


def centre_count(vectors: int) -> int:
    k = FEWEST
    while k * k * 64 < vectors and k < MOST:
        k *= 2
    return k


def fit(x: np.ndarray, centres: int, recall: float = RECALL, nearest: int = NEAREST) -> tuple[Cells, float]:
    """Centroids, and the share of vectors to take so that the sample's nearest are found with ``recall``."""
    half = max(1, x.shape[1] // 2)
    cells = Cells(*(inorder(centroids(y, min(centres, max(1, len(x) // 8)))) for y in (x[:, :half], x[:, half:])))
    asked = np.arange(0, len(x), max(1, len(x) // ASKED))[:ASKED]
    a, b = cells.far(x[asked])
    at = cells.of(x)
    far = a[:, at // len(cells.right)] + b[:, at % len(cells.right)]
    # the vectors of a cell are taken together: as many as are in cells not farther than the one sought
    sorted_far = np.sort(far, axis=1)
    score = x[asked] @ x.T
    score[np.arange(len(asked)), asked] = -np.inf  # a vector isn't its own neighbour
    k = min(nearest, max(len(x) - 1, 1))
    best = np.argpartition(-score, k - 1, axis=1)[:, :k]
    need = np.concatenate([np.searchsorted(s, f[b], side="right") for s, f, b in zip(sorted_far, far, best, strict=True)])
    return cells, float(min(1.0, (np.quantile(need, recall) + 1) / len(x)))


def inorder(c: np.ndarray) -> np.ndarray:
    """Centroids along their main direction, so that neighbours in number are neighbours in space."""
    if len(c) < 3 or not c.shape[1]:
        return c
    centred = c - c.mean(0)
    return c[np.argsort(centred @ np.linalg.svd(centred, full_matrices=False)[2][0], kind="stable")]


def shards_of(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each cell its first shard and how many it is divided over; shards hold about ``size``, and at most twice that."""
    first, many = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64)
    shard = held = 0
    for cell, n in enumerate(counts.tolist()):
        if n > size:  # shards of its own
            shard += held > 0
            first[cell], many[cell] = shard, -(-n // size)
            shard, held = shard + int(many[cell]), 0
            continue
        if held + n > 2 * size or held >= size:
            shard, held = shard + 1, 0
        first[cell] = shard
        held += n
    return first, many


def _cells(batches: Iterator[pa.RecordBatch], left: np.ndarray, right: np.ndarray, width: int) -> Iterator[pa.RecordBatch]:
    cells = Cells(left, right)
    for b in gathered(batches, 4000):
        yield b.append_column("cell", pa.array(cells.of(matrix(b.column("embedding"), width)).astype(np.int32)))


def _stored(batches: Iterator[pa.RecordBatch], first: np.ndarray, many: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each vector with its shard; rows are numbered, so the remainder of their number divides a large cell evenly."""
    for b in batches:
        if b.num_rows:
            cell, row = b.column("cell").to_numpy(), b.column("row").to_numpy()
            yield b.append_column("shard", pa.array(first[cell] + mix(row.view(np.uint64)).astype(np.int64) % many[cell]))


def _walks(batches: Iterator[pa.RecordBatch], left: np.ndarray, right: np.ndarray, counts: np.ndarray, first: np.ndarray, many: np.ndarray, width: int, enough: int) -> Iterator[pa.RecordBatch]:
    """Each query with its cells as a bit for each, and the shards that hold some of them."""
    cells = Cells(left, right, counts.tolist())
    for b in batches:
        if b.num_rows:
            a, c = cells.far(matrix(b.column("embedding"), width))
            bits, shards = [], []
            for x, y in zip(a, c, strict=True):
                taken = np.array(cells.walk(x, y, enough), np.int64)
                flags = np.zeros(len(counts), bool)
                flags[taken] = True
                bits.append(np.packbits(flags).tobytes())
                n = many[taken]
                shards.append(np.unique(np.repeat(first[taken] - (np.cumsum(n) - n), n) + np.arange(n.sum())))
            yield b.append_column("cells", pa.array(bits, pa.binary())).append_column("shards", pa.array(shards, pa.list_(pa.int64())))


def _search(batches: Iterator[pa.RecordBatch], nearest: int, width: int) -> Iterator[pa.RecordBatch]:
    """A shard's vectors come first, then the queries; a partition may hold several shards."""
    shard, held, lists = None, [], None
    for b in batches:
        keys = b.column("shard").to_numpy() * 2 + b.column("asks").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if j == i:
                continue
            part, now, asks = b.slice(i, j - i), int(keys[i]) // 2, int(keys[i]) % 2
            if now != shard:
                shard, held, lists = now, [], None
            if not asks:
                held.append(part)
                continue
            if lists is None:
                if not held:
                    continue
                t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                order = np.lexsort((t.column("vec_id").to_numpy(), t.column("cell").to_numpy()))
                lists = *(t.column(c).to_numpy()[order] for c in ("row", "vec_id", "cell")), matrix(t.column("embedding"), width)[order]
            rows, ids, cell, x = lists
            asked = matrix(part.column("embedding"), width)
            found = []
            for q, i_, y, bits in zip(part.column("row").to_pylist(), part.column("vec_id").to_pylist(), asked, part.column("cells").to_pylist(), strict=True):
                taken = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8))[cell] & (rows != q))
                if not len(taken):
                    continue
                rough = x[taken] @ y
                if len(taken) > nearest:  # within rounding of the last place all stay, and are scored again
                    taken = taken[rough >= np.partition(rough, -nearest)[-nearest] - 1e-9 * (1 + np.abs(rough).max())]
                score = (x[taken] * y).sum(axis=1)
                best = np.lexsort((ids[taken], -score))[:nearest]
                found.append((np.full(len(best), q), np.full(len(best), i_), ids[taken][best], score[best]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["query", "query_id", "vec_id", "score"])


def search(vectors: DataFrame, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", nearest: int = NEAREST, share: float | None = None, shard: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every``, the nearest other rows found."""
    spark = vectors.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").alias("embedding")).filter(F.col("vec_id").isNotNull() & usable())
    rows = durable(rows.select(F.monotonically_increasing_id().alias("row"), "*"))  # numbers are stored, so they stay
    kind = rows.schema["embedding"].dataType.simpleString()
    total, width = rows.agg(F.count("*"), F.max(F.size("embedding"))).first()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    x = sample(rows, SAMPLE, by=("vec_id", "embedding"), width=width)
    cells, fitted = fit(x, centre_count(total), nearest=nearest)
    halves = {"left": cells.left, "right": cells.right}
    listed = durable(arrow(rows, _cells, f"row long, vec_id long, embedding {kind}, cell int", width=width, **halves))
    drop(rows)
    counts = np.zeros(len(cells.left) * len(cells.right), np.int64)
    for cell, many in listed.groupBy("cell").count().collect():  # as many rows as there are cells
        counts[cell] = many
    first, blocks = shards_of(counts, shard)
    shards = int((first + blocks).max())
    enough = max(4 * nearest, int((share or fitted) * total) + 1)
    places = {"first": first, "many": blocks}
    asked = listed.filter(F.col("vec_id") % every == 0).select("row", "vec_id", "embedding").repartition(n)
    asked = arrow(asked, _walks, f"row long, vec_id long, embedding {kind}, cells binary, shards array<long>", counts=counts, width=width, enough=enough, **halves, **places)
    stored = arrow(listed, _stored, f"row long, vec_id long, embedding {kind}, cell int, shard long", **places).select("shard", F.lit(False).alias("asks"), "row", "vec_id", "embedding", "cell", F.lit(None).cast("binary").alias("cells"))
    sent = asked.select(F.explode("shards").alias("shard"), F.lit(True).alias("asks"), "row", "vec_id", "embedding", F.lit(0).alias("cell"), "cells")
    met = stored.unionByName(sent).repartition(max(shards, n), "shard").sortWithinPartitions("shard", "asks")
    found = arrow(met, _search, FOUND, nearest=nearest, width=width)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def op10_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "embeddings"))
