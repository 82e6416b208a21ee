"""Exact cosine top k that skips vectors: cells with a centre and a radius.

Each vector belongs to the centre at the smallest angle; a cell's radius is the largest angle of its members.
No member can be nearer to a query than the query's angle to the centre less the radius, so cells
are read in the order of that bound until the k-th hit beats the next. Centres are a sample of bounded size; cells are
sorted in the table, so that a cell is a pushed-down filter.

Vectors that aren't of the common length, or have no direction (zero, null or not finite components),
are in cells of their own, which every query reads.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import search

#: Centres, at most; vectors for each below that. A centre takes part in every vector's assignment.
CENTRES, PER_CENTRE = 512, 64
#: Cells that are read first.
FIRST = 4
#: Angles and cosines are compared with room for rounding.
ROOM = 1e-6
ODD = -1


@dataclass(frozen=True)
class Report:
    """Vectors in the table, and those that were read."""

    vectors: int
    read: int


def build(vectors: DataFrame, folder: str, id_col: str = "vec_id", vector_col: str = "embedding") -> None:
    """Writes (id, vector, cell) sorted by cell, and a row for each cell."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding"))
    size = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = F.coalesce(~size & F.exists("embedding", lambda x: x != 0), F.lit(False))
    widths = rows.filter(sound).groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), "width").first()
    width, n = (widths["width"], widths["count"]) if widths else (0, 0)
    usual = sound & (F.size("embedding") == width)
    many = min(CENTRES, max(1, n // PER_CENTRE))
    some = [r[0] for r in rows.filter(usual).orderBy(F.xxhash64("vec_id"), "vec_id").select("embedding").limit(many).collect()]
    centres = np.array(some, float).reshape(len(some), width)
    centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300)
    kind, key = rows.schema["embedding"].dataType.simpleString(), rows.schema["vec_id"].dataType.simpleString()

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = np.stack([np.asarray(v, float) for v in b["embedding"]])
                cosines = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ centres.T
                cell = cosines.argmax(1)
                yield b.assign(cell=cell.astype(np.int32), angle=np.arccos(np.clip(cosines[np.arange(len(b)), cell], -1, 1)))

    placed = rows.filter(usual).mapInPandas(place, f"vec_id {key}, embedding {kind}, cell int, angle double")
    odd = rows.filter(~usual).select("*", F.lit(ODD).alias("cell"), F.lit(0.0).alias("angle"))
    placed.unionByName(odd).repartitionByRange("cell", "vec_id").sortWithinPartitions("cell", "vec_id").write.parquet(f"{folder}/vectors")
    held = vectors.sparkSession.read.parquet(f"{folder}/vectors").groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius"))
    table = vectors.sparkSession.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "cell int, centre array<double>")
    held.join(table, "cell", "left").coalesce(1).write.parquet(f"{folder}/cells")  # CENTRES + 1 rows at most


def topk(spark: SparkSession, folder: str, query_vector: Sequence[float], k: int) -> tuple[DataFrame, Report]:
    """(doc, cosine) as ``search.cosine_topk`` gives them, and how much was read."""
    cells = spark.read.parquet(f"{folder}/cells").collect()
    vectors = spark.read.parquet(f"{folder}/vectors")
    q = np.asarray(query_vector, float)
    size = float(np.linalg.norm(q))
    bounds = []
    for c in cells:
        bound = math.inf
        if c["centre"] is not None and len(c["centre"]) == len(q) and 0 < size < math.inf:
            angle = math.acos(max(-1.0, min(1.0, float(np.dot(c["centre"], q)) / size)))
            bound = math.cos(max(0.0, angle - c["radius"] - ROOM))
        bounds.append((-bound, c["cell"], c["n"]))
    bounds.sort()

    def best(some: list) -> DataFrame:
        return search.cosine_topk(vectors.filter(F.col("cell").isin([c for _, c, _ in some])), query_vector, k)

    first = [x for i, x in enumerate(bounds) if i < FIRST or x[0] == -math.inf]
    hits = best(first)
    found = hits.collect()  # k rows
    least = found[-1]["cosine"] - ROOM if len(found) == k and k else -math.inf
    more = [x for x in bounds[len(first) :] if k and -x[0] >= least]
    read = sum(n for _, _, n in [*first, *more])
    if more:
        hits = best([*first, *more])
    return hits, Report(sum(n for _, _, n in bounds), read)
