"""Quality classifier with hierarchical empirical Bayes.

A logistic model over text statistics, fitted on at most ``TRAIN`` labelled documents, gives each
document's evidence (log-odds without the training prior). Where documents come from is evidence
too: each host's and each path's share of good documents is estimated from all its documents by
grouped aggregation, and shrunk, a path's towards its host's and a host's towards the corpus', by
as much as the spread between groups warrants (method of moments): sparse sites fall back on the
prior, and large ones speak for themselves. A document's own share is left out of its groups, so that its evidence
counts once. The posterior adds that evidence to its path's prior; a document is kept if it is good more likely than not.

Defined results: a null or empty text has the statistics of no words and is judged like any other; a text of any length is
read whole, in time that grows with it; null hosts and paths are groups of their own; rows that repeat a doc_id are each judged, and
``keep_good`` drops a doc_id if one of its rows is rejected; a doc_id labelled twice is good if one of its labels says so, and
rows that share a labelled doc_id all count; a posterior of exactly one half is kept; without labelled documents of both
kinds there is no evidence, and all documents are kept; an empty table gives an empty table; other
columns are not read, and kept, whatever their names, by ``keep_good``.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, durable, fresh, lookup, read

#: Labelled rows, at most, that the model is fitted on: those with the smallest hashes of doc_id.
TRAIN = 20_000
#: Weight of the penalty on the model's coefficients.
RIDGE = 1.0
#: Bounds of a group's strength of prior, in documents.
STRENGTH = (1.0, 1e6)

_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_MARKS = b"!|%$*#&@^~<>{}[]\\=_+/"
_PLAIN_MARKS = b".,;:?'\"-()"


def statistics(text: str) -> list[float]:
    """Statistics of a whole text, each bounded or logarithmic."""
    data = text.encode()
    words = data.split()
    n, w = max(len(data), 1), max(len(words), 1)
    marks = len(data) - len(data.translate(None, _MARKS))
    lines = data.split(b"\n")
    heavy = sum(5 * (len(x) - len(x.translate(None, _MARKS))) > len(x.split()) for x in lines if x)
    equal = sum(map(operator.eq, words, words[1:]))
    return [
        np.log1p(len(words)),
        np.log1p(marks / w),
        np.log1p(data.count(b"!") / w),
        np.log1p(data.count(b"|") / w),
        (len(data) - len(data.translate(None, _UPPER))) / n,
        (len(data) - len(data.translate(None, _DIGITS))) / n,
        (len(data) - len(data.translate(None, _PLAIN_MARKS))) / n,
        equal / w,
        float(equal > 4),
        len(set(words)) / w,
        np.log1p(len(data) / w),
        heavy / max(len(lines), 1),
        float(heavy > 0),
    ]


class Model(NamedTuple):
    """Logistic regression over standardised statistics; ``prior`` is the training rows' log-odds."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float


def evidence(model: tuple, x: np.ndarray) -> np.ndarray:
    mean, scale, weights, bias, prior = model
    return np.clip(np.clip((x - mean) / scale, -8, 8) @ weights + bias - prior, -30, 30)


def fit(x: np.ndarray, good: np.ndarray, ridge: float = RIDGE) -> Model | None:
    """Newton's method; None without rows of both kinds."""
    if len(good) == 0 or good.all() or not good.any():
        return None
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.c_[np.clip((x - mean) / scale, -8, 8), np.ones(len(x))]
    beta = np.zeros(z.shape[1])
    pull = np.r_[np.full(x.shape[1], ridge), 1e-6]
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(pull), z.T @ (good - p) - pull * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    share = good.mean()
    return Model(mean, scale, beta[:-1], float(beta[-1]), float(np.log(share / (1 - share))))


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("good"), pa.array([statistics(x) for x in b.column("text").to_pylist()], pa.list_(pa.float64()))], ["doc_id", "good", "x"])


def _evidence(batches: Iterator[pa.RecordBatch], model: tuple | None) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            e = evidence(model, np.array([statistics(x) for x in b.column("text").to_pylist()])) if model else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("host"), b.column("path"), pa.array(e)], ["doc_id", "host", "path", "evidence"])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN) -> tuple[Model | None, float]:
    """The model, and the labelled share of good documents (0.5 if none is labelled)."""
    some = labels.filter("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("long").alias("good"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    held = docs.join(F.broadcast(some), "doc_id")  # at most ``rows`` short rows
    x = arrow(held.select("doc_id", "good", "text"), _statistics, "doc_id long, good long, x array<double>")
    # rows that repeat a labelled doc_id are more than the labels: the bound holds here
    got = x.orderBy(F.xxhash64("doc_id"), "doc_id", "good", "x").limit(rows).collect()
    if not got:
        return None, 0.5
    good = np.array([bool(r["good"]) for r in got])
    return fit(np.array([r["x"] for r in got]), good), float(good.mean())


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, prior: str) -> float:
    """How many documents a group's prior weighs, from the spread of group means around their priors (bounded); groups have n and total."""
    p, n = F.col("total") / F.col("n"), F.col("n")
    noise = F.sum(F.col(prior) * (1 - F.col(prior)))
    row = groups.agg(F.count("*").alias("k"), F.sum(n).alias("n"), F.sum(n * (p - F.col(prior)) ** 2).alias("spread"), noise.alias("noise"), F.sum(n * F.col(prior) * (1 - F.col(prior))).alias("unit")).first()
    if not row["k"] or row["k"] < 3:
        return STRENGTH[1] if row["k"] and row["k"] < 2 else 100.0
    between = (row["spread"] - row["noise"]) / row["n"]
    within = row["unit"] / row["n"]
    return float(min(max(within / between - 1 if between > 0 else STRENGTH[1], STRENGTH[0]), STRENGTH[1]))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", rows: int = TRAIN) -> DataFrame:
    """Per row: doc_id, evidence, host_prior, path_prior, quality (posterior), kept."""
    bare = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
        F.coalesce(F.col(f"`{host_col}`").cast("string"), F.lit("")).alias("host"), F.coalesce(F.col(f"`{path_col}`").cast("string"), F.lit("")).alias("path"),
    )
    model, share = train(bare.select("doc_id", "text"), labels, rows)
    # a document's own share of goodness, in millionths so that sums don't depend on their order
    base = float(np.log(np.clip(share, 1e-3, 1 - 1e-3) / (1 - np.clip(share, 1e-3, 1 - 1e-3))))
    own = F.round(1e6 / (1 + F.exp(-(F.col("evidence") + base)))).cast("long").alias("own")
    scored = durable(arrow(bare, _evidence, "doc_id long, host string, path string, evidence double", model=model and tuple(model)).select("*", own))
    paths = durable(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("own").alias("sum")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("sum").alias("host_sum"))
    many, total = paths.agg(F.sum("n"), F.sum("sum")).first()
    prior = _bounded(total / 1e6 / many) if many else 0.5
    k_host = _strength(hosts.select(F.col("host_n").alias("n"), (F.col("host_sum") / 1e6).alias("total"), F.lit(prior).alias("up")), "up")
    paths = paths.join(hosts, "host")
    up = (F.col("host_sum") / 1e6 + k_host * prior) / (F.col("host_n") + k_host)
    k_path = _strength(paths.select("n", (F.col("sum") / 1e6).alias("total"), up.alias("up")), "up")
    # each group's prior as it is without the document itself
    rest = F.lit(_bounded(prior)) if (many or 0) < 2 else (F.lit(total) - F.col("own")) / 1e6 / (many - 1)
    host_prior = ((F.col("host_sum") - F.col("own")) / 1e6 + k_host * rest) / (F.col("host_n") - 1 + k_host)
    path_prior = ((F.col("sum") - F.col("own")) / 1e6 + k_path * host_prior) / (F.col("n") - 1 + k_path)
    out = lookup(scored, paths, ["host", "path"]).select("doc_id", "evidence", host_prior.alias("host_prior"), path_prior.alias("path_prior"))
    bound = F.least(F.greatest("path_prior", F.lit(1e-3)), F.lit(1 - 1e-3))
    out = out.withColumn("quality", 1 / (1 + F.exp(-(F.col("evidence") + _logit(bound)))))
    kept = F.lit(True) if model is None else F.col("quality") >= 0.5
    return out.select("doc_id", *[F.round(c, 6).alias(c) for c in ("evidence", "host_prior", "path_prior", "quality")], kept.alias("kept"))


def _bounded(p: float) -> float:
    return min(max(p, 1e-3), 1 - 1e-3)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows that are not rejected, with all columns; rows without a doc_id stay."""
    name = fresh(docs, "rejected_id")
    rejected = classify(docs, labels, id_col, **options).filter("not kept").select(F.col("doc_id").alias(name))
    return docs.join(rejected, F.col(f"`{id_col}`") == F.col(name), "left_anti")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the classifier rejects go."""
    return keep_good(docs, read(spark, sf_dir, "labels"))
