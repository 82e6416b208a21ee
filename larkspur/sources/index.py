"""Index tables: postings by term, document lengths, vectors; each written together with its tracker.

A snapshot is a folder of its own, and a small pointer file names the live one; the pointer moves
only after all tables are written, so a tracker never claims what an index doesn't hold. The snapshot before the
live one stays for who still reads it; older ones are deleted.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import bm25


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def save(folder: str, **tables: DataFrame | Callable[[str], DataFrame]) -> str:
    """Writes a snapshot and makes it the live one; returns its folder. The first is a table; others may be made from the snapshot's folder, which holds those before."""
    spark = next(iter(tables.values())).sparkSession
    version = uuid.uuid4().hex
    for name, table in tables.items():
        (table(f"{folder}/{version}") if callable(table) else table).write.parquet(f"{folder}/{version}/{name}")
    fs, path = _fs(spark, f"{folder}/LIVE")
    before = spark.read.text(f"{folder}/LIVE").first()[0] if fs.exists(path) else ""
    out = fs.create(path, True)
    out.write(version.encode())
    out.close()
    for entry in fs.listStatus(_fs(spark, folder)[1]):
        if entry.isDirectory() and re.fullmatch("[0-9a-f]{32}", name := entry.getPath().getName()) and name not in (version, before):
            fs.delete(entry.getPath(), True)
    return f"{folder}/{version}"


def load(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """A table of the live snapshot; None if there is no snapshot."""
    fs, path = _fs(spark, f"{folder}/LIVE")
    if not fs.exists(path):
        return None
    version = spark.read.text(f"{folder}/LIVE").first()[0]
    return spark.read.parquet(f"{folder}/{version}/{name}")


def by_term(postings: DataFrame) -> DataFrame:
    """Each file sorted where its documents are, so that a query's terms are a pushed-down filter on few pages of it; nothing is shuffled or sampled."""
    return postings.sortWithinPartitions("term", "doc")


def build_keyword(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> str:
    tokens = docs.select(F.col(id_col).alias("doc"), T.keyword_tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("tokens"))
    lengths = lambda at: docs.sparkSession.read.parquet(f"{at}/postings").agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("total"))
    total = lambda at: docs.agg(F.count("*").alias("n_docs")).crossJoin(lengths(at)).coalesce(1)  # noqa: E731  one row each; tokens are made once
    return save(folder, postings=by_term(bm25.postings(tokens, F.col("tokens"), "doc")), totals=total)


def search_keyword(spark: SparkSession, folder: str, query: str, k: int = 10) -> DataFrame:
    """(doc, score) by the index: only the postings of the query's terms are read."""
    counts: dict[str, int] = {}
    for t in bm25._py_tokens(query):
        counts[t] = counts.get(t, 0) + 1
    lengths = load(spark, folder, "totals").select("n_docs", (F.greatest("total", F.lit(1)) / F.greatest("n_docs", F.lit(1))).alias("avgdl"))
    hits = load(spark, folder, "postings").filter(F.col("term").isin(*counts) if counts else F.lit(False))
    qf = F.create_map(*[F.lit(x) for kv in counts.items() for x in kv]) if counts else F.create_map(F.lit(""), F.lit(0))
    dfs = hits.groupBy("term").agg(F.count("*").alias("df"))
    rows = hits.join(F.broadcast(dfs), "term").crossJoin(F.broadcast(lengths))  # one row for each query term; one row
    f = bm25.KEYWORD
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = qf[F.col("term")] * idf * F.col("tf") * (f.k1 + 1) / (F.col("tf") + f.k1 * (1 - f.b + f.b * F.greatest(F.col("dl"), F.lit(1)) / F.col("avgdl")))
    return rows.groupBy("doc").agg(F.round(F.sum(part), bm25.DECIMALS).alias("score")).orderBy(F.desc("score"), "doc").limit(k)
