"""A document collection with its indexes: the engine's front door."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import search, sync
from .sources import files
from .sources.segments import SegmentIndex

#: Texts to vectors; runs on executors when files are indexed and on the driver for a query.
Encode = Callable[[list[str]], list[Sequence[float]]]


#: Length of the vector that stands for a text that can't be encoded, where no other text says how long vectors are.
VECTOR = 384


def encoded(encode: Encode, texts: list[str]) -> list[list[float]]:
    """Vectors of texts. If a batch fails its texts are encoded one by one, and a text that fails alone has a vector of zeros, which is near nothing."""

    def tried(some: list[str]) -> list[list[float]] | None:
        try:
            return [list(map(float, v)) for v in encode(some)]
        except Exception:  # noqa: BLE001  an encoder is the user's own: whatever it raises is about its texts
            return None

    if (whole := tried(texts)) is not None and len(whole) == len(texts):
        return whole
    each = [(x := tried([t])) and x[0] for t in texts]
    width = next((len(v) for v in each if v), VECTOR)
    return [v or [0.0] * width for v in each]


#: What the index keeps of a file besides its postings.
KEPT = "path string, mtime long, sha256 string, text string, vec array<double>"


class Corpus:
    """Files of a folder as a searchable collection, in one segment index below ``home``.

    Without an encoder there are no vectors: hybrid search then ranks by keywords alone.
    """

    def __init__(self, spark: SparkSession, home: str, encode: Encode | None = None, ngram: int = T.NGRAM_DEFAULT) -> None:
        self.spark, self.home, self.encode, self.ngram = spark, home, encode, T.ngram_size(ngram)

    def _index(self) -> SegmentIndex:
        return SegmentIndex(self.spark, f"{self.home}/index")

    def table(self, name: str) -> DataFrame | None:
        """``texts`` (path, mtime, sha256, text) or ``vectors`` (path, sha256, vec); None before the first sync."""
        live = self._index().live()
        if live is None:
            return None
        rows = live.withColumnRenamed("doc", "path")
        return rows.select("path", "mtime", "sha256", "text") if name == "texts" else rows.filter("vec is not null").select("path", "sha256", "vec")

    def sync(self, folder: str, reread: bool = False) -> None:
        """Brings the index up to the folder's files; only new and changed ones are extracted, encoded and written.

        A change is told by the time in whole seconds; ``reread`` extracts every file, so that a
        change of content alone is seen too. What is gone, and what changed but can't be read, leaves the index.
        """
        found = files.crawl(self.spark, folder)
        held = self._index()
        old = held.live()
        old = self.spark.createDataFrame([], KEPT) if old is None else old.withColumnRenamed("doc", "path").drop("dl")
        touched = sync.changed(found, old).select("path")
        work = found if reread else found.join(touched, "path", "left_semi")
        read = files.extract(work).filter("error is null").select("path", "mtime", F.sha2("text", 256).alias("sha256"), "text")
        if reread:  # what is as it was isn't written again
            read = read.join(old.select("path", "mtime", "sha256"), ["path", "mtime", "sha256"], "left_anti")
        rows = self._encoded(read, old.join(found.select("path"), "path", "left_semi").join(touched, "path", "left_anti"), old)
        held.upsert(rows, "path", "text", ("mtime", "sha256", "text", "vec"), blanks=False)
        now = held.live()
        if now is not None:  # gone, or changed and not read
            lost = old.select("path").join(found.select("path"), "path", "left_anti")
            stale = now.select(F.col("doc").alias("path"), "mtime").join(found.select("path", F.col("mtime").alias("seen")), "path").filter("mtime <> seen").select("path")
            held.delete(lost.union(stale), "path")

    def _encoded(self, read: DataFrame, stays: DataFrame, old: DataFrame) -> DataFrame:
        """``read`` with vectors: as they were where the content is known, else encoded; and what stays without one though it may have one."""
        if not self.encode:
            return read.withColumn("vec", F.lit(None).cast("array<double>"))
        encode, usable = self.encode, files.extension(F.col("path")).isin(*files.EXTENSIONS) & (T.strip(F.col("text")) != "")
        rows = read.unionByName(stays.filter(F.col("vec").isNull() & usable).join(read.select("path"), "path", "left_anti").drop("vec"))
        known = old.filter("vec is not null").select("path", "sha256", "vec")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    yield pd.DataFrame({"path": b["path"], "sha256": b["sha256"], "vec": encoded(encode, b["text"].tolist())})

        new = rows.filter(usable).join(known, ["path", "sha256"], "left_anti").select("path", "sha256", "text").mapInPandas(run, "path string, sha256 string, vec array<double>")
        return rows.join(new.unionByName(known), ["path", "sha256"], "left")

    def _docs(self) -> DataFrame:
        return self.table("texts").filter("text <> ''").select(F.col("path").alias("doc_id"), "text")

    def _embedded(self) -> DataFrame:
        if self.encode:
            return self.table("vectors").select(F.col("path").alias("vec_id"), F.col("vec").alias("embedding"))
        return self.spark.createDataFrame([], "vec_id string, embedding array<double>")

    def keyword_search(self, query: str, k: int = 10) -> DataFrame:
        """(doc, score), from the postings of the query's terms alone, whatever its grammar."""
        return self._index().search(query, k)

    def vector_search(self, query: str, k: int = 10, refresh: str | None = None) -> DataFrame:
        """(doc, score, snippet); ``refresh``: a folder to sync first, as for a request from another peer."""
        if not self.encode:
            raise ValueError("vector search needs an encoder")
        if refresh is not None:
            self.sync(refresh)
        return search.vector_query_snippets(self._embedded(), self._docs(), query, encoded(self.encode, [query])[0], k, self.ngram).select("doc", "score", "snippet")

    def hybrid_search(self, query: str, k: int = 10, refresh: str | None = None) -> DataFrame:
        """(doc, score, snippet); ``refresh`` as for ``vector_search``."""
        if refresh is not None:
            self.sync(refresh)
        vector = encoded(self.encode, [query])[0] if self.encode else [0.0]
        return search.hybrid_search(self._docs(), self._embedded(), query, vector, k, self.ngram)


def federated_search(corpora: dict[str, Corpus], query: str, local: str, k: int = 10) -> DataFrame:
    """(peer, doc, score): the local corpus' best k and each other's best five, merged."""
    hits = [c.keyword_search(query, k if peer == local else search.PEER_LIMIT).select(F.lit(peer).alias("peer"), "doc", "score") for peer, c in corpora.items()]
    return search.merge_hits(*hits, limit=k)
