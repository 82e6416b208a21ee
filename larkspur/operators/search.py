"""Vector, hybrid and federated search."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vector as V
from . import bm25
from .scratch import keeping, releasing

# Candidates and weights that results depend on.
RERANK_FACTOR = 10
HYBRID_CANDIDATES = 200
BM25_WEIGHT, VEC_WEIGHT = 0.7, 0.3
PEER_LIMIT = 5
COSINE_DECIMALS = 6

#: An encoder turns a query into a vector; none is bundled.
Encoder = Callable[[str], Sequence[float]]


def cosine_topk(vectors: DataFrame, query_vector: Sequence[float], k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(doc, cosine): the query vector is a literal, so this is a narrow scan and a TakeOrdered of k rows a partition."""
    sim = F.round(V.cosine(F.col(vector_col), V.literal(query_vector)), COSINE_DECIMALS)
    return vectors.select(F.col(id_col).alias("doc"), sim.alias("cosine")).orderBy(F.desc("cosine"), "doc").limit(k)


def vec_lookup(vectors: DataFrame, doc: int, id_col: str = "vec_id", vector_col: str = "embedding") -> list[float] | None:
    """A document's vector; the id is a filter on the scan."""
    row = vectors.filter(F.col(id_col) == doc).select(vector_col).first()
    return list(row[0]) if row and row[0] is not None else None


def ngram_rerank(candidates: DataFrame, docs: DataFrame, query: str, k: int, n: int = T.NGRAM_DEFAULT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, score, cosine) of candidates (doc, cosine), best n-gram BM25 first.

    Statistics are those of the candidates alone, and candidates that score nothing stay, in order
    of their cosine. Where the query or all candidates have no n-grams, the cosine is the score.
    """
    few = F.broadcast(candidates)  # at most RERANK_FACTOR * k rows
    held = docs.select(F.col(id_col).alias("doc"), text_col).join(few, "doc").select("doc", F.col(text_col).alias("text"), "cosine")
    rows = few.join(held.select("doc", "text"), "doc", "left")
    terms = bm25._py_ngrams(query, n)
    if not terms:
        return candidates.select("doc", F.col("cosine").alias("score"), "cosine").orderBy(F.desc("score"), "doc").limit(k)
    out = bm25.ngram_scores(rows, query, n, "doc", "text", ["cosine"])
    blank = F.max("dl").over(Window.partitionBy(F.lit(1))) == 0  # over the few candidates
    best = out.select("doc", F.when(blank, F.col("cosine")).otherwise(F.col("score")).alias("score"), "cosine").orderBy(F.desc("score"), F.desc("cosine"), "doc").limit(k)
    return keeping(best, out)


def vector_query(vectors: DataFrame, docs: DataFrame, query: str, query_vector: Sequence[float], k: int, n: int = T.NGRAM_DEFAULT) -> DataFrame:
    """The 10k nearest by cosine, re-ranked by n-grams to k."""
    if not query.strip() or k <= 0:
        return ngram_rerank(cosine_topk(vectors, query_vector, 0), docs, "a", 0, n)
    return ngram_rerank(cosine_topk(vectors, query_vector, RERANK_FACTOR * k), docs, query, k, n)


def with_snippets(hits: DataFrame, docs: DataFrame, query: str, scaled: bool, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds a snippet; texts join only the final hits, which are few."""
    found = docs.select(F.col(id_col).alias("doc"), text_col).join(F.broadcast(hits.select("doc")), "doc", "left_semi")
    text = F.coalesce(F.col(text_col), F.lit(""))
    make = T.snippet_scaled if scaled else T.snippet_exact
    out = hits.join(found.select("doc", T.head(make(text, query)).alias("snippet")), "doc", "left").withColumn("snippet", F.coalesce("snippet", F.lit("")))
    # a join keeps no order: the few hits are ranked again, ties as before
    return keeping(out.orderBy(*[F.desc(c) for c in ("score", "cosine", "bm") if c in hits.columns], "doc"), hits)


def vector_query_snippets(vectors: DataFrame, docs: DataFrame, query: str, query_vector: Sequence[float], k: int, n: int = T.NGRAM_DEFAULT) -> DataFrame:
    return with_snippets(vector_query(vectors, docs, query, query_vector, k, n), docs, query, True)


def hybrid_join(hits: DataFrame, vectors: DataFrame, query_vector: Sequence[float], id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(doc, score, cosine) of hits that have a vector."""
    few = F.broadcast(hits)  # at most HYBRID_CANDIDATES rows: the vector table is scanned, never shuffled
    sim = F.round(V.cosine(F.col(vector_col), V.literal(query_vector)), COSINE_DECIMALS)
    return keeping(vectors.select(F.col(id_col).alias("doc"), vector_col).join(few, "doc").select("doc", "score", sim.alias("cosine")), hits)


def fuse(joined: DataFrame, best: float, k: int) -> DataFrame:
    """(doc, score, bm) by weighted keyword score, divided by the best one but not by less than 1, and cosine."""
    mixed = BM25_WEIGHT * F.col("score") / F.lit(max(best, 1.0)) + VEC_WEIGHT * F.greatest("cosine", F.lit(0.0))
    return joined.select("doc", F.round(mixed, bm25.DECIMALS).alias("fused"), F.col("score").alias("bm")).orderBy(F.desc("fused"), F.desc("bm"), "doc").limit(k).select("doc", F.col("fused").alias("score"), "bm")


def hybrid_search(docs: DataFrame, vectors: DataFrame, query: str, query_vector: Sequence[float], k: int = 10, n: int = T.NGRAM_DEFAULT) -> DataFrame:
    """(doc, score, snippet): keyword hits fused with cosines; without hits the vector query, without vectors the keyword scores."""
    hits = bm25.keyword_topk(docs, query, HYBRID_CANDIDATES).persist()  # two hundred rows that three plans read
    top = hits.agg(F.max("score")).first()[0]
    if top is None:
        hits.unpersist()
        found = vector_query_snippets(vectors, docs, query, query_vector, k, n)
        return keeping(found.select("doc", "score", T.head(F.col("snippet")).alias("snippet")), found)
    joined = hybrid_join(hits, vectors, query_vector).persist()
    ranked = fuse(joined, top, k) if not joined.isEmpty() else hits.orderBy(F.desc("score"), "doc").limit(k)
    return releasing(with_snippets(ranked, docs, query, False).select("doc", "score", "snippet"), hits, joined)


#: Queries that share a plan; of more, each so many have one.
TOGETHER = 32


def hybrid_many(docs: DataFrame, vectors: DataFrame, queries: Sequence[tuple[int, str, Sequence[float]]], k: int = 10, n: int = T.NGRAM_DEFAULT) -> DataFrame:
    """(query_id, rank, doc, score, branch, snippet): ``hybrid_search`` of many queries (id, text, vector), without a job while it is planned.

    Texts are tokenised once and vectors read once for all queries of a plan. Which way a query goes is a matter of its rows: ``fused`` if it
    has keyword hits with vectors, ``keyword`` if hits but no vectors, ``vector`` if no hits. A blank or malformed query has no hits, and a blank one
    no rows at all; ids are taken to differ.
    """
    parts = [_together(docs, vectors, list(queries[i : i + TOGETHER]), k, n) for i in range(0, max(1, len(queries)), TOGETHER)]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    for x in parts if len(parts) > 1 else []:
        keeping(out, x)
    return out


def _keyword_hits(docs: DataFrame, texts: list[str]) -> tuple[DataFrame, DataFrame]:
    """(q, doc, score): each query's HYBRID_CANDIDATES best; and the rows to release."""
    from .query import parse

    parsed = {i: p for i, t in enumerate(texts) if (p := parse(t)) is not None and p.root is not None}
    terms = list(dict.fromkeys(t for p in parsed.values() for t in p.terms))
    tokens = F.col("tokens")
    held = docs.select(F.col("doc_id").alias("doc"), T.keyword_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    checks = [F.struct(p.condition(tokens).alias("ok"), p.constant(tokens).cast("double").alias("more")) for p in parsed.values()]
    held = held.select("doc", "tokens", F.array(*checks).cast("array<struct<ok:boolean,more:double>>").alias("checks"))
    rows = bm25.matched(held, tokens, terms, ["doc", "checks"]).persist()
    every = rows.crossJoin(F.broadcast(bm25.statistics(rows, terms)))  # one row
    each = []
    for place, (i, p) in enumerate(parsed.items()):
        own = F.round(bm25.score(list(map(float, p.terms.values())), bm25.KEYWORD, [terms.index(t) for t in p.terms]), bm25.DECIMALS)
        check = F.get("checks", F.lit(place))
        each.append(F.struct(F.lit(i).alias("q"), F.when(check["ok"], F.round(own + check["more"], bm25.DECIMALS)).otherwise(0.0).alias("score")))
    scores = every.select("doc", F.inline(F.array(*each).cast("array<struct<q:int,score:double>>"))).filter("score > 0")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "doc"))
    return scores.withColumn("rank", rank).filter(F.col("rank") <= HYBRID_CANDIDATES).select("q", "doc", "score"), rows


def _grams_ranked(found: DataFrame, docs: DataFrame, texts: list[str], n: int) -> DataFrame:
    """(q, doc, score, cosine) of (q, doc, cosine) as by ``ngram_rerank``: the statistics are those of a query's own candidates."""
    grams = [Counter(bm25._py_ngrams(t, n)) for t in texts]
    terms = list(dict.fromkeys(t for g in grams for t in g))
    few = F.broadcast(found)  # at most RERANK_FACTOR * k rows for each of TOGETHER queries
    held = docs.select(F.col("doc_id").alias("doc"), "text").join(few, "doc").select("q", "doc", "text")
    rows = found.join(held, ["q", "doc"], "left")
    rows = bm25.matched(rows, T.char_ngrams(F.coalesce("text", F.lit("")), n), terms, ["q", "doc", "cosine"])
    w = Window.partitionBy("q")  # those candidates
    dfs = [F.sum((F.get("tfs", F.lit(i)) > 0).cast("long")).over(w) for i in range(len(terms))]
    rows = rows.select("*", F.count("*").over(w).alias("n_docs"), F.sum("dl").over(w).alias("total"), F.max("dl").over(w).alias("longest"), F.array(*dfs).cast("array<long>").alias("dfs"))
    rows = rows.withColumn("avgdl", F.greatest("total", F.lit(1)) / F.greatest("n_docs", F.lit(1)))
    own = F.col("cosine")
    for i, g in enumerate(grams):
        if g:
            by = F.round(bm25.score(list(map(float, g.values())), bm25.NGRAM, [terms.index(t) for t in g]), bm25.DECIMALS)
            own = F.when((F.col("q") == i) & (F.col("longest") > 0), by).otherwise(own)
    return rows.select("q", "doc", own.alias("score"), "cosine")


def _together(docs: DataFrame, vectors: DataFrame, queries: list[tuple[int, str, Sequence[float]]], k: int, n: int) -> DataFrame:
    texts = [t for _, t, _ in queries]
    hits, rows = _keyword_hits(docs, texts)
    hits = hits.withColumn("best", F.max("score").over(Window.partitionBy("q"))).persist()  # HYBRID_CANDIDATES a query, which the three ways read
    sims = [F.struct(F.lit(i).alias("q"), F.round(V.cosine(F.col("embedding"), V.literal(v)), COSINE_DECIMALS).alias("cosine")) for i, (_, _, v) in enumerate(queries)]
    near = vectors.select(F.col("vec_id").alias("doc"), F.inline(F.array(*sims).cast("array<struct<q:int,cosine:double>>")))
    blank = [i for i, t in enumerate(texts) if not t.strip()]

    both = near.join(F.broadcast(hits), ["q", "doc"]).persist()  # as few
    mixed = F.round(BM25_WEIGHT * F.col("score") / F.greatest("best", F.lit(1.0)) + VEC_WEIGHT * F.greatest("cosine", F.lit(0.0)), bm25.DECIMALS)
    fused = both.select("q", "doc", mixed.alias("score"), F.col("score").alias("then"), F.lit("fused").alias("branch"))
    keyword = hits.join(both.select("q").distinct(), "q", "left_anti").select("q", "doc", "score", F.lit(0.0).alias("then"), F.lit("keyword").alias("branch"))
    lost = near.filter(~F.col("q").isin(*blank)) if blank else near
    lost = lost.join(F.broadcast(hits.select("q").distinct()), "q", "left_anti")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("cosine"), "doc"))
    lost = lost.withColumn("place", place).filter(F.col("place") <= RERANK_FACTOR * k).select("q", "doc", "cosine")
    vector = _grams_ranked(lost, docs, texts, n).select("q", "doc", "score", F.col("cosine").alias("then"), F.lit("vector").alias("branch"))

    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.desc("then"), "doc"))
    top = fused.unionByName(keyword).unionByName(vector).withColumn("rank", rank).filter(F.col("rank") <= k)
    found = docs.select(F.col("doc_id").alias("doc"), "text").join(F.broadcast(top.select("q", "doc")), "doc")
    text, snippet, name = F.coalesce("text", F.lit("")), F.lit(""), F.lit(None).cast("long")
    for i, (ident, t, _) in enumerate(queries):
        made = F.when(F.col("branch") == "vector", T.head(T.head(T.snippet_scaled(text, t)))).otherwise(T.head(T.snippet_exact(text, t)))
        snippet = F.when(F.col("q") == i, F.when(F.col("text").isNull(), "").otherwise(made)).otherwise(snippet)
        name = F.when(F.col("q") == i, F.lit(ident).cast("long")).otherwise(name)
    out = top.join(found.select("q", "doc", "text"), ["q", "doc"], "left")
    return releasing(out.select(name.alias("query_id"), "rank", "doc", "score", "branch", snippet.alias("snippet")), rows, hits, both)


def peer_topk(docs: DataFrame, query: str, limit: int = PEER_LIMIT, peer_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(peer, doc, score): each peer ranks its own documents by its own statistics."""
    rows = docs.select(F.col(peer_col).alias("peer"), F.col(id_col).alias("doc"), text_col)
    tokens = T.keyword_tokens(F.coalesce(F.col(text_col), F.lit("")))
    out = bm25.scored(rows, tokens, bm25._py_tokens(query), bm25.KEYWORD, ["peer", "doc"], ["peer"])
    rank = F.row_number().over(Window.partitionBy("peer").orderBy(F.desc("score"), "doc"))
    return keeping(out.filter("score > 0").withColumn("rank", rank).filter(F.col("rank") <= limit).select("peer", "doc", "score"), out)


def merge_hits(*hits: DataFrame, limit: int) -> DataFrame:
    """All hits, copies included, best first: UNION ALL, sort, cut."""
    out = hits[0]
    for x in hits[1:]:
        out = out.unionByName(x)
    return out.orderBy(F.desc("score"), "peer", "doc").limit(limit)


def federated_search(docs: DataFrame, query: str, local_peer: str, limit: int = 10, peer_col: str = "source") -> DataFrame:
    """(peer, doc, score): the local peer's best ``limit`` and every other's best five, merged."""
    found = peer_topk(docs, query, max(limit, PEER_LIMIT), peer_col)
    rank = F.row_number().over(Window.partitionBy("peer").orderBy(F.desc("score"), "doc"))
    ranked = found.withColumn("rank", rank)
    local = ranked.filter((F.col("peer") == local_peer) & (F.col("rank") <= limit)).drop("rank")
    remote = ranked.filter((F.col("peer") != local_peer) & (F.col("rank") <= PEER_LIMIT)).drop("rank")
    return keeping(merge_hits(local, remote, limit=limit), found)
