"""BM25 ranking as one narrow plan.

A query's terms are known when the plan is built, so a document's tokens are cut down to them
inside the array, before anything is exploded or shuffled: a document becomes (length, tf of each
query term). Collection statistics are one partial aggregate of as many columns as the query has
terms; scoring is a projection, and the top k a TakeOrdered. No shuffle carries a row per token.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .scratch import keeping, releasing

#: Decimals that scores are given with; ties at that are broken by document.
DECIMALS = 6


@dataclass(frozen=True)
class Formula:
    k1: float
    b: float


KEYWORD = Formula(1.2, 0.75)
NGRAM = Formula(1.5, 0.75)


def postings(docs: DataFrame, tokens: Column, id_col: str = "doc_id") -> DataFrame:
    """(doc, dl, term, tf): a document's length and the frequency of each of its terms, without a shuffle; rows that repeat a document each have theirs.

    Counted inside the row: sorted, equal tokens stand together, and a token's last place less that of the one before is its count.
    """
    held = docs.select(F.col(id_col), F.sort_array(tokens).alias("t")).filter(F.size("t") > 0)
    ends = F.filter(F.sequence(F.lit(1), F.size("t")), lambda i: ~F.get("t", i - 1).eqNullSafe(F.get("t", i)))
    held = held.select(id_col, F.size("t").alias("dl"), "t", ends.alias("ends"))
    each = F.transform("ends", lambda e, i: F.struct(F.get("t", e - 1).alias("term"), (e - F.when(i > 0, F.get("ends", i - 1)).otherwise(0)).cast("long").alias("tf")))
    return held.select(id_col, "dl", F.inline(each))


def term_freq(docs: DataFrame, tokens: Column, id_col: str = "doc_id") -> DataFrame:
    """(doc, term, tf): the postings of a collection."""
    return postings(docs, tokens, id_col).drop("dl")


def doc_freq(postings: DataFrame) -> DataFrame:
    """(term, df): in how many documents a term occurs."""
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def length_stats(docs: DataFrame, tokens: Column) -> DataFrame:
    """(n_docs, total_len, avgdl), denominators at least 1."""
    return docs.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum(F.size(tokens)), F.lit(0)).cast("long").alias("total_len")).select(
        "n_docs", "total_len", (F.greatest("total_len", F.lit(1)) / F.greatest("n_docs", F.lit(1))).alias("avgdl")
    )


def matched(docs: DataFrame, tokens: Column, terms: list[str], keep: list[str]) -> DataFrame:
    """(keep..., dl, tfs array<long>): length and frequencies of the terms, in their order."""
    wanted = F.array(*map(F.lit, terms)).cast("array<string>")
    held = docs.select(*keep, tokens.alias("tokens")).select(*keep, F.size("tokens").alias("dl"), F.filter("tokens", lambda t: t.isin(*terms) if terms else F.lit(False)).alias("hits"))
    return held.select(*keep, "dl", F.transform(wanted, lambda w: F.size(F.filter("hits", lambda h: h == w))).alias("tfs"))


def matched_ngrams(docs: DataFrame, text: Column, n: int, terms: list[str], keep: list[str]) -> DataFrame:
    """As ``matched`` with ``T.char_ngrams``, which aren't made: lengths and occurrences are counted in the text itself.

    A word of L letters has max(1, L + 3 - n) n-grams. Between words stand two marks, and a term has marks at its ends alone, so it never lies across them.
    """
    n = T.ngram_size(n)
    held = docs.select(*keep, T.normalize(text).alias("_norm"))
    marked = F.when(F.col("_norm") == "", "").otherwise(F.concat(F.lit("_"), F.replace(F.col("_norm"), F.lit(" "), F.lit("__")), F.lit("_")))
    words = F.when(F.col("_norm") == "", 0).otherwise(F.octet_length("_norm") - F.octet_length(F.replace(F.col("_norm"), F.lit(" "), F.lit(""))) + 1)
    longer = F.octet_length(F.regexp_replace("_norm", f"(?:^| )[^ ]{{1,{n - 2}}}", ""))
    held = held.select(*keep, (words + longer).alias("dl"), marked.alias("_marked"))

    def count(term: str) -> Column:
        inner = term.strip("_")
        if any(inner.startswith(inner[k:]) for k in range(1, len(inner))):  # it can overlap itself
            return F.regexp_count("_marked", F.lit(f"(?={term})")).cast("long")
        return ((F.octet_length("_marked") - F.octet_length(F.replace(F.col("_marked"), F.lit(term), F.lit("")))) / len(term)).cast("long")

    return held.select(*keep, "dl", F.array(*map(count, terms)).cast("array<long>").alias("tfs"))


def statistics(rows: DataFrame, terms: list[str], by: list[str] | None = None) -> DataFrame:
    """(by..., n_docs, avgdl, dfs): one row per collection."""
    dfs = [F.sum((F.get("tfs", F.lit(i)) > 0).cast("long")).alias(f"df{i}") for i in range(len(terms))]
    out = rows.groupBy(*(by or [])).agg(F.count("*").alias("n_docs"), F.sum("dl").alias("total_len"), *dfs)
    return out.select(*(by or []), "n_docs", (F.greatest("total_len", F.lit(1)) / F.greatest("n_docs", F.lit(1))).alias("avgdl"), F.array(*[f"df{i}" for i in range(len(terms))]).cast("array<long>").alias("dfs"))


def score(weights: list[float], f: Formula, places: list[int] | None = None) -> Column:
    """BM25 from dl, tfs, n_docs, avgdl and dfs; ``weights``: how often the query names each term, or its boosts; ``places``: where in tfs and dfs the terms are."""
    at = lambda c: F.col(c) if places is None else F.array(*[F.get(c, F.lit(i)) for i in places]).cast("array<long>")
    part = F.arrays_zip(at("tfs").alias("tfs"), at("dfs").alias("dfs"), F.array(*map(F.lit, weights)).cast("array<double>").alias("qf"))
    share = 1 - f.b + f.b * F.greatest(F.col("dl"), F.lit(1)) / F.col("avgdl")

    def add(total: Column, x: Column) -> Column:
        idf = F.log((F.col("n_docs") - x["dfs"] + 0.5) / (x["dfs"] + 0.5) + 1)
        return total + F.when(x["tfs"] > 0, x["qf"] * idf * x["tfs"] * (f.k1 + 1) / (x["tfs"] + f.k1 * share)).otherwise(0.0)

    return F.aggregate(part, F.lit(0.0), add)


def scored(docs: DataFrame, tokens: Column, query: list[str] | Mapping[str, float], f: Formula, keep: list[str], by: list[str] | None = None) -> DataFrame:
    """(keep..., dl, score) of every document, statistics over the whole collection or each of ``by``.

    The rows that statistics and scores share are cached until the result is no longer held.
    """
    counts = Counter(query)  # of a list's tokens, or the weights that a mapping gives them
    return _ranked(matched(docs, tokens, list(counts), keep), counts, f, keep, by)


def _ranked(rows: DataFrame, counts: Mapping[str, float], f: Formula, keep: list[str], by: list[str] | None = None) -> DataFrame:
    terms = list(counts)
    rows = rows.persist()  # a row per document with a few numbers, which statistics and scores both read: texts are read once
    stats = statistics(rows, terms, by)
    joined = rows.join(stats, by) if by else rows.crossJoin(F.broadcast(stats))  # one row
    return releasing(joined.select(*keep, "dl", F.round(score([counts[t] for t in terms], f), DECIMALS).alias("score")), rows)


def _py_tokens(query: str) -> list[str]:
    """Keyword tokens of a query string; the same rule as for documents."""
    import regex

    return [t.lower() for t in regex.split(r"[^\p{L}\p{N}]+", query) if t and len(t.encode()) < T.TOKEN_BYTES]


def _py_ngrams(query: str, n: int) -> list[str]:
    n = T.ngram_size(n)
    out = []
    for w in T._py_normalize(query).split():
        w = f"_{w}_"
        out += [w] if len(w) < n else [w[i : i + n] for i in range(len(w) - n + 1)]
    return out


def keyword_topk(docs: DataFrame, query: str, k: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, score): documents that match the query, best first.

    The grammar is that of ``query``. A malformed query gives no rows.
    """
    from .query import parse

    parsed = parse(query)
    if parsed is None or parsed.root is None or k <= 0:
        return docs.select(F.col(id_col).alias("doc"), F.lit(0.0).alias("score")).limit(0)
    tokens = T.keyword_tokens(F.coalesce(F.col(text_col), F.lit("")))
    held = docs.select(F.col(id_col).alias("_doc"), F.col(text_col), parsed.condition(tokens).alias("_ok"), parsed.constant(tokens).alias("_more"))
    rows = scored(held, tokens, parsed.terms, KEYWORD, ["_doc", "_ok", "_more"])
    best = rows.withColumn("score", F.round(F.col("score") + F.col("_more"), DECIMALS)).filter((F.col("score") > 0) & F.col("_ok"))
    return keeping(best.select(F.col("_doc").alias("doc"), "score").orderBy(F.desc("score"), "doc").limit(k), rows)


def ngram_scores(docs: DataFrame, query: str, n: int = T.NGRAM_DEFAULT, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(doc, keep..., dl, score) of every document by character n-grams, zero scores included."""
    counts = Counter(_py_ngrams(query, n))
    rows = docs.select(F.col(id_col).alias("doc"), text_col, *(keep or []))
    rows = matched_ngrams(rows, F.coalesce(F.col(text_col), F.lit("")), n, list(counts), ["doc", *(keep or [])])
    return _ranked(rows, counts, NGRAM, ["doc", *(keep or [])])
