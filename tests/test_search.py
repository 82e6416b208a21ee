"""Ranking rules that are easily lost, each against its tempting wrong variant."""

import math

import pytest
from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.operators import bm25, search
from larkspur.operators.query import parse
from larkspur.sources import index


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, "apple banana apple"), (2, "banana cherry"), (3, ""), (4, None), (5, "date fig grape kiwi")], "doc_id long, text string")


def hand(tf, df, dl, n, avg, k1, qf=1):
    return qf * math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * (k1 + 1) / (tf + k1 * (0.25 + 0.75 * dl / avg))


def test_keyword_scores_by_hand(docs):
    got = {r.doc: r.score for r in bm25.keyword_topk(docs, "apple banana banana", 10).collect()}
    avg = 9 / 5
    assert got == pytest.approx({1: hand(2, 1, 3, 5, avg, 1.2) + hand(1, 2, 3, 5, avg, 1.2, 2), 2: hand(1, 2, 2, 5, avg, 1.2, 2)}, abs=1e-6)


def test_index_and_scan_agree(spark, docs, tmp_path):
    index.build_keyword(docs, f"file://{tmp_path}")
    for q in ("apple banana", "banana banana fig", "nothing", ""):
        assert index.search_keyword(spark, f"file://{tmp_path}", q).collect() == bm25.keyword_topk(docs, q, 10).collect()


def test_snapshot_is_live_only_when_whole(spark, tmp_path):
    top = f"file://{tmp_path}"
    assert index.load(spark, top, "v") is None
    index.save(top, v=spark.range(3))
    index.save(top, v=spark.range(5))
    assert index.load(spark, top, "v").count() == 5


def test_grammar(docs):
    def found(q):
        return sorted(r.doc for r in bm25.keyword_topk(docs, q, 10).collect())

    assert found("apple cherry") == [1, 2]
    assert found("apple AND banana") == [1]
    assert found("banana -cherry") == [1]
    assert found("banana NOT apple") == [2]
    assert found('"banana cherry"') == [2]
    assert found('"cherry banana"') == []
    assert found('"open') == [] and parse("AND x") is None and parse("x NOT") is None
    assert found("  ") == []
    assert found("(apple OR cherry) AND banana") == [1, 2] and found("date OR apple AND banana") == [1, 5] and found("apple AND cherry OR fig") == [5]
    assert found("+banana -(apple cherry)") == [] and found("(banana -cherry) date") == [1, 5] and found("NOT apple banana") == [2]
    assert found("content:apple") == [1] and parse("path:apple") is None and parse("other:x") is None
    assert found("[c TO d]") == [2] and found("content:[b TO cherry}") == [1, 2] and found("{cherry TO *]") == [5] and found("+banana +[cherry TO d]") == [2]
    for bad in ("(apple", "apple)", "()x)", "-apple", "(-apple) banana", "apple AND", "OR apple", "+", "[a b]", "[a TO b", "NOT NOT a"):
        assert found(bad) == [] and (parse(bad) is None or parse(bad).root is None), bad


def test_boosts(docs):
    def scores(q):
        return {r.doc: r.score for r in bm25.keyword_topk(docs, q, 10).collect()}

    one = scores("cherry")[2]
    assert scores("cherry^2.5")[2] == pytest.approx(2.5 * one, abs=2e-6) and scores("(cherry^2 zzz)^3")[2] == pytest.approx(6 * one, abs=5e-6)
    assert scores('"banana cherry"^2')[2] == pytest.approx(2 * scores('"banana cherry"')[2], abs=2e-6)
    assert scores("[c TO d]^3") == {2: 3.0} and scores("cherry [c TO d]")[2] == pytest.approx(one + 1, abs=1e-6)


def test_cached_rows_are_released(spark, docs):
    import gc

    def held():
        return spark.sparkContext._jsc.getPersistentRDDs().size()

    gc.collect()
    before = held()
    hit = bm25.keyword_topk(docs, "apple banana", 3)
    assert hit.count() == 2 and held() > before
    del hit
    gc.collect()
    assert held() <= before


def test_rerank_uses_candidates_alone_and_keeps_zeros(spark, docs):
    few = spark.createDataFrame([(5, 0.9), (2, 0.8), (3, 0.7), (99, 0.6)], "doc long, cosine double")
    got = search.ngram_rerank(few, docs, "cherry", 10).collect()
    assert [r.doc for r in got] == [2, 5, 3, 99] and [r.score > 0 for r in got] == [True, False, False, False]
    n, grams = 4, len(bm25._py_ngrams("banana cherry", 5))
    lengths = [grams, len(bm25._py_ngrams("date fig grape kiwi", 5)), 0, 0]
    assert got[0].score == pytest.approx(sum(hand(1, 1, grams, n, sum(lengths) / n, 1.5) for _ in bm25._py_ngrams("cherry", 5)), abs=1e-5)


def test_cosine_is_the_score_only_without_ngrams(spark, docs):
    few = spark.createDataFrame([(3, 0.9), (4, 0.8)], "doc long, cosine double")
    assert [r.score for r in search.ngram_rerank(few, docs, "cherry", 10).collect()] == [0.9, 0.8]
    assert [r.score for r in search.ngram_rerank(few, docs, "!!", 10).collect()] == [0.9, 0.8]


def test_hybrid_and_fallbacks(spark, docs):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (5, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    mixed = {r.doc: r.score for r in search.hybrid_search(docs, vectors, "banana", [0.0, 1.0], 10).collect()}
    hits = {r.doc: r.score for r in bm25.keyword_topk(docs, "banana", 10).collect()}
    top = max(max(hits.values()), 1.0)  # weak matches aren't stretched
    assert mixed == pytest.approx({1: 0.7 * hits[1] / top, 2: 0.7 * hits[2] / top + 0.3}, abs=1e-6)
    assert {r.doc: r.score for r in search.hybrid_search(docs, vectors.limit(0), "banana", [0.0, 1.0], 10).collect()} == hits
    assert [r.doc for r in search.hybrid_search(docs, vectors, "zzz", [1.0, 0.0], 2).collect()] == [1, 2]


def test_many_queries_go_as_each_alone(spark):
    texts = ["banana split", "banana bread banana", "only kiwi here", None, "", "kiwi tart", "fig", "fig fig jam and more words", "nabana"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (3, [-1.0, 0.2]), (6, [0.6, 0.8]), (8, None), (99, [0.5, 0.5])], "vec_id long, embedding array<float>")
    asked = ["banana", "kiwi", "zzz", '+"banana bread" -split', "fig^2 OR banana", "bad (", " ", "anan", "?!"]
    queries = [(100 + i, t, [1.0, float(i)]) for i, t in enumerate(asked)] + [(200 + i, "fig", [0.0, 1.0]) for i in range(search.TOGETHER)]
    rows = search.hybrid_many(docs, vectors, queries, 3).collect()
    ways = {}
    for ident, text, v in queries[: len(asked) + 1]:
        got = sorted((r for r in rows if r.query_id == ident), key=lambda r: r["rank"])
        assert [(r.doc, r.score, r.snippet) for r in got] == [tuple(r) for r in search.hybrid_search(docs, vectors, text, v, 3).collect()], text
        assert [r["rank"] for r in got] == list(range(1, len(got) + 1))
        ways[text] = {r.branch for r in got}
    assert ways == {"banana": {"fused"}, "kiwi": {"keyword"}, "zzz": {"vector"}, '+"banana bread" -split': {"fused"}, "fig^2 OR banana": {"fused"}, "bad (": {"vector"}, " ": set(), "anan": {"vector"}, "?!": {"vector"}, "fig": {"fused"}}
    assert {tuple(r)[1:] for r in rows if r.query_id >= 200} == {tuple(r)[1:] for r in rows if r.query_id == 200}
    assert len({r.query_id for r in rows}) == len(queries) - 1
    assert search.hybrid_many(docs, vectors, [], 3).count() == 0
    assert search.hybrid_many(docs.limit(0), vectors.limit(0), queries[:2], 3).count() == 0


def test_peers_have_their_own_statistics(spark):
    rows = [(1, "a", "x y"), (2, "a", "x z"), (3, "b", "x"), (4, "b", "w w w")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r.doc: r.score for r in search.peer_topk(docs, "x").collect()}
    assert got[1] == pytest.approx(hand(1, 2, 2, 2, 2, 1.2), abs=1e-6) and got[3] == pytest.approx(hand(1, 1, 1, 2, 2, 1.2), abs=1e-6)
    assert [r.doc for r in search.federated_search(docs, "x", "a", 2).collect()] == [3, 1]


def test_merge_keeps_copies(spark):
    a = spark.createDataFrame([("p", 1, 0.5)], "peer string, doc long, score double")
    assert search.merge_hits(a, a, limit=5).count() == 2


def test_plans_are_narrow(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = bm25.keyword_topk(docs, "the of", 5)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "SortMergeJoin" not in plan
    base = bm25.matched(docs, T.keyword_tokens(F.col("text")), ["the"], ["doc_id"])._jdf.queryExecution().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in base


def test_ngrams_are_counted_in_the_text(spark):
    """Lengths and occurrences without making n-grams equal those of the n-grams."""
    texts = ["", None, "a", "Of the of of", "aaaaaaa aaaa aa", "ababababa bab", "the-the the_the thethe!", "été der  Straße 12345", "x" * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("text", F.coalesce("text", F.lit("")))
    for n in (3, 4, 5, 6):
        terms = sorted(set(bm25._py_ngrams("of the aaaaaaa ababa thethe a aa 12345 estion", n)))
        want = bm25.matched(docs, T.char_ngrams(F.col("text"), n), terms, ["doc_id"])
        got = bm25.matched_ngrams(docs, F.col("text"), n, terms, ["doc_id"])
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())), n
