"""The segment index against ranking the living documents from scratch."""

import random
from pathlib import Path

import pytest

from larkspur.operators import bm25
from larkspur.sources.segments import SegmentIndex

WORDS = ["apple", "pear", "plum", "fig", "of", "the", "and", "kiwi", "lime", "éclair"]
QUERIES = ['"of the"', '+apple -"pear plum" fig', "(apple^2 OR kiwi) AND (of OR the) -lime", "[fig TO lime]", "apple {kiwi TO *} -plum", "NOT apple pear", '"apple pear plum"', "éclair", "absent", "-apple", "apple AND", '"of the" OR "the of"', "the the of"]


def text(rnd):
    return " ".join(rnd.choices(WORDS, [9, 5, 3, 2, 20, 25, 10, 1, 1, 0.5], k=rnd.randint(0, 40)))


def size(home, parts=("docs", "postings")):
    return sum(p.stat().st_size for p in Path(home).rglob("*.parquet") if p.parent.name in parts or p.parent.name.startswith("dead"))


def rows(df):
    return [tuple(r) for r in df.collect()]


def frame(spark, docs):
    return spark.createDataFrame(sorted(docs.items()), "doc_id long, text string")


def test_index_follows_changes(spark, tmp_path):
    rnd = random.Random(4)
    docs = {k: text(rnd) for k in range(300)} | {300: None, 301: "", 302: "apple " * 3000}
    home = str(tmp_path / "ix")
    held = SegmentIndex(spark, f"file://{home}", block=8, merge=3, first=4)
    assert held.search("apple").collect() == []
    held.upsert(frame(spark, docs).union(frame(spark, {5: ""})))  # an id twice: the larger text counts
    for step in range(4):
        new = {k: text(rnd) for k in [*rnd.sample(range(300), 6), 1000 + step]}
        docs |= new
        held.upsert(frame(spark, new))
        gone = rnd.sample(sorted(docs), 5)
        held.delete(spark.createDataFrame([(g,) for g in [*gone, 99_999]], "doc_id long"))
        docs = {k: t for k, t in docs.items() if k not in gone}
    assert len(held.state["segments"]) <= 3
    assert (held.state["n_docs"], {r.doc for r in held.live().collect()}) == (len(docs), set(docs))
    again = SegmentIndex(spark, f"file://{home}")
    plain = frame(spark, docs).repartition(4).persist()
    for q in QUERIES:
        want = rows(bm25.keyword_topk(plain, q, 12))
        assert rows(again.search(q, 12)) == want, q
    for q in ("apple fig", "the the of", "éclair", "kiwi lime absent"):
        found, report = held.search_pruned(q, 5)
        assert rows(found) == rows(bm25.keyword_topk(plain, q, 5)), q
        assert 0 < report.read <= report.blocks
    with pytest.raises(ValueError):
        held.search_pruned("+apple")
    plain.unpersist()


def test_fewer_blocks_and_few_bytes(spark, tmp_path):
    rnd = random.Random(9)
    docs = {k: text(rnd) for k in range(3000)} | {k: "kiwi lime " * 20 for k in range(0, 3000, 500)}
    home = str(tmp_path / "ix")
    held = SegmentIndex(spark, f"file://{home}", block=16, first=8)
    held.upsert(frame(spark, docs))
    found, report = held.search_pruned("kiwi lime", 3)
    assert rows(found) == rows(bm25.keyword_topk(frame(spark, docs), "kiwi lime", 3))
    assert report.read < report.blocks / 2
    before = size(home)
    held.upsert(frame(spark, {7: "apple and kiwi"}))
    assert size(home) - before < before / 10
    assert rows(held.search("kiwi", 3)) == rows(bm25.keyword_topk(frame(spark, docs | {7: "apple and kiwi"}), "kiwi", 3))


def test_postings_are_read_by_term(spark, tmp_path):
    held = SegmentIndex(spark, f"file://{tmp_path}/ix")
    held.upsert(frame(spark, {1: "of the apple", 2: "pear"}))
    plan = held._hits(held._wanted(bm25_parse('+"of the" -pear')))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term" in plan


def bm25_parse(q):
    from larkspur.operators.query import parse

    return parse(q)


def test_caches_are_read(spark, sf_dir):
    """What is derived from cached rows still reads them when it runs."""
    from larkspur.plans.queries import QUERIES as registered

    for name in ("ngram_bm25", "peer_topk", "federated_topk", "vector_query", "vector_query_snippets"):
        df = registered[name](spark, sf_dir)
        assert "InMemoryTableScan" in df._jdf.queryExecution().executedPlan().toString(), name


def test_blocks_are_inverted_across_batches():
    """A block that two batches share gives one row a term; nothing but whole blocks is held."""
    import pyarrow as pa

    from larkspur.sources.segments import _inverted

    docs = [(0, 7, ["b", "a", "b"]), (1, 1, ["a"]), (1, 2, ["c", "a"]), (1, 3, ["a", "a"]), (2, 9, ["é"])]
    batch = lambda d: pa.RecordBatch.from_arrays([pa.array([x[0] for x in d], "int32"), pa.array([x[1] for x in d]), pa.array([len(x[2]) for x in d], "int32"), pa.array([x[2] for x in d])], ["block", "doc", "dl", "tokens"])
    out = list(_inverted(2.0)(iter([batch(docs[:2]), batch(docs[2:3]), batch(docs[3:])])))
    got = {(r["term"], r["block"]): (r["n"], [(h["doc"], h["dl"], h["at"]) for h in r["hits"]]) for b in out for r in b.to_pylist()}
    assert sum(b.num_rows for b in out) == len(got) == 5
    assert got == {("a", 0): (1, [(7, 3, [1])]), ("b", 0): (1, [(7, 3, [0, 2])]), ("a", 1): (3, [(1, 1, [0]), (2, 2, [1]), (3, 2, [0, 1])]), ("c", 1): (1, [(2, 2, [0])]), ("é", 2): (1, [(9, 1, [0])])}
    tops = {(r["term"], r["block"]): r["top"] for b in out for r in b.to_pylist()}
    assert tops["b", 0] == pytest.approx(2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / 2)))


def test_keyword_postings_are_sorted_in_place(spark, tmp_path):
    """A build neither samples nor shuffles postings; each file is in order of terms."""
    from larkspur.sources import index

    docs = frame(spark, {1: "pear of the apple", 2: "", 3: None, 4: "apple apple fig"}).repartition(2, "doc_id")
    assert "RepartitionByExpression" not in index.by_term(spark.range(3).selectExpr("id doc", "'a' term"))._jdf.queryExecution().optimizedPlan().toString()
    home = index.build_keyword(docs, f"file://{tmp_path}/kw")
    assert [tuple(r) for r in spark.read.parquet(f"{home}/totals").select("n_docs", "total").collect()] == [(4, 7)]
    assert rows(index.search_keyword(spark, f"file://{tmp_path}/kw", "apple fig", 5)) == rows(bm25.keyword_topk(docs, "apple fig", 5))
