"""A corpus over real files, through changes."""

import os

import pytest

from larkspur.config import Settings
from larkspur.corpus import Corpus, federated_search


def encode(texts):
    return [[float(t.count("apple")), float(t.count("pear")), 1.0] for t in texts]


def names(df):
    return [r.doc.rpartition("/")[2] for r in df.collect()]


def test_corpus_follows_its_files(spark, tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "a.txt").write_text("apple apple pie")
    (folder / "b.txt").write_text("pear tart with apple")
    (folder / "c.txt").write_text("plum")
    corpus = Corpus(spark, f"file://{tmp_path}/home", encode)
    corpus.sync(str(folder))
    assert names(corpus.keyword_search("apple")) == ["a.txt", "b.txt"]
    assert names(corpus.keyword_search("apple -pear")) == ["a.txt"]
    assert names(corpus.vector_search("pear", 1)) == ["b.txt"]
    assert names(corpus.hybrid_search("apple", 5))[0] == "a.txt"
    first = {r.path: r.vec for r in corpus.table("vectors").collect()}
    (folder / "c.txt").write_text("apple now")
    os.utime(folder / "c.txt", (2_000_000_000, 2_000_000_000))
    (folder / "a.txt").unlink()
    (folder / "b.txt").write_text("silent change of apple")  # its time is set back: only a reread sees it
    was = corpus.table("texts").filter("path like '%b.txt'").first().mtime
    os.utime(folder / "b.txt", (was, was))
    corpus.sync(str(folder))
    assert sorted(names(corpus.keyword_search("apple"))) == ["b.txt", "c.txt"] and names(corpus.keyword_search("silent")) == []
    again = {r.path: r.vec for r in corpus.table("vectors").collect()}
    assert len(again) == 2 and all(again[p] == first[p] for p in again if p.endswith("b.txt"))
    corpus.sync(str(folder), reread=True)
    assert names(corpus.keyword_search("silent")) == ["b.txt"] and corpus.table("texts").count() == 2


def test_corpus_refresh_and_encoder_faults(spark, tmp_path):
    def picky(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("cannot")
        return encode(texts)

    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "a.txt").write_text("apple pie")
    (folder / "b.txt").write_text("bad pear")
    corpus = Corpus(spark, f"file://{tmp_path}/home", picky)
    corpus.sync(str(folder))
    assert {r.path.rpartition("/")[2]: r.vec for r in corpus.table("vectors").collect()} == {"a.txt": [1.0, 0.0, 1.0], "b.txt": [0.0] * 3}
    (folder / "c.txt").write_text("new apple apple")
    assert "c.txt" not in names(corpus.vector_search("apple", 3))
    assert "c.txt" in names(corpus.vector_search("apple", 3, refresh=str(folder))) and "c.txt" in names(corpus.keyword_search("new"))
    assert names(corpus.hybrid_search("bad", 1)) == ["b.txt"]
    before = {x for x in os.listdir(tmp_path / "home/index") if len(x) == 32}
    for _ in range(2):
        corpus.sync(str(folder))
    assert {x for x in os.listdir(tmp_path / "home/index") if len(x) == 32} <= before  # nothing has changed, and nothing is written


def test_corpus_without_encoder(spark, tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "a.txt").write_text("apple pie")
    (folder / "blank.txt").write_text("  ")
    corpus = Corpus(spark, f"file://{tmp_path}/home")
    corpus.sync(str(folder))
    assert names(corpus.hybrid_search("apple")) == ["a.txt"]
    with pytest.raises(ValueError):
        corpus.vector_search("apple")
    assert [(r.peer, r.doc.rpartition("/")[2]) for r in federated_search({"me": corpus, "you": corpus}, "apple", "me").collect()] == [("me", "a.txt"), ("you", "a.txt")]


def test_settings():
    s = Settings.of({"index_interval_s": "4", "persist_interval_s": "60", "bm25_ngram": "9", "remote_scope_public": "0", "topic": "bad topic", "max_transmit_bytes": "x"})
    assert (s.index_interval_s, s.persist_interval_s, s.bm25_ngram, s.remote_scope_public, s.topic, s.max_transmit_bytes) == (30, 60, 6, False, "documents", 1 << 20)
