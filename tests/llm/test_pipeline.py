"""The pipeline against its stages done plainly."""

import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline
from larkspur.llm import pii

from .helpers import frame
from .test_groups import jaccard_groups


def test_stages_keep_columns_and_edges(spark, sf_dir, tmp_path):
    docs = frame(spark, [(1, None), (2, ""), (3, "Plain words stand here, x@y.zz too."), (3, "Plain words stand here, x@y.zz too."), (None, "Nobody knows me.")])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        assert out.count() >= 1
        assert stage(spark, docs.filter("false"), sf_dir).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == 5


def brute_pipeline(docs, good):
    """(doc_id, piece) -> (length, crc32) for what stays of ``docs`` (id -> text), of which the classifier keeps ``good``."""
    texts = {i: t for i, t in docs.items() if i in good}
    whole = jaccard_groups(list(texts.items()))
    texts = {i: t for i, t in texts.items() if whole[i] == i}
    first, gone = {}, {}
    words = {i: (t or "").encode().split() for i, t in texts.items()}
    for i, w in words.items():
        for k in range(len(w) - 49):
            first[tuple(w[k : k + 50])] = min(first.get(tuple(w[k : k + 50]), i), i)
    for i, w in words.items():
        gone[i] = {p for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for p in range(k, k + 50)}
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    out = {}
    for i, text in texts.items():
        if gone[i]:
            text = b" ".join(x for k, x in enumerate(words[i]) if k not in gone[i]).decode()
        ids = np.array([*t.encode(pii.masked(text or ""), add_special_tokens=False).ids, 1], "<u4")
        for k in range(0, len(ids), 4096):
            out[i, k // 4096] = (len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes()))
    return out, sum(map(bool, gone.values()))


def test_pipeline_equals_brute_force(spark, sf_dir):
    raw = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = {r.doc_id: r.text for r in raw.select("doc_id", "text").collect()}
    good = {r.doc_id for r in corpus_pipeline.STAGES[0][1](spark, raw, sf_dir).collect()}
    want, changed = brute_pipeline(docs, good)
    assert changed > 0
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert {(r.doc_id, r.piece): (r.length, r.ids_crc32) for r in rows} == want
    assert len(rows) == len(want)


def test_pipeline_on_few_rows(spark, sf_dir, tmp_path):
    """Nulls, repeated rows and clashing columns; and no rows at all."""
    rows = [(1, None), (2, ""), (3, "Plain words stand here, x@y.zz too."), (3, "Plain words stand here, x@y.zz too."), (None, "Nobody knows me.")]
    for name, docs in (("some", frame(spark, rows)), ("none", frame(spark, rows).filter("false"))):
        spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/some").collect()
    assert {r.doc_id for r in out} <= {1, 2, 3, None} and all(r.length >= 1 for r in out)
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
