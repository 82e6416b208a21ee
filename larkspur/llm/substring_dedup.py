"""Substring deduplication over words by prefix-partitioned suffix trees.

``repeats`` deals the corpus' suffixes out by prefixes of varying length into groups that fit in
memory. Here each group's subtree is built: suffixes are ranked by their first 1, 2, 4, ... words until the
window's 50, the ranks give their order and how many words neighbours share, and leaves whose
neighbours share 50 words or more are under one internal node. Its depth is how much all of its leaves
share: a maximal repeat, and its leaves are where that starts.

A word is removed when a 50-word window that covers it also starts in a document with a smaller
doc_id; windows are judged on the input.

Defined results: a null or empty text has no words and loses none; documents shorter than a window
lose nothing; rows that repeat a doc_id are documents of their own, none of which is smaller than the others, and equal rows
lose the same words; a null doc_id is not smaller than any and has none smaller, so such rows lose nothing and cost others nothing; of
documents that tie in a window the one with the smallest doc_id keeps it; texts of any length are read in
overlapping steps; an empty table gives an empty table; columns besides the id and the text are
not read by ``dedup_words``, and kept, whatever their names, by ``rewrite_words``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, fresh, read, texts
from .repeats import covered, merged, outside, row_key, same_row

WINDOW = 50
#: Words of an anchor.
GRAM = 12
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def subtree(body: np.ndarray, start: np.ndarray, prefix: np.ndarray, depth: int, end: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Leaves in the order of their first ``depth`` words within each prefix group, and how many first words each shares with the
    leaf before it (-1 between groups): all that lie before both leaves' ``end``, or ``depth``."""
    end = start + depth if end is None else end
    levels = [np.unique(body, return_inverse=True)[1].astype(np.int64)]
    width = 1
    while 2 * width <= depth:  # ranks of the first 2, 4, ... words from ranks of the halves
        half = levels[-1]
        pair = half[:-width] * (int(half.max(initial=0)) + 1) + half[width:]
        levels.append(np.unique(pair, return_inverse=True)[1])
        width *= 2
    first, last = levels[-1][start], levels[-1][start + depth - width]
    order = np.lexsort((last, first, prefix))
    if not len(order):
        return order, np.empty(0, np.int64)
    full = (first[order[1:]] == first[order[:-1]]) & (last[order[1:]] == last[order[:-1]])
    room = np.minimum((end - start)[order[1:]], (end - start)[order[:-1]])
    shared = np.where(full, depth, 0)
    a, b = start[order[:-1]] + shared, start[order[1:]] + shared
    top = len(levels) - 1
    for k in [*[top] * (int(room.max(initial=0)) >> top), *range(top - 1, -1, -1)]:  # what is shared, from its binary digits
        x, y = np.minimum(a, len(levels[k]) - 1), np.minimum(b, len(levels[k]) - 1)
        fits = (levels[k][x] == levels[k][y]) & (shared + (1 << k) <= room)
        a += fits << k
        b += fits << k
        shared += fits << k
    shared[prefix[order[1:]] != prefix[order[:-1]]] = -1
    return order, np.r_[-1, shared]


def nodes(shared: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The topmost internal nodes of at least ``depth`` words: first leaf, number of leaves, and depth, which is the length of a maximal repeat."""
    deep = np.r_[shared >= depth, False]
    first = np.flatnonzero(~deep[:-1] & deep[1:])
    end = np.flatnonzero(deep[:-1] & ~deep[1:]) + 1
    if not len(first):
        return first, first, first
    low = np.minimum.reduceat(np.where(deep[:-1], shared, np.iinfo(np.int64).max), first)  # up to the next node's first leaf, where nothing is deep
    return first, end - first, low


def equal_windows(body: np.ndarray, start: np.ndarray, prefix: np.ndarray, depth: int, end: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Leaves under internal nodes of at least ``depth`` words, and a number for each such node."""
    order, shared = subtree(body, start, prefix, depth, end)
    first, many, _ = nodes(shared, depth)
    leaf = np.arange(many.sum()) + np.repeat(first - (np.cumsum(many) - many), many)
    return order[leaf], np.repeat(np.arange(len(first)), many)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for i, text, spans in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
            words = text.encode().split()
            kept = [*chain.from_iterable(outside(merged(spans), words))] if spans else words
            out.append((i, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] * 3 + [pa.string()], strict=True)], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def _rewrite(batches: Iterator[pa.RecordBatch], text_col: str, spans_col: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at = b.schema.get_field_index(text_col)
        new = []
        for text, spans in zip(b.column(at).to_pylist(), b.column(spans_col).to_pylist(), strict=True):
            if spans:
                text = b" ".join(chain.from_iterable(outside(merged(spans), text.encode().split()))).decode()
            new.append(text)
        b = b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))
        yield b.drop_columns([spans_col])


def repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, **options) -> DataFrame:
    """(doc_id, k, spans of word places to remove), for rows that have any; k is ``row_key`` of the text."""
    return covered(texts(docs, id_col, text_col).withColumn("k", row_key()), window, gram, True, __name__, True, **options)


def dedup_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per document: words, removed words, digest of what is kept."""
    spans = repeated_words(docs, id_col, text_col, **options)
    found = texts(docs, id_col, text_col).withColumn("k", row_key())
    joined = found.alias("x").join(spans.alias("y"), same_row("x", "y"), "left")
    return arrow(joined.select("x.doc_id", "text", "spans"), _digest, SCHEMA)


def rewrite_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The same rows and columns; where words are removed, the others joined by single spaces."""
    key, mark, name = fresh(docs, "span_id"), fresh(docs, "span_key"), fresh(docs, "spans")
    spans = repeated_words(docs, id_col, text_col, **options).select(F.col("doc_id").alias(key), F.col("k").alias(mark), F.col("spans").alias(name))
    own = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(key)) & (row_key(f"`{text_col}`") == F.col(mark))
    return arrow(docs.join(spans, own, "left").drop(key, mark), _rewrite, docs.schema, text_col=text_col, spans_col=name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_words(read(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: repeated passages removed, n_chars follows the text."""
    return rewrite_words(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)
