"""Suffix-array deduplication over bytes by a depth-limited radix sort.

``repeats`` deals suffixes out by prefixes into groups that fit in memory. Here each group's
suffixes are sorted by most-significant-digit passes, only as deep as the threshold of 400 bytes.
Digits are bytes of the text, taken eight at a time as a big-endian number, so their order is the
bytes' own. A pass reads the next digits of the suffixes that are not alone in their bucket; buckets
whose suffixes agree on all of them need no sorting, the others are sorted, and parted where digits
differ. Buckets that are left after the last pass are exactly the repeated windows.

A byte is removed when a 400-byte string that covers it also starts anywhere else, the same
document included; strings are judged on the input.

Defined results: a null or empty text has no bytes; documents shorter than a window lose nothing;
rows that repeat a doc_id, or have none, are documents of their own, and equal rows are each other's repeats, so both lose what
they share; of places that tie none is kept; texts of any length are read in overlapping steps; an empty table gives an empty
table; only the id and the text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import arrow, read, texts
from .repeats import covered, merged, outside, row_key, same_row

WINDOW = 400
#: Bytes of an anchor.
GRAM = 96
#: Bytes that a pass reads: one digit at first, which parts most buckets, then several.
DIGIT, PASS = 8, 32
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def passes(depth: int) -> Iterator[tuple[int, int]]:
    """(place, bytes) of each pass."""
    at = 0
    while at < depth:
        width = min(PASS if at else DIGIT, depth - at)
        yield at, width
        at += width


def radix_sort(body: np.ndarray, start: np.ndarray, bucket: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of suffixes by bucket and then by their first ``depth`` bytes, and where in it a new bucket or value begins."""
    padded = np.r_[body, np.zeros(DIGIT, np.uint8)].astype(np.uint64)
    digit = np.zeros(len(body), np.uint64)  # at each place, the eight bytes from there on
    for i in range(DIGIT):
        digit |= padded[i : i + len(body)] << np.uint64(8 * (DIGIT - 1 - i))
    order = np.argsort(bucket, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = bucket[order[1:]] != bucket[order[:-1]]
    for at, width in passes(depth):
        alone = new & np.r_[new[1:], True]
        live = np.flatnonzero(~alone)
        if not len(live):
            break
        from_ = start[order[live]] + at
        columns = []
        for i in range(0, width, DIGIT):
            x = digit[from_ + i]
            if width - i < DIGIT:  # the last digit has fewer bytes
                x >>= np.uint64(8 * (DIGIT - width + i))
            columns.append(x)
        begins = new[live]
        seg = np.cumsum(begins) - 1
        differs = np.zeros(len(live), bool)
        for x in columns:
            differs[1:] |= x[1:] != x[:-1]
        differs &= ~begins
        uneven = np.flatnonzero(np.bincount(seg, differs)[seg] > 0)
        if not len(uneven):
            continue
        columns, seg, here = [x[uneven] for x in columns], seg[uneven], live[uneven]
        to = np.lexsort((*columns[::-1], seg))
        order[here] = order[here[to]]
        parted = np.zeros(len(here), bool)
        for x in (seg, *columns):
            x = x[to]
            parted[1:] |= x[1:] != x[:-1]
        new[here] |= parted
    return order, new


def equal_windows(body: np.ndarray, start: np.ndarray, prefix: np.ndarray, depth: int, end: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes that share their first ``depth`` bytes with another of their prefix, and each one's bucket."""
    order, new = radix_sort(body, start, prefix, depth)
    many = ~(new & np.r_[new[1:], True])
    return order[many], np.cumsum(new[many]) - 1


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for i, text, spans in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
            data = text.encode()
            gone = merged(spans)
            kept = b"".join(outside(gone, data)) if gone else data
            out.append((i, len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] * 4 + [pa.string()], strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def dedup_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, **options) -> DataFrame:
    """Per document: bytes, removed bytes, removed runs, digest of what is kept."""
    found = texts(docs, id_col, text_col).withColumn("k", row_key())
    spans = covered(found, window, gram, False, __name__, False, **options)
    joined = found.alias("x").join(spans.alias("y"), same_row("x", "y"), "left")
    return arrow(joined.select("x.doc_id", "text", "spans"), _digest, SCHEMA)


def op9_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_bytes(read(spark, sf_dir, "documents"))
