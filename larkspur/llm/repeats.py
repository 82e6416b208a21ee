"""Repeated windows across a corpus: what the two exact substring operators share.

A window is the first ``size`` symbols (words, or bytes) of a suffix of one document. Both operators
order suffixes only as far as a window reaches, in groups that fit in memory, and both form those
groups by prefixes of the suffixes whose length varies:

1. ``runs``. A window's *anchor* is, of all ``gram``-symbol strings inside it, the one with the
   smallest hash, the leftmost of equals. Equal windows have equal anchors at equal places, and
   neighbouring windows share theirs, so a *run* of suffixes that share an anchor is one row.
   Anchors that stand once in the corpus have no repeat, and their runs fall away.
2. ``leaves``. Runs with the same symbols are one leaf with a weight (how many runs) and the smallest
   doc_id. They are told apart by salted 128-bit BLAKE2b digests of their bytes. However many
   copies a text has, it is cut out once.
3. Prefixes. Suffixes whose places to their anchor fall into the same stride are dealt out by a prefix
   of the last of them, which all of them hold. With a stride as long as a run that prefix is the
   anchor; a group with more than ``FIT`` rows gets a third of the stride, and so longer prefixes, and so on
   until its parts fit. With a stride of one the prefix is a whole window: such a group is one node, and
   what is asked of it (its weight and smallest doc_id) is an aggregate, however many rows it has.
4. The operator's own method orders the suffixes of each group by their real symbols and says
   which windows are equal. A window's weight and smallest doc_id go back to its leaf, from there to
   each run, and spans are gathered by row.

Anchors, leaves and prefixes with more than one in ``HOT`` of all rows, of which there can't be more than that many, are known by
name before rows are joined: theirs are not shuffled, so none of them makes a hot task.

A row of ``docs`` is known by (doc_id, k), k being a hash of its text: rows that share a doc_id but not
the text are told apart, rows that share both are equal and share their spans.

Nothing is dropped or capped. Texts longer than ``READ`` are read in steps that overlap.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow, drop, durable, gathered

U = np.uint64
#: Rows (leaves, or parts of leaves) under one prefix that are ordered in memory.
FIT = 1024
#: A key with more than one in so many of all runs (and more than HOT_ROWS) is joined without a shuffle.
HOT, HOT_ROWS = 1000, 10_000
#: Bytes of bodies that are ordered at a time, and of texts that are read at a time: a word has several, and a byte is a symbol of its own.
ROOM = {True: 6_000_000, False: 500_000}
READ = {True: 1_000_000, False: 500_000}

RUNS = "h long, e1 long, e2 long, doc_id long, k long, a int, s int, n int"
LEAVES = "g long, h long, e1 long, e2 long, least long, many long, o int, w int, n int, body binary"
MARKS = "h long, e1 long, e2 long, lo int, hi int, low long"
LEAF = ("h", "e1", "e2")
NONE = np.iinfo(np.int64).max  # the doc_id of rows that have none: larger than all others


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of SplitMix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTES = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BASE, _INVERSE = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)
_POWERS: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0..n and those of its inverse, modulo 2^64; kept in the worker."""
    if len(_POWERS[0]) <= n:
        for i, base in enumerate((_BASE, _INVERSE)):
            steps_ = np.full(max(n + 1, 1 << 20), base, U)
            steps_[0] = 1
            _POWERS[i] = np.multiply.accumulate(steps_)
    return _POWERS[0], _POWERS[1]


class Ranges:
    """Hashes of ranges of a symbol sequence, from prefix sums. They choose anchors; no equality rests on them."""

    def __init__(self, symbols: np.ndarray) -> None:
        up, self.down = powers(len(symbols))
        self.sums = np.zeros(len(symbols) + 1, U)
        np.cumsum(symbols * up[: len(symbols)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U))

    def grams(self, n: int) -> np.ndarray:
        m = len(self.sums) - n
        return mix((self.sums[n:] - self.sums[:m]) * self.down[:m] + U(n)) if m > 0 else np.empty(0, U)


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in bytes."""
    blank = np.ones(len(data) + 2, bool)
    blank[1:-1] = BLANK[data]
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    return edge[::2], edge[1::2]


def row_key(text: str = "text") -> Column:
    """64 bits of a text's SHA-256: with the doc_id, they name a row."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, -10).cast("long")


def lowest(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each n neighbours."""
    width = 1
    while 2 * width <= n:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[: len(x) - (n - width)], x[n - width :]) if n > width else x


def _cuts(batches: Iterator[pa.RecordBatch], size: int, of_words: bool, room: int) -> Iterator[list[tuple[int | None, int, int, bytes]]]:
    """Lists of (doc_id, k, place of the first symbol, bytes) of about ``room`` bytes. Words are joined by single blanks; a longer
    text is cut into parts, each of which ends with the ``size`` - 1 symbols that the next begins with, so no window is in two."""
    out: list[tuple[int | None, int, int, bytes]] = []
    held = 0
    for batch in batches:
        for i, k, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "k", "text")), strict=True):
            data = text.encode()
            if of_words:
                data = b" ".join(data.split())
            if len(data) < (2 * size - 1 if of_words else size):
                continue
            if len(data) <= room:
                parts = [(0, data)]
            elif of_words:
                start, end = words(np.frombuffer(data, np.uint8))
                step = max(1, room // 8)
                parts = [(x, data[start[x] : end[min(x + step + size - 1, len(end)) - 1]]) for x in range(0, max(len(start) - size + 1, 0), step)]
            else:
                parts = [(x, data[x : x + room + size - 1]) for x in range(0, len(data) - size + 1, room)]
            for x, part in parts:
                out.append((i, k, x, part))
                held += len(part)
                if held >= room:
                    yield out
                    out, held = [], 0
    if out:
        yield out


def _runs(batches: Iterator[pa.RecordBatch], size: int, gram: int, of_words: bool, salt: bytes, room: int) -> Iterator[pa.RecordBatch]:
    for cut in _cuts(batches, size, of_words, room):
        ids, ks, places, parts = zip(*cut, strict=True)
        raw = b" ".join(parts)
        data = np.frombuffer(raw, np.uint8)
        begin = np.concatenate([[0], np.cumsum([len(x) + 1 for x in parts])])
        coded = BYTES[data]
        if of_words:
            first, last = words(data)
            coded = Ranges(coded).of(first, last)
            begin = np.searchsorted(first, begin)
        length = np.diff(begin) - (not of_words)  # a separator ends each part's bytes
        if not (length >= size).any():
            continue
        grams = Ranges(coded).grams(gram)
        coded = None
        place = lowest((grams >> U(32) << U(32)) | np.arange(len(grams), dtype=U), size - gram + 1)
        many = np.maximum(length - size + 1, 0)
        start = np.arange(many.sum()) + np.repeat(begin[:-1] - (np.cumsum(many) - many), many)
        part = np.repeat(np.arange(len(parts)), many)
        anchor = (place[start] & U(0xFFFFFFFF)).astype(np.int64)
        new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])])
        n = np.diff(np.r_[new, len(anchor)])
        s, a, p = start[new], anchor[new], part[new]
        lo, hi = (first[s], last[s + n - 2 + size]) if of_words else (s, s + n - 1 + size)
        e = np.frombuffer(b"".join([blake2b(raw[x:y], digest_size=16, salt=salt).digest() for x, y in zip(lo.tolist(), hi.tolist(), strict=True)]), np.int64).reshape(-1, 2)
        base = (np.array(places) - begin[:-1])[p]
        of = pa.array(ids, pa.int64()).take(pa.array(p))
        cols = [pa.array(grams[a].view(np.int64)), pa.array(e[:, 0]), pa.array(e[:, 1]), of, pa.array(np.array(ks)[p]), *(pa.array(x.astype(np.int32)) for x in (a + base, s + base, n))]
        yield pa.RecordBatch.from_arrays(cols, ["h", "e1", "e2", "doc_id", "k", "a", "s", "n"])


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    names, types = zip(*(x.split() for x in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows, strict=True), types, strict=True)], list(names))


def _leaves(batches: Iterator[pa.RecordBatch], size: int, of_words: bool) -> Iterator[pa.RecordBatch]:
    """The wanted runs cut out of their texts."""
    for batch in batches:
        out, held = [], 0
        for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
            data = text.encode()
            symbols = data.split() if of_words else data
            for x in wanted:
                body = symbols[x["s"] : x["s"] + x["n"] - 1 + size]
                body = b" ".join(body) if of_words else body
                out.append((x["h"], x["h"], x["e1"], x["e2"], NONE if x["least"] is None else x["least"], x["many"], x["a"] - x["s"], 0, x["n"], body))
                held += len(body)
            if held > 4_000_000:
                yield _batch(out, LEAVES)
                out, held = [], 0
        if out:
            yield _batch(out, LEAVES)


def strides(size: int, gram: int) -> list[int]:
    """Suffixes that are dealt out together: as many as share an anchor, then a third each time, then one."""
    out = [size - gram + 1]
    while out[-1] > 1:
        out.append(max(1, out[-1] // 3))
    return out


def _split(batches: Iterator[pa.RecordBatch], size: int, of_words: bool, stride: int) -> Iterator[pa.RecordBatch]:
    """Rows divided by ``stride``, each under the prefix, of size - stride + 1 symbols, of the last suffix of its stride."""
    names = LEAVES.replace(",", "").split()[::2]
    for batch in batches:
        out = []
        for _, h, e1, e2, least, many, o, w, n, body in zip(*(batch.column(x).to_pylist() for x in names), strict=True):
            symbols = body.split(b" ") if of_words else body
            for j in range((o - w - n + 1) // stride, (o - w) // stride + 1):
                # suffixes of the run from first to last (the anchor is o symbols behind the run's start)
                first, last = max(w, o - (j + 1) * stride + 1), min(w + n - 1, o - j * stride)
                at = o - j * stride - w
                prefix, part = symbols[at : at + size - stride + 1], symbols[first - w : last - w + size]
                if of_words:
                    prefix, part = b" ".join(prefix), b" ".join(part)
                g = xxhash.xxh3_64_intdigest(prefix, (h + j) & 0xFFFFFFFFFFFFFFFF)
                out.append((g - (1 << 64) * (g >> 63), h, e1, e2, least, many, o, first, last - first + 1, part))
            if len(out) > 20_000:
                yield _batch(out, LEAVES)
                out = []
        if out:
            yield _batch(out, LEAVES)


def _groups(batches: Iterator[pa.RecordBatch], room: int) -> Iterator[pa.Table]:
    """Rows of whole groups, about ``room`` bytes of bodies at a time; rows come sorted by group."""
    held: list[pa.RecordBatch] = []
    weight = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        g = batch.column("g").to_numpy()
        ends = np.cumsum(pc.binary_length(batch.column("body")).to_numpy())
        at = 0
        if held and weight > room and held[-1].column("g")[-1].as_py() != g[0]:
            yield pa.Table.from_batches(held)
            held, weight = [], 0
        for cut in (np.flatnonzero(g[1:] != g[:-1]) + 1).tolist():
            here = int(ends[cut - 1] - (ends[at - 1] if at else 0))
            if weight + here > room:
                yield pa.Table.from_batches([*held, batch.slice(at, cut - at)])
                held, weight, at = [], 0, cut
        if at < batch.num_rows:
            held.append(batch.slice(at))
            weight += int(ends[-1] - (ends[at - 1] if at else 0))
    if held:
        yield pa.Table.from_batches(held)


def _marks(batches: Iterator[pa.RecordBatch], size: int, of_words: bool, method: str, room: int, ordered: bool = True) -> Iterator[pa.RecordBatch]:
    """Spans of windows that repeat, by leaf, with the smallest doc_id that the window starts in if that is asked for (``ordered``)."""
    import importlib

    equal: Callable = importlib.import_module(method).equal_windows
    for g in _groups(batches, room):
        bodies = g.column("body").to_pylist()
        n, least, many, w = (g.column(x).to_numpy() for x in ("n", "least", "many", "w"))
        if of_words:
            body = pa.array(b" ".join(bodies).split(b" "), pa.binary()).dictionary_encode().indices.to_numpy()
        else:
            body = np.frombuffer(b"".join(bodies), np.uint8)
        lengths = n - 1 + size
        row = np.repeat(np.arange(len(n)), n)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        ends = np.cumsum(lengths)
        start = (ends - lengths)[row] + within
        prefix = np.unique(g.column("g").to_numpy(), return_inverse=True)[1]
        where, group = equal(body, start, prefix[row], size, ends[row])  # windows that are equal to others here, and a number for each set of equals
        low = least[row]
        repeats = many[row] > 1
        if len(where):
            set_low = np.full(group.max() + 1, NONE)
            np.minimum.at(set_low, group, low[where])
            low[where] = set_low[group]
            repeats[where] = True
        if not ordered:
            low[:] = 0  # so that spans of neighbours are one
        at = np.flatnonzero(repeats)
        if len(at):
            r, x, y = row[at], within[at], low[at]
            new = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (y[1:] != y[:-1]) | (x[1:] - x[:-1] > size)])
            end = np.r_[new[1:], len(at)] - 1
            of = r[new]
            cols = [*(g.column(c).combine_chunks().take(pa.array(of)) for c in LEAF), pa.array((x[new] + w[of]).astype(np.int32)), pa.array((x[end] + w[of] + size).astype(np.int32)), pa.array(y[new])]
            yield pa.RecordBatch.from_arrays(cols, [*LEAF, "lo", "hi", "low"])


def _nodes(rows: DataFrame, size: int) -> DataFrame:
    """Marks of groups whose prefix is a whole window, by an aggregate over the window's bytes, which combines before it shuffles."""
    node = rows.groupBy("body").agg(F.min("least").alias("low"), F.sum("many").alias("weight")).filter("weight > 1")
    return rows.join(node, "body").select(*LEAF, F.col("w").alias("lo"), (F.col("w") + size).alias("hi"), "low")


def covered(docs: DataFrame, size: int, gram: int, of_words: bool, method: str, ordered: bool, fit: int = FIT, room: int | None = None) -> DataFrame:
    """(doc_id, k, spans): spans of symbols covered by windows that repeat, for rows that have any.

    ``ordered``: windows that also start in a document with a smaller doc_id; otherwise windows
    that also start anywhere else. ``docs`` has (doc_id, k, text); spans may overlap.
    """
    spark = docs.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    runs = durable(arrow(docs, _runs, RUNS, size=size, gram=gram, of_words=of_words, salt=os.urandom(16), room=room or READ[of_words]))
    anchors = durable(runs.groupBy("h").count().filter("count > 1"))
    most = max(HOT_ROWS, runs.count() // HOT)
    hot = [r.h for r in anchors.filter(F.col("count") > most).select("h").collect()]  # fewer than HOT
    often = F.col("h").isin(hot) if hot else F.lit(False)
    # outer, from the runs' side: a row for each run, whatever the size of its group
    cold = runs.filter(~often).join(anchors.select("h", F.lit(True).alias("shared")), "h", "left").filter("shared").drop("shared")
    live = durable(runs.filter(often).unionByName(cold))
    drop(runs)
    drop(anchors)
    # first() takes all of a leaf's columns from one run
    leaves = durable(live.groupBy(*LEAF).agg(F.count("*").alias("many"), F.min("doc_id").alias("least"), *(F.first(c).alias(c) for c in ("doc_id", "k", "a", "s", "n"))))
    wanted = leaves.groupBy("doc_id", "k").agg(F.collect_list(F.struct(*LEAF, "many", "least", "a", "s", "n")).alias("wanted"))
    own = docs.alias("x").join(wanted.alias("y"), same_row("x", "y")).select("text", "wanted")
    level = durable(arrow(own, _leaves, LEAVES, size=size, of_words=of_words))
    if level.count() > leaves.count():  # rows that are equal have each cut their leaves out
        twice, level = level, durable(level.dropDuplicates([*LEAF]))
        drop(twice)
    common = [r.e1 for r in leaves.filter(F.col("many") > most).select("e1").distinct().collect()]  # fewer than HOT
    drop(leaves)
    tables, marks = [level], None
    for stride in [*strides(size, gram)[1:], 0]:
        sizes = level.groupBy("g").count().filter(F.col("count") > fit)
        limit = max(fit, level.count() // HOT)
        named = [r.g for r in sizes.filter(F.col("count") > limit).select("g").collect()]  # fewer than HOT
        tagged = level.withColumn("big", F.col("g").isin(named) if named else F.lit(False))
        if limit > fit:  # others, none of which makes a hot task, are found by a join
            others = sizes.filter(F.col("count") <= limit).select("g", F.lit(True).alias("other"))
            tagged = tagged.filter("big").unionByName(tagged.filter("not big").join(others, "g", "left").select(*level.columns, F.coalesce("other", F.lit(False)).alias("big")))
        last = not named and (limit == fit or not sizes.limit(1).count())
        fits = level if last else tagged.filter("not big").drop("big")
        found = arrow(fits.repartition(n, "g").sortWithinPartitions("g"), _marks, MARKS, size=size, of_words=of_words, method=method, room=ROOM[of_words], ordered=ordered)
        marks = found if marks is None else marks.unionByName(found)
        if last:
            break
        rest = tagged.filter("big").drop("big")
        if not stride:
            marks = marks.unionByName(_nodes(rest, size))
            break
        level = durable(arrow(rest, _split, LEAVES, size=size, of_words=of_words, stride=stride))
        tables.append(level)
    marks = durable(marks.groupBy(*LEAF).agg(F.collect_set(F.struct("lo", "hi", "low")).alias("marks")))  # at most one for each suffix of a run
    for t in tables:
        drop(t)
    # a common leaf has at most one mark for each suffix of a run: few enough to be sent to where its runs are
    often = F.col("e1").isin(common) if common else F.lit(False)
    sent = [(r.h, r.e1, r.e2, [(x.lo, x.hi, x.low) for x in r.marks]) for r in marks.filter(often).collect()]
    hit = F.filter("marks", lambda x: x["low"] < F.col("doc_id")) if ordered else F.col("marks")
    each = F.transform(hit, lambda x: F.struct((x["lo"] + F.col("s")).alias("lo"), (x["hi"] + F.col("s")).alias("hi")))
    spans = live.filter(~often).join(marks, [*LEAF], "left").select("doc_id", "k", F.inline(each))
    spans = spans.unionByName(arrow(live.filter(often).select(*LEAF, "doc_id", "k", "s"), _spans, "doc_id long, k long, lo int, hi int", marks=sent, ordered=ordered))
    return spans.groupBy("doc_id", "k").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))


def _spans(batches: Iterator[pa.RecordBatch], marks: list[tuple[int, int, int, list[tuple[int, int, int]]]], ordered: bool) -> Iterator[pa.RecordBatch]:
    """Spans of the runs of a few leaves by their marks; those of a row that touch are one as far as they are in one batch."""
    for b in gathered(batches):
        h, e1, e2, s, k = (b.column(c).to_numpy() for c in (*LEAF, "s", "k"))
        doc = pc.fill_null(b.column("doc_id"), np.iinfo(np.int64).min).to_numpy()
        rows, los, his = [], [], []
        for leaf in marks:
            at = np.flatnonzero((e1 == leaf[1]) & (e2 == leaf[2]) & (h == leaf[0]))
            if len(at):
                lo, hi, low = np.array(leaf[3], np.int64).T
                row, mark = np.repeat(at, len(lo)), np.tile(np.arange(len(lo)), len(at))
                keep = doc[row] > low[mark] if ordered else np.ones(len(row), bool)
                rows.append(row[keep])
                los.append(lo[mark[keep]] + s[row[keep]])
                his.append(hi[mark[keep]] + s[row[keep]])
        if not rows or not sum(map(len, rows)):
            continue
        row, lo, hi = map(np.concatenate, (rows, los, his))
        order = np.lexsort((lo, k[row], doc[row]))
        row, lo, hi = row[order], lo[order], hi[order]
        other = np.r_[True, (doc[row[1:]] != doc[row[:-1]]) | (k[row[1:]] != k[row[:-1]])]
        reach = np.maximum.accumulate(hi + (np.cumsum(other) << 32)) & 0xFFFFFFFF  # the farthest end so far in the row
        new = np.flatnonzero(other | np.r_[True, lo[1:] > reach[:-1]])
        end = np.r_[new[1:], len(row)] - 1
        yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(row[new])) for c in ("doc_id", "k")), pa.array(lo[new].astype(np.int32)), pa.array(reach[end].astype(np.int32))], ["doc_id", "k", "lo", "hi"])


def same_row(x: str, y: str) -> Column:
    return F.col(f"{x}.doc_id").eqNullSafe(F.col(f"{y}.doc_id")) & (F.col(f"{x}.k") == F.col(f"{y}.k"))


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal spans (first symbol, end), in order."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((x["lo"], x["hi"]) for x in spans or ()):
        if out and lo <= out[-1][1]:
            out[-1] = out[-1][0], max(hi, out[-1][1])
        else:
            out.append((lo, hi))
    return out


def outside(spans: list[tuple[int, int]], symbols: list | bytes) -> list:
    """The pieces of ``symbols`` between spans."""
    edges = [0, *(x for s in spans for x in s), len(symbols)]
    return [symbols[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)]
