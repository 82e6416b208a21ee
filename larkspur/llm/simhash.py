"""SimHash near-duplicates through a vantage-point tree.

A fingerprint is the bitwise majority of XXH64 over 3-word shingles. Equal fingerprints are one
node from the start. A vantage-point tree, whose top is built from a bounded sample, partitions the
nodes by Hamming distance: a node's *home* is one leaf, and it also visits each later leaf that the
triangle bounds cannot rule out (those whose boundary it stands within 3 bits of). Two fingerprints
within 3 bits of each other thus meet in the later of their homes. Leaves that hold more than a task should are
divided in rounds, each by a subtree from a bounded sample of its own rows. In a leaf the search goes on in
memory by rings around further vantage points, and pairs that remain are compared bit by bit, so
the links are exact.

A leaf returns a spanning forest of its links instead of all pairs; links across leaves are joined
by distributed star rounds (``components``). On fingerprints that are far apart at random, a
boundary of 3 bits holds about half of a leaf's nodes, so the number of visits grows as about 1.55
to the power of the depth: that is the price of the method, and of exactness.

Defined results: a null or empty text has fingerprint zero, linked like any other; a text of any length is read whole, its
shingles' bits being summed in steps; texts that tie
share a component; rows that repeat a doc_id each have a row, those without one belong to a component but don't name it; an empty table gives an empty table;
only the id and the text are read, and ``keep_one`` keeps all columns, whatever their names.

The pipeline's stage is ``keep_similar``: it links texts whose sets of 5-word shingles have a Jaccard
similarity of 0.8 or more. Equal texts are one node; a fingerprint of 128 bits and a radius of 34 find
candidates in the same tree, within bands of set sizes that can reach 0.8. Whatever candidates connect is
one neighbourhood; its texts are fetched once, large neighbourhoods are divided into pairs of blocks,
and in them the candidates are held against the exact similarity of their shingles (as 64-bit hashes).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow, durable, fresh, gathered, lookup, read, steps, texts
from .components import components
from .repeats import mix, words

#: Differing bits up to which fingerprints link.
BITS = 3
#: Words of a shingle.
SHINGLE = 3
#: Words of a shingle, bits of difference and Jaccard similarity (4/5) of the pipeline's stage. At 0.8, 19.4 of
#: 128 bits differ on average, with a deviation of 4.1.
STAGE_SHINGLE, STAGE_BITS, SIMILAR = 5, 34, (4, 5)
#: Texts and shingles, at most, of a block that is compared in memory.
MEMBERS, SHINGLES = 2048, 1_000_000
#: Nodes of a leaf that the tree aims at.
LEAF = 16_384
#: Fingerprints, at most, that the tree's top is built from on the driver.
SAMPLE = 8192
#: Hashes whose bits are summed at once.
BITS_AT_ONCE = 1 << 20
#: Rows of a leaf that its subtree is built from, and the subtree's greatest depth.
LEAF_SAMPLE, LEAF_DEPTH = 1024, 6
#: Pairs that are compared at once in memory.
BLOCK = 1_000_000


def fingerprints(batch: list[str], shingle: int = SHINGLE) -> np.ndarray:
    """Unsigned 64-bit fingerprints of texts."""
    digest = xxhash.xxh64_intdigest
    out = np.zeros(len(batch), np.uint64)
    hashes: list[int] = []
    which, first = [], []
    for i, text in enumerate(batch):
        found = text.encode().lower().split()
        if not found:
            continue
        which.append(i)
        first.append(len(hashes))
        if len(found) <= shingle:
            hashes.append(digest(b" ".join(found), 42))
            continue
        line = b" ".join(found)
        at = words(np.frombuffer(line, np.uint8))
        hashes += [digest(line[a:b], 42) for a, b in zip(at[0].tolist(), at[1][shingle - 1 :].tolist(), strict=False)]
    if not which:
        return out
    begin = np.array(first)
    many = np.diff(np.r_[begin, len(hashes)])
    ones = np.zeros((len(begin), 64), np.int64)
    held = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    for at in range(0, len(held), BITS_AT_ONCE):  # a text may reach over several steps
        bits = np.unpackbits(held[at : at + BITS_AT_ONCE], axis=1, bitorder="little")
        from_ = np.searchsorted(begin, at, side="right") - 1
        to = np.searchsorted(begin, at + len(bits))
        ones[from_:to] += np.add.reduceat(bits, np.maximum(begin[from_:to] - at, 0), axis=0, dtype=np.int64)
    out[which] = np.packbits(2 * ones > many[:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def _fingerprint(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for ids, found in steps(batches):
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fingerprints(found, shingle).view(np.int64))], ["doc_id", "fp"])


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints whose words lie along the last axis."""
    return sum(np.bitwise_count(a[..., k] ^ b[..., k]) for k in range(1, a.shape[-1])) + np.bitwise_count(a[..., 0] ^ b[..., 0])


def _worded(fp: np.ndarray) -> np.ndarray:
    return fp[:, None] if fp.ndim == 1 else fp


def tree(sample: np.ndarray, depth: int) -> list[tuple[np.ndarray, int] | None]:
    """Vantage points and median radii of a full binary tree in heap order; None where the sample can't part its points."""
    sample = _worded(sample)
    out: list[tuple[np.ndarray, int] | None] = [None] * ((1 << depth) - 1)
    held = {0: sample}
    for node in range(len(out)):
        points = held.pop(node, sample[:0])
        if len(points) < 4:
            continue
        d = apart(points, points[0])
        radius = int(np.median(d[1:]))
        near, far = points[1:][d[1:] <= radius], points[1:][d[1:] > radius]
        if len(near) and len(far):
            out[node] = points[0], radius
            held[2 * node + 1], held[2 * node + 2] = near, far
    return out


def route(fp: np.ndarray, top: list[tuple[np.ndarray, int] | None], bits: int, at_home: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, home): the home leaf of each fingerprint and the later leaves it visits; one that isn't at home here visits all that it may reach."""
    fp = _worded(fp)
    row, node = np.arange(len(fp)), np.zeros(len(fp), np.int64)
    home = np.ones(len(fp), bool) if at_home is None else at_home.copy()
    while True:
        inner = node < len(top)
        if not inner.any():
            break
        parts = [(row[~inner], node[~inner], home[~inner])]
        for n in np.unique(node[inner]).tolist():
            at = node == n
            r, h = row[at], home[at]
            if top[n] is None:  # nothing to part: all go left
                parts.append((r, np.full(len(r), 2 * n + 1), h))
                continue
            d = apart(fp[r], top[n][0]).astype(np.int64)
            near, far = d - bits <= top[n][1], d + bits > top[n][1]
            own = d <= top[n][1]
            parts += [(r[near], np.full(near.sum(), 2 * n + 1), (h & own)[near]), (r[far], np.full(far.sum(), 2 * n + 2), (h & ~own)[far])]
        row, node, home = (np.concatenate(x) for x in zip(*parts, strict=True))
    first = np.zeros(len(fp), np.int64)
    first[row[home]] = node[home]
    keep = node >= first[row]
    return row[keep], node[keep], home[keep]


def _route(batches: Iterator[pa.RecordBatch], top: list, bits: int) -> Iterator[pa.RecordBatch]:
    for b in gathered(batches):
        fp = b.column("fp").to_numpy()
        row, leaf, home = route(fp.view(np.uint64), top, bits)
        yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(home), pa.array(fp[row])], ["leaf", "home", "fp"])


def near(stored: np.ndarray, asking: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (into stored, into asking) within ``bits``, by rings around vantage points; every pair exactly once."""
    stored, asking = _worded(stored), _worded(asking)
    todo = [(np.arange(len(stored)), np.arange(len(asking)), 0)]
    while todo:
        s, q, depth = todo.pop()
        if not len(s) or not len(q):
            continue
        if len(s) * len(q) <= BLOCK or depth >= 8:
            wide = max(1, BLOCK // len(q))
            for i in range(0, len(s), wide):
                x, y = np.nonzero(apart(stored[s[i : i + wide], None], asking[q]) <= bits)
                yield s[i + x], q[y]
            continue
        point = stored[s[(7919 * (depth + 1)) % len(s)]]
        ds, dq = apart(stored[s], point).astype(np.int64), apart(asking[q], point).astype(np.int64)
        for ring in np.unique(ds).tolist():
            todo.append((s[ds == ring], q[np.abs(dq - ring) <= bits], depth + 1))


def forest(pairs: Iterator[tuple[np.ndarray, np.ndarray]], n: int, linked: Callable[[int, int], bool] | None = None) -> list[tuple[int, int]]:
    """Pairs of numbers under n that keep the connectivity of all pairs, or of those that are ``linked``."""
    if linked is None:
        return spanning(pairs, n)
    up = list(range(n))
    out = []
    for xs, ys in pairs:
        for x, y in zip(xs.tolist(), ys.tolist(), strict=True):
            a, b = x, y
            while up[a] != a:
                up[a] = a = up[up[a]]
            while up[b] != b:
                up[b] = b = up[up[b]]
            if a != b and linked(x, y):
                up[max(a, b)] = min(a, b)
                out.append((x, y))
    return out


def spanning(pairs: Iterator[tuple[np.ndarray, np.ndarray]], n: int) -> list[tuple[int, int]]:
    """``forest`` without a test: whole arrays of pairs at a time. A root is hooked to a smaller one, by one of its pairs a turn."""
    up = np.arange(n)
    out: list[tuple[int, int]] = []
    for x, y in pairs:
        while len(x):
            a, b = up[x], up[y]
            apart_ = a != b
            x, y, a, b = x[apart_], y[apart_], a[apart_], b[apart_]
            high, first = np.unique(np.maximum(a, b), return_index=True)
            up[high] = np.minimum(a, b)[first]
            out += zip(x[first].tolist(), y[first].tolist(), strict=True)
            while not np.array_equal(up, up[up]):
                up = up[up]
    return out


def _links(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    def solve(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        home = np.concatenate([b.column("home").to_numpy(zero_copy_only=False) for b in rows])
        fp = np.concatenate([b.column("fp").to_numpy() for b in rows])
        stored = np.flatnonzero(home)
        asking = np.arange(len(fp))

        def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for x, y in near(fp[stored].view(np.uint64), fp.view(np.uint64), bits):
                x = stored[x]
                once = (x < y) | ~home[y]
                yield x[once], asking[y[once]]

        found = np.array(forest(pairs(), len(fp)), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(fp[found[:, 0]]), pa.array(fp[found[:, 1]])], ["u", "v"])

    yield from map(solve, leaves(batches))


def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """The rows of each leaf, from rows sorted by ``leaf``."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        leaf = b.column("leaf").to_numpy()
        cuts = [0, *(np.flatnonzero(leaf[1:] != leaf[:-1]) + 1).tolist(), len(leaf)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if j > i:
                if held and held[-1].column("leaf")[0].as_py() != leaf[i]:
                    yield held
                    held = []
                held.append(b.slice(i, j - i))
    if held:
        yield held


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A subtree for each leaf from its sample: vantage points, radii (-1: none), as arrays in heap order."""
    for rows in leaves(batches):
        fp = np.concatenate([b.column("fp").to_numpy() for b in rows]).view(np.uint64)
        depth = int(rows[0].column("depth")[0].as_py())
        nodes = tree(fp, depth)
        points = [0 if x is None else int(x[0][0]) for x in nodes]
        radii = [-1 if x is None else x[1] for x in nodes]
        yield pa.RecordBatch.from_arrays([*(rows[0].column(c).slice(0, 1) for c in ("leaf", "size")), pa.array([np.array(points, np.uint64).view(np.int64)], pa.list_(pa.int64())), pa.array([radii], pa.list_(pa.int32()))], ["leaf", "size", "points", "radii"])


def _divide(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Rows of large leaves, each with its leaf's subtree, to that subtree's leaves."""
    for b in gathered(batches, 20_000):
        leaf, home, fp = b.column("leaf").to_numpy(), b.column("home").to_numpy(zero_copy_only=False), b.column("fp").to_numpy()
        for k in np.unique(leaf).tolist():
            at = np.flatnonzero(leaf == k)
            points, radii = (np.array(b.column(c)[int(at[0])].as_py()) for c in ("points", "radii"))
            top = [None if r < 0 else (p, int(r)) for p, r in zip(points.astype(np.int64).view(np.uint64).reshape(-1, 1), radii, strict=True)]
            row, node, own = route(fp[at].view(np.uint64), top, bits, home[at])
            named = mix(mix(np.array([k], np.int64).view(np.uint64)) + node.astype(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(named), pa.array(own), pa.array(fp[at][row]), b.column("size").take(pa.array(at[row]))], ["leaf", "home", "fp", "was"])


def divided(routed: DataFrame, bits: int, leaf: int) -> DataFrame:
    """``routed`` (leaf, home, fp) with leaves of at most about ``leaf`` rows, but for those that vantage points part no further."""
    done, rows = [], durable(routed.withColumn("was", F.lit(None).cast("long")))
    while True:
        sizes = rows.groupBy("leaf").agg(F.count("*").alias("size"), F.max("was").alias("was"))
        # what stands near a boundary goes to both sides, so a level leaves about three quarters of a leaf's rows in each
        depth = F.least(F.lit(LEAF_DEPTH), F.ceil(2.6 * F.log2(F.col("size") / leaf))).cast("int")
        sizes = sizes.filter(F.col("size") > leaf).filter("was is null or size < 0.95 * was").select("leaf", "size", depth.alias("depth"))
        if not sizes.limit(1).count():
            return reduce(DataFrame.unionByName, [*done, rows]).drop("was")
        nth = F.row_number().over(Window.partitionBy("leaf").orderBy(F.xxhash64("fp"), "fp"))
        some = rows.join(sizes, "leaf").withColumn("nth", nth).filter(F.col("nth") <= LEAF_SAMPLE).select("leaf", "size", "depth", "fp")
        n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
        made = arrow(some.repartition(n, "leaf").sortWithinPartitions("leaf"), _subtrees, "leaf long, size long, points array<long>, radii array<int>")
        # where the root parts nothing a leaf stays as it is
        made = durable(made.filter("radii[0] >= 0"))
        done.append(rows.join(made.select("leaf"), "leaf", "left_anti"))
        rows = durable(arrow(rows.drop("was").join(made, "leaf"), _divide, "leaf long, home boolean, fp long, was long", bits=bits))


def link(nodes: DataFrame, bits: int = BITS, leaf: int = LEAF) -> DataFrame:
    """(u, v): links that connect whatever fingerprints (distinct ``fp``) are within ``bits`` of each other."""
    spark = nodes.sparkSession
    depth, many = 0, nodes.count()
    while leaf << depth < many and SAMPLE >> depth > 4:
        depth += 1
    sample = [r[0] for r in nodes.orderBy(F.xxhash64("fp")).limit(SAMPLE).collect()] if depth else []
    top = tree(np.array(sample, np.int64).view(np.uint64), depth)
    routed = arrow(nodes.select("fp"), _route, "leaf long, home boolean, fp long", top=top, bits=bits)
    routed = divided(routed, bits, 4 * leaf)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    return arrow(routed.repartition(n, "leaf").sortWithinPartitions("leaf"), _links, "u long, v long", bits=bits)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, shingle: int = SHINGLE, leaf: int = LEAF) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row."""
    prints = durable(arrow(texts(docs, id_col, text_col), _fingerprint, "doc_id long, fp long", shingle=shingle))
    nodes = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    joined = components(link(nodes.select("fp"), bits, leaf)).withColumnRenamed("node", "fp")
    nodes = nodes.join(joined, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = nodes.join(least, "component").select("fp", "component_id")
    return lookup(prints, named, ["fp"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows whose doc_id is their component's smallest, with all columns; rows without a doc_id can't be told apart and stay."""
    mark = fresh(docs, "kept_id")
    kept = near_duplicates(docs, id_col, text_col, **options).filter("doc_id = component_id").select(F.col("doc_id").alias(mark)).distinct()
    own = F.col(f"`{id_col}`")
    return docs.join(kept, own == F.col(mark), "left").filter(own.isNull() | F.col(mark).isNotNull()).drop(mark)


def shingles(text: str, size: int) -> tuple[int, np.ndarray]:
    """Hash of a text's words, and two 64-bit hashes of each distinct shingle, sorted by the first."""
    found = text.encode().lower().split()
    line = b" ".join(found)
    whole = int(np.array(xxhash.xxh3_64_intdigest(line), np.uint64).view(np.int64))
    if len(found) <= size:
        pieces = [line] if found else []
    else:
        at = words(np.frombuffer(line, np.uint8))
        pieces = [line[a:b] for a, b in zip(at[0].tolist(), at[1][size - 1 :].tolist(), strict=False)]
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, pieces)), "<u8").reshape(-1, 2)
    return whole, both[np.unique(both[:, 0], return_index=True)[1]]


def _sketch(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for ids, found in steps(batches):
        node, many, fp = [], [], np.zeros((len(ids), 2), np.uint64)
        for i, text in enumerate(found):
            whole, both = shingles(text, size)
            node.append(whole)
            many.append(max(len(both), 1))
            if len(both):
                ones = np.zeros(128, np.int64)
                for k in range(0, len(both), 65_536):
                    ones += np.unpackbits(both[k : k + 65_536].view(np.uint8), axis=1).sum(0, dtype=np.int64)
                fp[i] = np.packbits(2 * ones > len(both)).view(np.uint64)
        cols = [pa.array(ids, pa.int64()), pa.array(node, pa.int64()), pa.array(many, pa.int64()), pa.array(fp[:, 0].view(np.int64)), pa.array(fp[:, 1].view(np.int64))]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "node", "size", "fp", "fp2"])


def _prints(rows: list[pa.RecordBatch] | pa.RecordBatch) -> np.ndarray:
    rows = rows if isinstance(rows, list) else [rows]
    return np.concatenate([np.c_[b.column("fp").to_numpy(), b.column("fp2").to_numpy()] for b in rows]).view(np.uint64)


def _bands(batches: Iterator[pa.RecordBatch], top: list, depths: dict[int, int], bits: int) -> Iterator[pa.RecordBatch]:
    """Rows at home in a leaf of their size's band, and visits to later leaves of it and to those of the next band."""
    for b in gathered(batches):
        fp, band = _prints(b), b.column("band").to_numpy()
        parts = []
        for k in np.unique(band).tolist():
            at = np.flatnonzero(band == k)
            row, leaf, home = route(fp[at], top[: (1 << depths[k]) - 1], bits)
            parts.append((at[row], (k << 32) + leaf, home))
            if k + 1 in depths:
                n = 1 << depths[k + 1]
                parts.append((np.repeat(at, n), ((k + 1) << 32) + np.tile(np.arange(n - 1, 2 * n - 1), len(at)), np.zeros(len(at) * n, bool)))
        row, leaf, home = (np.concatenate(x) for x in zip(*parts, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(home), *(b.column(c).take(pa.array(row)) for c in ("node", "size", "fp", "fp2"))], ["leaf", "home", "node", "size", "fp", "fp2"])


def reach(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can be similar."""
    p, q = SIMILAR
    return q * np.minimum(a, b) >= p * np.maximum(a, b)


def _candidates(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for rows in leaves(batches):
        home = np.concatenate([b.column("home").to_numpy(zero_copy_only=False) for b in rows])
        node, many = (np.concatenate([b.column(c).to_numpy() for b in rows]) for c in ("node", "size"))
        fp = _prints(rows)
        stored = np.flatnonzero(home)

        def pairs(home=home, many=many, fp=fp, stored=stored) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for x, y in near(fp[stored], fp, bits):
                x = stored[x]
                once = ((x < y) | ~home[y]) & reach(many[x], many[y])
                yield x[once], y[once]

        found = np.array(forest(pairs(), len(fp)), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(node[found[:, 0]]), pa.array(node[found[:, 1]])], ["u", "v"])


def _nodes(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for _, found in steps(batches):
        yield pa.RecordBatch.from_arrays([pa.array([shingles(t, size)[0] for t in found], pa.int64()), pa.array(found, pa.string())], ["node", "text"])


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two arrays of distinct numbers have a Jaccard similarity of ``SIMILAR`` or more."""
    p, q = SIMILAR
    both = np.sort(np.concatenate([a, b]), kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return q * common >= p * (len(a) + len(b) - common)


def _verified(batches: Iterator[pa.RecordBatch], size: int, bits: int) -> Iterator[pa.RecordBatch]:
    for rows in leaves(batches):
        table = pa.Table.from_batches(rows)
        block, left, right = (table.column(c).to_numpy() for c in ("block", "left", "right"))
        node, many = table.column("node").to_numpy(), table.column("size").to_numpy()
        pair = left * (1 << 31) + right
        fp = _prints(rows)
        comp = table.column("component").to_numpy()
        order = np.lexsort((pair, comp))
        cuts = np.flatnonzero((comp[order][1:] != comp[order][:-1]) | (pair[order][1:] != pair[order][:-1])) + 1
        for members in np.split(order, cuts):
            held = {int(i): shingles(table.column("text")[int(i)].as_py(), size)[1][:, 0].copy() for i in members}
            first = members[block[members] == left[members]]
            second = members[block[members] == right[members]]
            inside = left[members[0]] == right[members[0]]

            def pairs(first=first, second=second, inside=inside) -> Iterator[tuple[np.ndarray, np.ndarray]]:
                for x, y in near(fp[first], fp[second], bits):
                    d = apart(fp[first[x]], fp[second[y]])
                    ok = reach(many[first[x]], many[second[y]]) & ((x < y) | (not inside))
                    x, y, d = first[x[ok]], second[y[ok]], d[ok]
                    best = np.argsort(d, kind="stable")
                    yield x[best], y[best]

            found = np.array(forest(pairs(), len(node), lambda x, y, held=held: similar(held[x], held[y])), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(node[found[:, 0]]), pa.array(node[found[:, 1]])], ["u", "v"])


def similar_links(docs: DataFrame, nodes: DataFrame, leaf: int = LEAF, members: int = MEMBERS) -> DataFrame:
    """(u, v): links that connect whatever candidates among ``nodes`` are similar; ``docs`` has (doc_id, text)."""
    spark = docs.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    # a step of more than 5/4, so that rounding can't part similar sizes by two bands
    banded = nodes.withColumn("band", F.floor(F.log("size") / F.lit(math.log(1.26))))
    depths = {r.band: max(math.ceil(math.log2(r["count"] / leaf)), 0) for r in banded.groupBy("band").count().collect()}
    depth = max(depths.values(), default=0)
    sample = [tuple(r) for r in nodes.select("fp", "fp2").orderBy(F.xxhash64("node")).limit(SAMPLE).collect()] if depth else []
    top = tree(np.array(sample, np.int64).reshape(-1, 2).view(np.uint64), depth)
    routed = arrow(banded.select("node", "size", "fp", "fp2", "band"), _bands, "leaf long, home boolean, node long, size long, fp long, fp2 long", top=top, depths=depths, bits=STAGE_BITS)
    close = arrow(routed.repartition(n, "leaf").sortWithinPartitions("leaf"), _candidates, "u long, v long", bits=STAGE_BITS)
    found = durable(components(close).join(nodes.select("node", "size", "fp", "fp2"), "node"))
    blocks = F.ceil(F.greatest(F.count("*") / F.lit(members), F.sum("size") / F.lit(SHINGLES))).alias("n_blocks")
    found = found.join(found.groupBy("component").agg(blocks), "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("n_blocks")))
    whole = arrow(docs, _nodes, "node long, text string", size=STAGE_SHINGLE)
    whole = whole.join(found.select("node"), "node", "left_semi").groupBy("node").agg(F.min("text").alias("text"))
    spread = found.join(whole, "node").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
    spread = spread.withColumn("left", F.least("block", "other")).withColumn("right", F.greatest("block", "other"))
    spread = spread.withColumn("leaf", F.xxhash64("component", "left", "right")).select("leaf", "component", "left", "right", "block", "node", "size", "fp", "fp2", "text")
    return arrow(spread.repartition(n, "leaf").sortWithinPartitions("leaf"), _verified, "u long, v long", size=STAGE_SHINGLE, bits=STAGE_BITS)


def keep_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows whose doc_id is the smallest of those that similar texts connect, with all columns; rows without a doc_id stay."""
    found = texts(docs, id_col, text_col)
    prints = durable(arrow(found, _sketch, "doc_id long, node long, size long, fp long, fp2 long", size=STAGE_SHINGLE))
    nodes = durable(prints.groupBy("node").agg(F.min("doc_id").alias("least"), *(F.min(c).alias(c) for c in ("size", "fp", "fp2"))))
    joined = components(similar_links(found, nodes, **options))
    nodes = nodes.select("node", "least").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    mark = fresh(docs, "kept_id")
    kept = lookup(prints.select("doc_id", "node"), nodes.join(least, "component").select("node", "component_id"), ["node"]).filter("doc_id = component_id").select(F.col("doc_id").alias(mark)).distinct()
    own = F.col(f"`{id_col}`")
    return docs.join(kept, own == F.col(mark), "left").filter(own.isNull() | F.col(mark).isNotNull()).drop(mark)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group of near-duplicates stays, the one with the smallest doc_id."""
    return keep_similar(docs)
