"""Operators that compare documents or vectors, against brute force."""

import random

import numpy as np
import pytest
import xxhash

from larkspur.llm import embedding_dedup, multi_index, simhash, substring_dedup, suffix_array
from larkspur.llm.components import components

from .helpers import EDGE, by_id, corpus, frame, sha


def words_brute(docs, size=50):
    """A result for each row, in the order of ``docs``."""
    first, words = {}, []
    for i, t in docs:
        w = (t or "").encode().split()
        words.append((i, w))
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            first[key] = min(first.get(key, 1 << 70), 1 << 69 if i is None else i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if i is not None and first[tuple(w[k : k + size])] < i:
                gone[k : k + size] = [True] * size
        out.append((i, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return out


def bytes_brute(docs, size=400):
    seen = {}
    data = [(i, (t or "").encode()) for i, t in docs]
    for _, d in data:
        for k in range(len(d) - size + 1):
            h = hash(d[k : k + size])
            seen[h] = seen.get(h, 0) + 1
    out = []
    for i, d in data:
        step = np.zeros(len(d) + 1, int)
        for k in range(len(d) - size + 1):
            if seen[hash(d[k : k + size])] > 1:
                step[k] += 1
                step[k + size] -= 1
        gone = np.cumsum(step)[: len(d)] > 0
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((i, len(d), int(gone.sum()), runs, sha(np.frombuffer(d, np.uint8)[~gone].tobytes())))
    return out


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def mixed(seed=9):
    """Rows that share a doc_id with other texts, or with the same, or have none."""
    docs = corpus(40, seed) + corpus(40, seed + 1)
    return [(None if k % 7 == 0 else i // 4, t) for k, (i, t) in enumerate(docs)] + [(3, docs[5][1]), (3, docs[5][1]), (None, docs[5][1]), (None, docs[5][1]), (None, "z " * 700)]


def colliding():
    """Texts that differ, but not in any polynomial hash modulo 2^64 with an odd base: the Thue-Morse word and its complement."""
    a = "a"
    while len(a) < 2048:
        a += a.translate({97: 98, 98: 97})
    b = a.translate({97: 98, 98: 97})
    around = " ".join(f"u{k}" for k in range(60)), " ".join(f"v{k}" for k in range(60))
    return [(1, f"{around[0]} {a} {around[1]}"), (2, f"{around[0]} {b} {around[1]}"), (3, a), (4, b), (5, f"{around[0]} {a[:512]} {around[1]}"), (6, f"{around[0]} {b[:512]} {around[1]}")]


CORPORA = {"edge": EDGE[:11] + EDGE[12:], "few words": corpus(), "many words": corpus(60, 6), "mixed ids": mixed(), "collisions": colliding()}


@pytest.mark.parametrize("fit", [1024, 2])
@pytest.mark.parametrize("docs", CORPORA.values(), ids=CORPORA)
def test_repeats(spark, docs, fit):
    df = frame(spark, docs)
    assert rows(substring_dedup.dedup_words(df, fit=fit)) == sorted(words_brute(docs), key=repr)
    assert rows(suffix_array.dedup_bytes(df, fit=fit)) == sorted(bytes_brute(docs), key=repr)


def test_hot_anchors_and_leaves(spark, monkeypatch):
    """Keys that are joined without a shuffle give the same."""
    from larkspur.llm import repeats

    monkeypatch.setattr(repeats, "HOT_ROWS", 5)
    monkeypatch.setattr(repeats, "HOT", 20)
    docs = [*corpus(40, 6), *((i, "same " * 30 + " ".join(f"w{k}" for k in range(60)) + f" end{i % 3}") for i in range(300, 360))]
    for fit in (2, 1024):
        assert rows(substring_dedup.dedup_words(frame(spark, docs), fit=fit)) == sorted(words_brute(docs), key=repr)
        assert rows(suffix_array.dedup_bytes(frame(spark, docs), fit=fit)) == sorted(bytes_brute(docs), key=repr)


def test_repeats_in_steps(spark):
    """Texts longer than a step give the same."""
    docs = [*corpus(20, 6), (7, " ".join(t for _, t in corpus(20, 6)))]
    assert rows(substring_dedup.dedup_words(frame(spark, docs), room=1500)) == sorted(words_brute(docs), key=repr)
    assert rows(suffix_array.dedup_bytes(frame(spark, docs), room=1500)) == sorted(bytes_brute(docs), key=repr)


def test_repeats_edges(spark):
    none = frame(spark, EDGE).filter("false")
    assert substring_dedup.dedup_words(none).collect() == [] and suffix_array.dedup_bytes(none).collect() == []
    twice = [(1, "ab " * 200), (1, "ab " * 200), (2, "cd"), (None, "x " * 60)]
    out = substring_dedup.dedup_words(frame(spark, twice)).collect()
    assert len(out) == 4 and all(r.n_removed == 0 for r in out)
    assert {r.n_removed for r in suffix_array.dedup_bytes(frame(spark, twice)).filter("doc_id = 1").collect()} == {600}
    long = frame(spark, [EDGE[11], (12, EDGE[11][1])])
    assert by_id(substring_dedup.dedup_words(long))[12][1] == 20_001


def test_passages_of_over_50_words_by_their_bytes(spark):
    """Two documents share 399 bytes, two share 400, over 50 words each: bytes go from 400 on and at both places, words at the second place."""
    shared = [" ".join(f"{c}{k:05}" for k in range(55)).ljust(n - 2, c) for c, n in (("p", 399), ("q", 400))]
    docs = [(i, f"{i}|{shared[i > 2]}|{i}") for i in (1, 2, 3, 4)]
    assert rows(suffix_array.dedup_bytes(frame(spark, docs))) == sorted(bytes_brute(docs), key=repr)
    assert {i: x[1] for i, x in by_id(suffix_array.dedup_bytes(frame(spark, docs))).items()} == {1: 0, 2: 0, 3: 400, 4: 400}
    assert {i: x[1] for i, x in by_id(substring_dedup.dedup_words(frame(spark, docs))).items()} == {1: 0, 2: 53, 3: 0, 4: 53}


def some_suffixes(seed, symbols=3, depth=5):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(depth, 3 * depth, 40)
    body = rng.integers(0, symbols, lengths.sum())
    ends = np.cumsum(lengths)
    start = np.concatenate([np.arange(e - n, e - depth + 1) for e, n in zip(ends, lengths, strict=True)])
    end = np.concatenate([np.full(n - depth + 1, e) for e, n in zip(ends, lengths, strict=True)])
    return body, start, rng.integers(0, 3, len(start)), end


@pytest.mark.parametrize("seed", range(6))
def test_subtree_nodes(seed):
    """Order, common prefixes and deep nodes of a group's tree, by plain comparison."""
    depth = 5
    body, start, prefix, end = some_suffixes(seed)
    order, shared = substring_dedup.subtree(body, start, prefix, depth, end)
    assert sorted(order.tolist()) == list(range(len(start)))
    leaf = [(prefix[i], body[start[i] : end[i]].tolist()) for i in order.tolist()]
    # ranks of one word follow the words, those of two the pairs, and so on: the order is the words' own
    assert [(p, x[:depth]) for p, x in leaf] == sorted((p, x[:depth]) for p, x in leaf)
    for k in range(1, len(leaf)):
        (p, x), (q, y) = leaf[k - 1 : k + 1]
        want = next((n for n, (u, v) in enumerate(zip(x, y, strict=False)) if u != v), min(len(x), len(y)))
        assert shared[k] == (want if p == q else -1)
    sets = {}
    for n, (p, x) in enumerate(leaf):
        sets.setdefault((p, tuple(x[:depth])), []).append(n)
    want = []
    for at in sets.values():
        if len(at) > 1:
            texts = [leaf[n][1] for n in at]
            common = next((n for n in range(min(map(len, texts))) if len({t[n] for t in texts}) > 1), min(map(len, texts)))
            want.append((at[0], len(at), common))
    assert sorted(want) == list(zip(*(c.tolist() for c in substring_dedup.nodes(shared, depth)), strict=True))


@pytest.mark.parametrize("depth", [3, 8, 29, 150])
def test_radix_sort_orders_suffixes(depth):
    body, start, bucket, _ = some_suffixes(depth, 2, depth)
    body = np.where(body > 0, 255, 1).astype(np.uint8)
    start = np.r_[start, start[:9]]  # some stand twice
    bucket = np.r_[bucket, bucket[:9]]
    order, new = suffix_array.radix_sort(body, start, bucket, depth)
    got = [(bucket[i], body[start[i] : start[i] + depth].tobytes()) for i in order.tolist()]
    assert sorted(order.tolist()) == list(range(len(start))) and got == sorted(got)
    assert new.tolist() == [k == 0 or got[k] != got[k - 1] for k in range(len(got))]


def test_rewrite(spark):
    docs = corpus()
    out = substring_dedup.rewrite_words(frame(spark, [*docs, (1, None)]))
    brute = {r[0]: r[1:] for r in words_brute(docs)}
    assert out.columns == frame(spark, docs).columns and out.filter("text is null").count() == 1
    for r in out.filter("doc_id > 1").collect():
        assert sha(b" ".join(r.text.encode().split())) == brute[r.doc_id][2]
        assert brute[r.doc_id][1] or r.text == dict(docs)[r.doc_id]


def fingerprint(t):
    w = (t or "").encode().lower().split()
    parts = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(names, near):
    up = {i: i for i in names}

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in near:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in names}


@pytest.mark.parametrize("leaf", [16_384, 8])
def test_simhash(spark, leaf):
    docs = [*EDGE, *corpus(60), (900, "A b c d"), (901, "a B C d"), (902, "É"), (903, "é")]
    got = by_id(simhash.near_duplicates(frame(spark, docs), leaf=leaf))
    prints = {i: fingerprint(t) for i, t in docs}
    near = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    whole = linked(prints, near)
    assert got == {i: (f"{prints[i]:016x}", whole[i]) for i in prints}
    kept = simhash.keep_one(frame(spark, docs), leaf=leaf)
    assert kept.columns == frame(spark, docs).columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(whole.values()))


def test_simhash_edges(spark):
    assert simhash.near_duplicates(frame(spark, EDGE).filter("false")).collect() == []
    docs = frame(spark, [(1, "a b c"), (1, "a b c"), (None, "a b c"), (None, "lone words stay here")])
    assert simhash.near_duplicates(docs).count() == 4 and simhash.keep_one(docs).count() == 4


def near_texts(seed=3):
    """Texts of 40 to 400 words, each with copies in which more and more words differ; repeated lines; copies in other case."""
    rnd = random.Random(seed)
    docs = []
    for k in range(30):
        base = [f"w{rnd.randrange(5000)}" for _ in range(rnd.choice([40, 120, 400]))]
        docs.append(" ".join(base))
        for share in (0.005, 0.01, 0.015, 0.02, 0.03, 0.05):
            docs.append(" ".join(f"v{rnd.randrange(5000)}" if rnd.random() < share else w for w in base))
        docs += [" ".join(base).upper(), "\n".join([" ".join(base[:20])] * 9), " ".join(base[: len(base) * 9 // 10])]
    return list(enumerate([*docs, None, "", "one", "ONE", "two words"]))


def jaccard_groups(docs):
    sets = {}
    for i, t in docs:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))}
    return linked(sets, [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])])


@pytest.mark.parametrize("leaf, members", [(16_384, 2048), (40, 3)])
def test_stage_keeps_one_of_similar_texts(spark, leaf, members):
    docs = near_texts()
    whole = jaccard_groups(docs)
    assert len(set(whole.values())) < len(docs) - 60
    kept = simhash.keep_similar(frame(spark, docs), leaf=leaf, members=members)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(whole.values()))


def test_stage_links_what_three_bits_miss(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    whole = jaccard_groups([(r.doc_id, r.text) for r in docs.collect()])
    assert whole[145] == 6 and whole[177] == 1
    assert sorted(r.doc_id for r in simhash.stage(spark, docs, sf_dir).collect()) == sorted(set(whole.values()))


def test_leaf_search_is_exact():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    x = np.unique(np.concatenate([base ^ np.uint64(sum(1 << int(b) for b in rng.integers(0, 64, k % 5))) for k in range(30)]))
    want = {(i, j) for i in range(len(x)) for j in range(len(x)) if np.bitwise_count(x[i] ^ x[j]) <= 3}
    simhash.BLOCK, held = 500, simhash.BLOCK
    try:
        got = [p for a, b in simhash.near(x, x, 3) for p in zip(a.tolist(), b.tolist(), strict=True)]
    finally:
        simhash.BLOCK = held
    assert len(got) == len(set(got)) and set(got) == want
    row, leaf, home = simhash.route(x, simhash.tree(x, 4), 3)
    at = {int(r): int(n) for r, n, h in zip(row, leaf, home, strict=True) if h}
    visits = {(int(r), int(n)) for r, n in zip(row, leaf, strict=True)}
    assert all((i, at[j]) in visits or (j, at[i]) in visits for i, j in want)


def test_leaves_are_divided_until_they_are_small(spark):
    """Every link within the radius still meets in a leaf, and leaves are bounded."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    x = np.unique(np.concatenate([base ^ np.uint64(sum(1 << int(b) for b in rng.integers(0, 64, k % 5))) for k in range(8)]))
    routed = spark.createDataFrame([(0, k % 9 > 0, int(v)) for k, v in enumerate(x.view(np.int64))], "leaf long, home boolean, fp long")
    got = simhash.divided(routed, 3, 150).collect()
    sizes, homes, visits = {}, {}, set()
    for r in got:
        sizes[r.leaf] = sizes.get(r.leaf, 0) + 1
        visits.add((r.fp, r.leaf))
        if r.home:
            assert r.fp not in homes
            homes[r.fp] = r.leaf
    assert len(sizes) > 8 and max(sizes.values()) <= 200 and len(homes) == sum(k % 9 > 0 for k in range(len(x)))
    signed = x.view(np.int64).tolist()
    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x ^ x[i]) <= 3).tolist():
            a, b = signed[i], signed[j]
            if i != j and (a in homes or b in homes):
                assert (a in homes and (b, homes[a]) in visits) or (b in homes and (a, homes[b]) in visits)


@pytest.mark.parametrize("seed", range(4))
def test_spanning_forest(seed):
    rng = np.random.default_rng(seed)
    n = 60
    pairs = [rng.integers(0, n, (2, k)) for k in (40, 0, 25, 30)]
    kept = simhash.forest(iter([(p[0], p[1]) for p in pairs]), n)
    every = [(int(a), int(b)) for p in pairs for a, b in p.T]
    assert linked(range(n), kept) == linked(range(n), every) and set(kept) <= set(every)
    assert len(kept) == n - len(set(linked(range(n), every).values()))


def test_fingerprints_in_steps():
    texts = [t or "" for _, t in [*EDGE, *corpus(20)]]
    simhash.BITS_AT_ONCE, held = 7, simhash.BITS_AT_ONCE
    try:
        assert simhash.fingerprints(texts).tolist() == [fingerprint(t) for t in texts]
    finally:
        simhash.BITS_AT_ONCE = held


def test_lookup_of_hot_keys(spark, monkeypatch):
    from larkspur.llm import common

    monkeypatch.setattr(common, "OFTEN_ROWS", 5)
    monkeypatch.setattr(common, "OFTEN", 10)
    left = [(k % 4 if k % 3 else 7, "x", k) for k in range(200)] + [(None, "x", 1), (8, None, 2), (9, "x", 3)]
    table = [(k, "x", k * 10, f"v{k}") for k in (0, 1, 7, 9)] + [(None, "x", 5, "none")]
    a = spark.createDataFrame(left, "key long, other string, n long")
    b = spark.createDataFrame(table, "key long, other string, value long, name string")
    held = {(k, o): (v, m) for k, o, v, m in table if k is not None}
    want = sorted(((k, o, n, *held.get((k, o), (None, None))) for k, o, n in left), key=repr)
    assert rows(common.lookup(a, b, ["key", "other"])) == want


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(1000, 1040)] + [(5000, k) for k in range(4900, 4960)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = linked({x for e in edges for x in e}, edges)
    assert {i: got.get(i, i) for i in want} == want
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def vectors(n=400, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 4, 16))
    rows = [(i, (base[i % len(base)] + rng.normal(size=16) * rng.choice([0, 0.03, 0.06, 1.0])).tolist(), int(rng.integers(0, 3))) for i in range(n)]
    odd = [(9000, None, 1), (9001, [0.0] * 16, 1), (9002, [float("nan")] * 16, 1), (9003, [1.0, None], 1), (9004, [1.0] * 16, None), (9005, [], 1), (9006, [1.0, 2.0], 1), (9007, [2.0, 4.0], 1), (9020, [1.0, 2.0], 1)]
    return rows + odd + [(i + 10_000, [1.0] * 8 + [0.0] * 8, 1) for i in range(70)]


def good(e):
    return e is not None and len(e) > 0 and all(x is not None and np.isfinite(x) for x in e) and any(e)


def check_embeddings(spark, rows, least, kind="float", **options):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").selectExpr("*", "1 as cid", "2 as n", "3 as links", "4 as pivot", "5 as g", "6 as level")
    one = np.float32 if kind == "float" else float
    ok = {i: (np.array(e, one).astype(float), y) for i, e, y in rows if good(e) and y is not None}
    unit = {i: e / np.linalg.norm(e) for i, (e, _) in ok.items()}
    near = [(a, b) for a in ok for b in ok if a < b and ok[a][1] == ok[b][1] and len(ok[a][0]) == len(ok[b][0]) and unit[a] @ unit[b] >= 0.98]
    got = by_id(embedding_dedup.near_duplicates(df, **options))
    links = {i: 0 for i, _, _ in rows}
    for a, b in near:
        links[a] += 1
        links[b] += 1
    assert all(got[i][0] <= links[i] for i in links)  # none below the threshold
    found = sum(v[0] for v in got.values())
    assert found >= least * 2 * len(near)
    if found == 2 * len(near):
        whole = linked(links, near)
        assert got == {i: (links[i], whole[i], whole[i] == i) for i in links}
    return got


@pytest.mark.parametrize("block", [2048, 16])
@pytest.mark.parametrize("kind", ["float", "double"])
def test_embedding_dedup(spark, block, kind):
    check_embeddings(spark, vectors(), 0.95, kind, block=block)


@pytest.mark.parametrize("kind", ["isotropic", "clustered", "cone"])
def test_embedding_dedup_by_shape(spark, kind):
    """Near copies among vectors of every shape, those within a narrow cone too, have more than one pivot and are found."""
    x = cloud(kind, 500)
    rng = np.random.default_rng(7)
    noise = np.median(np.linalg.norm(x - x[::-1], axis=1)) / 40
    rows = [(i, e.tolist(), 1) for i, e in enumerate(np.concatenate([x, x[:150] + rng.normal(size=(150, 16)) * noise, x[:20]]))]
    check_embeddings(spark, rows, 0.9, block=64)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert len(embedding_dedup.spread(unit[:64])) >= 10


def test_embedding_edges(spark):
    schema = "vec_id long, embedding array<double>, label int"
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (3, [1.0, 0.0], None)]
    got = sorted((tuple(r) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, schema)).collect()), key=repr)
    assert got == sorted([(1, 3, 1, True), (1, 3, 1, True), (1, 0, 1, True), (2, 3, 1, False), (None, 3, 1, False), (3, 0, 3, True)], key=repr)


def test_embedding_ids_repeat(spark):
    """One id with two vectors that each have links, and vectors without an id: links and components are those of the vectors."""
    rng = np.random.default_rng(3)
    a, b, c = (rng.normal(size=8) for _ in range(3))
    near = lambda x: x + rng.normal(size=8) * 0.005
    rows = [(7, a), (7, b), (9, a), (8, near(b)), (12, near(b)), (None, near(a)), (None, c), (None, c), (7, -a)]
    x = np.stack([r[1] / np.linalg.norm(r[1]) for r in rows])
    linked = x @ x.T >= 0.98
    for _ in rows:  # transitive closure
        whole = linked @ linked
        linked = whole
    want = []
    for i, (vec_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in np.flatnonzero(linked[i]) if rows[j][0] is not None]
        low = min(ids, default=None)
        want.append((vec_id, int((x[i] @ x.T >= 0.98).sum()) - 1, low, vec_id is not None and vec_id == low))
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in rows], "vec_id long, embedding array<double>, label int")
    got = sorted((tuple(r) for r in embedding_dedup.near_duplicates(df).collect()), key=repr)
    assert got == sorted(want, key=repr)
    assert (9, 2, 7, False) in got
    assert (12, 2, 7, False) in got


def cloud(kind, n, width=16, seed=4):
    rng = np.random.default_rng(seed)
    if kind == "isotropic":
        x = rng.normal(size=(n, width))
    elif kind == "clustered":  # about 30 vectors to a cluster
        x = rng.normal(size=(n // 30, width))[rng.integers(0, n // 30, n)] + rng.normal(size=(n, width)) * 0.1
    else:  # all within a narrow cone
        x = rng.normal(size=width) * 2 + rng.normal(size=(n, width)) * 0.3
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32).astype(float)


def nearest_of(spark, rows, **options):
    """Result rows by query, and the recall against brute force over all usable rows; checks ranks, order and scores."""
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as rank", "2 as score", "3 as cell", "4 as shard", "5 as row", "6 as query")
    ok = [(i, np.pad(np.array(e, np.float32).astype(float), (0, 16 - len(e)))) for i, e in rows if good(e) and i is not None]
    ids, x = np.array([i for i, _ in ok]), np.array([e for _, e in ok])
    found: dict[int, list] = {}
    for r in multi_index.search(df, **options).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hit = total = 0
    for q, (i, e) in enumerate(ok):
        if i % 20 == 0 and (ids == i).sum() == 1:
            score = (x * e).sum(1)
            best = [int(v) for v in ids[np.lexsort((ids, -np.where(np.arange(len(ids)) == q, -np.inf, score)))][:20]]
            got = sorted(found.pop(i))
            assert [g[0] for g in got] == list(range(1, len(got) + 1)) and all(np.abs(score[ids == g[1]] - g[2]).min() < 1e-12 for g in got)
            assert [(-g[2], g[1]) for g in got] == sorted((-g[2], g[1]) for g in got)
            hit += len(set(best) & {g[1] for g in got})
            total += len(set(best))
    return found, hit / total


@pytest.mark.parametrize("kind", ["isotropic", "clustered", "cone"])
def test_multi_index(spark, kind):
    rows = [(i, e.tolist()) for i, e in enumerate(cloud(kind, 3000))] + [(i, e) for i, e, _ in vectors() if i >= 9000 and i != 9007] + [(20_000 + i, [0.5] * 16) for i in range(60)]
    left, recall = nearest_of(spark, rows, shard=256)
    assert not left and recall >= 0.9


def test_multi_index_sends_queries_where_their_cells_are(spark):
    """Queries sent to shards over queries: grows far slower than the shards do, where vectors cluster."""
    sent = {}
    for n in (2000, 4000, 8000):
        x = cloud("clustered", n)
        cells, share = multi_index.fit(x, multi_index.centre_count(n))
        at = cells.of(x)
        counts = np.bincount(at, minlength=len(cells.left) * len(cells.right))
        first, many = multi_index.shards_of(counts, 128)
        cells.counts = counts.tolist()
        a, b = cells.far(x[::20])
        taken = [cells.walk(p, q, max(80, int(share * n) + 1)) for p, q in zip(a, b, strict=True)]
        shards = [len({s for c in t for s in range(first[c], first[c] + many[c])}) for t in taken]
        sent[n] = np.mean(shards), (first + many).max()
    assert all(a < 0.5 * b for a, b in sent.values())
    assert sent[8000][0] / sent[2000][0] < 0.75 * sent[8000][1] / sent[2000][1]


def test_shards_hold_every_cell():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 40, 300) * (rng.random(300) < 0.7)
    counts[[5, 200]] = 1000, 301
    first, many = multi_index.shards_of(counts, 100)
    held = {}
    for c, n in enumerate(counts.tolist()):
        for s in range(first[c], first[c] + many[c]):
            held[s] = held.get(s, 0) + n / many[c]
    assert max(held.values()) <= 200 and len(held) == max(held) + 1


def test_multi_index_edges(spark):
    schema = "vec_id long, embedding array<float>"
    assert multi_index.search(spark.createDataFrame([], schema)).collect() == []
    few = spark.createDataFrame([(0, [1.0, 0.0]), (20, [1.0, 0.0]), (7, [1.0, 0.0]), (3, [1.0, 0.0]), (7, [0.0, 1.0]), (None, [1.0, 1.0])], schema)
    got = sorted(tuple(r)[:3] for r in multi_index.search(few).collect())
    assert got == [(0, 1, 3), (0, 2, 7), (0, 3, 20), (0, 4, 7), (20, 1, 0), (20, 2, 3), (20, 3, 7), (20, 4, 7)]
    # rows that share an id, queries too, are rows of their own; nothing is rounded to single precision
    twice = spark.createDataFrame([(20, [0.1, 0.9]), (20, [0.9, 0.1]), (7, [0.1, 0.9]), (7, [0.9, 0.1 + 1e-12])], "vec_id long, embedding array<double>")
    rows = multi_index.search(twice).collect()
    assert len(rows) == 6 and sorted(r["rank"] for r in rows) == [1, 1, 2, 2, 3, 3] and sum(r.vec_id == 20 for r in rows) == 2
    assert max(r.score for r in rows) == 0.9 * 0.9 + 0.1 * (0.1 + 1e-12)


def test_traversal_takes_cells_in_order():
    rng = np.random.default_rng(5)
    cells = multi_index.Cells(np.zeros((6, 1)), np.zeros((7, 1)), [1] * 42)
    a, b = rng.random(6), rng.random(7)
    got = cells.walk(a, b, 42)
    far = [a[c // 7] + b[c % 7] for c in got]
    assert sorted(got) == list(range(42)) and far == sorted(far)
