"""Divergence of sources, panes with revisions and language identification against plain rewritings."""

import math
import random
import zlib
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest

from larkspur.llm import divergence, language_id, panes

# Divergence


def brute_divergence(docs):
    """docs: (lang, source, text)."""
    import re

    words = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    upper = {c: c + 32 for c in range(65, 91)}
    counts, within, groups = Counter(), Counter(), set()
    for lang, source, text in docs:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = words.findall((text or "").translate(upper))
        counts.update((lang, source, w) for w in found)
        within.update((lang, w) for w in set(found))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [w for (x, w), n in within.items() if x == lang and n >= 3]
        sources = [s for x, s in groups if x == lang]
        p = {}
        for s in [*sources, None]:
            n = {w: sum(counts[lang, x, w] for x in ([s] if s is not None else sources)) for w in kept}
            p[s] = {w: 1 + 10**9 * (n[w] + 1) // (sum(n.values()) + len(kept)) for w in kept}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            parts = {"pair": [(sum(f(p[s][w], p[o][w]) for w in kept), o) for o in sources if o != s], "term": [(f(p[s][w], p[None][w]), w) for w in kept if counts[lang, s, w] and p[s][w] > p[None][w]]}
            for part, rows in parts.items():
                rows = sorted(rows, key=lambda r: (-r[0], r[1].encode()))
                out += [(lang, s, part, item, v, k) for k, (v, item) in enumerate(rows[: 200 if part == "term" else None], 1)]
    return sorted(out)


DOCS = "doc_id long, lang string, source string, text string, term string, n int, at int"


def held(spark, docs):
    return spark.createDataFrame([(k, *d, "x", 1, 2) for k, d in enumerate(docs)], DOCS)


def test_divergence_against_brute_force(spark):
    rnd = random.Random(2)
    vocabulary = [f"w{chr(97 + k % 26)}{'é' * (k // 26)}" for k in range(120)] + ["Z", "日本", "a-b", "x1y"]
    docs = [(rnd.choice(["en", "de", None]), rnd.choice(["s1", "s2", "s2", "s3", None]), " ".join(rnd.choice(vocabulary).upper() if rnd.random() < 0.2 else rnd.choice(vocabulary[: rnd.randint(5, 124)]) for _ in range(rnd.randint(0, 60)))) for _ in range(120)]
    docs += docs[:9] + [("fr", "alone", "one two"), ("it", "a", "x"), ("it", "b", None), ("pt", "a", "y y y"), ("pt", "b", "y"), ("pt", "b", "Y"), ("en", "s9", "")]
    assert sorted(map(tuple, divergence.divergence(held(spark, docs)).collect())) == brute_divergence(docs)


def test_divergence_edges(spark):
    assert divergence.divergence(held(spark, [])).collect() == []
    long = "ab cd " * 400_000 + "x" * 1_500_000
    docs = [("en", "a", long), ("en", "b", "ab"), ("en", "b", "ab x")]
    assert sorted(map(tuple, divergence.divergence(held(spark, docs)).collect())) == brute_divergence(docs)


def test_divergence_is_exact_for_large_counts(spark):
    for n, total, v in [(0, 0, 1), (5, 10, 3), (10**13, 10**13 + 5, 77), (8 * 10**15, 8 * 10**15, 10**6), (8_999_999_000, 8_999_999_000, 999)]:
        got = spark.range(1).selectExpr(f"{divergence._p(f'{n}L', f'{total}L', f'{v}L')} AS p").first()[0]
        assert got == 1 + 10**9 * (n + 1) // (total + v)


# Panes


def brute_panes(clicks):
    """clicks: (click_id, ts, arrived_at, kind, value)."""
    hour, epoch = 3_600_000_000, datetime(1970, 1, 1)
    micros = lambda t: (t - epoch) // timedelta(microseconds=1)
    rows = {}
    for c, ts, at, kind, value in clicks:
        if ts is not None:
            key = (at or ts, ts, kind or "", value if value is not None else -math.inf)
            if c not in rows or key < rows[c][0]:
                rows[c] = (key, (ts, at or ts, kind, value))
    batches = {k: [] for k in range(10)}
    for c, (_, (ts, at, kind, value)) in rows.items():
        day = (at - epoch).days
        late = 0 if c is None else max(0, zlib.crc32(str(c).encode()) % 30 - 23)
        event = micros(ts) - (day - day % 10) * 24 * hour
        cents = 0 if value is None or not math.isfinite(value) else math.floor(100 * value + 0.5)
        batches[min(9, day % 10 + late)].append((event, -1 if c is None else c, kind or "none", cents))
    w, state, forgotten, out = -math.inf, {}, set(), []
    for k in range(10):
        fresh = {}
        for event, c, kind, cents in batches[k]:
            pane = (kind, event // hour)
            if w >= (pane[1] + 1) * hour + 48 * hour:
                out.append((k, pane[1], c, 1, cents, "late", kind))
            else:
                n, total = fresh.get(pane, (0, 0))
                fresh[pane] = (n + 1, total + cents)
        for pane in {*state, *fresh}:
            n, total, emitted = state.get(pane, (0, 0, False))
            more = fresh.get(pane, (0, 0))
            now = (n + more[0], total + more[1])
            if emitted and pane in fresh:
                out += [(k, pane[1], -1, n, total, "retract", pane[0]), (k, pane[1], -1, *now, "replace", pane[0])]
            elif not emitted and w >= (pane[1] + 13) * hour:
                out.append((k, pane[1], -1, *now, "emit", pane[0]))
                emitted = True
            elif not emitted and k == 9:
                out.append((k, pane[1], -1, *now, "final", pane[0]))
            state[pane] = (*now, emitted)
            if w >= (pane[1] + 49) * hour:
                del state[pane]
                forgotten.add(pane)
        w = max([w, *(r[0] for r in batches[k])])
    return sorted(out)


CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, kind string, value double, batch int, w string"


def test_panes_against_brute_force(spark):
    rnd = random.Random(8)
    start = datetime(2024, 1, 8)
    clicks = []
    for c in range(900):
        at = start + timedelta(minutes=rnd.randint(0, 9 * 1440)) if c % 3 else start + timedelta(days=4, minutes=rnd.randint(0, 50))
        if (at - datetime(1970, 1, 1)).days % 10 in (5, 6):  # two batches get late rows alone
            at += timedelta(days=2)
        ts = at - timedelta(minutes=rnd.choice([0, 1, 1, 30, 2000, 9000, 40000]))
        clicks.append((c, ts, at, rnd.choice(["a", "a", "b", None]), rnd.choice([1.0, 2.345, -0.005, None, 1e6])))
    clicks += clicks[:40] + [(5000, None, start, "a", 1.0), (5001, start, None, "z", math.nan), (None, start, start, "z", math.inf), (7, start, start, "b", 3.0)]
    got = panes.revisions(spark.createDataFrame([(*c, 1, "x") for c in clicks], CLICKS))
    want = brute_panes(clicks)
    assert sorted(map(tuple, got.select("batch", "hour", "click_id", "n_rows", "cents", "record", "kind").collect())) == want
    assert {r[5] for r in want} == {"late", "emit", "retract", "replace", "final"}


def test_panes_of_nothing(spark):
    assert panes.revisions(spark.createDataFrame([], CLICKS)).collect() == []
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").find("RocksDB") < 0


# Language ID


def plain_bundle(text):
    """Window by window."""
    codes = [0]
    for ch in text.lower():
        c = ord(ch) if ch.isalpha() else 0
        if c or codes[-1]:
            codes.append(c)
    codes += [0] if codes[-1] else []
    total = np.zeros(language_id.WIDTH)
    for a, b, c in zip(codes, codes[1:], codes[2:], strict=False):
        if b:
            va, vb, vc = language_id.vectors(np.array([a, b, c]))
            total += np.roll(va, 2) * np.roll(vb, 1) * vc
    return total


TEXTS = ["", "a", "Été à la plage", "x1y2", "123 !?", "日本語 テキスト", "aaa " * 50, "İstanbul ǅ", "the cat. The dog"]


def test_bundles_against_plain_sums():
    got = language_id.bundled(TEXTS)
    for row, text in zip(got, TEXTS, strict=True):
        assert (row == plain_bundle(text)).all()


@pytest.mark.parametrize("limits", [(64, 4096), (8192, 128)])
def test_bundles_in_blocks(monkeypatch, limits):
    monkeypatch.setattr(language_id, "KINDS", limits[0])
    monkeypatch.setattr(language_id, "CELLS", limits[1])
    rnd = random.Random(1)
    texts = [*TEXTS, *("".join(rnd.choice("abcdefghij 日本éß") for _ in range(rnd.randint(0, 300))) for _ in range(30))]
    assert (language_id.bundled(texts) == np.stack([plain_bundle(t) for t in texts])).all()


def test_long_texts_are_read_whole(monkeypatch):
    text = " ".join(f"word{chr(97 + k % 26)}é" for k in range(3000))
    want = language_id.bundled([text, "ab"])
    monkeypatch.setattr(language_id, "STEP_CHARS", 500)
    assert (language_id.bundled([text, "ab"]) == want).all()
    assert (language_id.bundled([text, "ab"], np.array([0, 0]))[0] == want.sum(0)).all()


@pytest.mark.parametrize("block", [2, 2048])
def test_identify(spark, monkeypatch, block):
    monkeypatch.setattr(language_id, "BLOCK", block)
    rnd = random.Random(3)
    letters = {"aa": "abcdefg ", "bb": "hijklmn ", "cc": "opqrstu ", "dd": "éèàçüö ", "ee": "日本語文字 "}
    docs = [(k, lang, "".join(rnd.choice(letters[lang]) for _ in range(80))) for k in range(300) for lang in [rnd.choice(list(letters))]]
    docs += [(1000, "aa", None), (1001, "aa", "12 34"), (1002, None, "hijk"), (None, "bb", "opq"), (1003, "bb", ""), (3, "aa", "opqrst"), (1004, "x", "é" * 3000)]
    df = spark.createDataFrame([(i, t, lang, "s", 0.5, "q") for i, lang, t in docs], "doc_id long, text string, lang string, source string, score double, lang_pred string")
    known = df.filter(~language_id.held_out("doc_id") & df.doc_id.isNotNull() & df.text.isNotNull())
    got = language_id.identify(df, language_id.learn(known.select("lang", "text").filter("lang is not null")))
    rows = Counter(map(tuple, got.collect()))
    assert sum(rows.values()) == len(docs)
    prototypes = {}
    for i, lang, text in docs:
        if i is not None and lang and text is not None and zlib.crc32(str(i).encode()) % 5:
            prototypes[lang] = prototypes.get(lang, 0) + plain_bundle(text)
    names = sorted(prototypes)
    for i, _, text in docs:
        out = i is not None and zlib.crc32(str(i).encode()) % 5 == 0
        v = plain_bundle(text or "")
        if not v.any():
            want = (i, out, "und", 0.0)
        else:
            cosines = [round(float(v @ prototypes[n] / np.linalg.norm(v) / np.linalg.norm(prototypes[n])), 9) for n in names]
            best = int(np.argmax(np.clip(cosines, 0, 1)))
            want = (i, out, names[best], max(0.0, cosines[best]))
        close = [r for r in rows if r[:3] == want[:3] and abs(r[3] - want[3]) < 2e-9]
        assert close, want
    assert language_id.identify(df.limit(0), language_id.learn(known.select("lang", "text").limit(0))).collect() == []
    assert {r[2] for r in language_id.identify(df, language_id.learn(known.select("lang", "text").limit(0))).collect()} == {"und"}


def test_held_out_accuracy(spark, sf_dir):
    from larkspur.llm.language_id import op13_language_id

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    right = [r["lang"] == r["lang_pred"] for r in op13_language_id(spark, sf_dir).join(docs, "doc_id").filter("held_out").collect()]
    assert len(right) > 20
    assert np.mean(right) >= 0.97
