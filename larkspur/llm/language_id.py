"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from its code point. Three letters in a row are
bound into one vector: the first one's vector rotated by two places, the second one's by one, and the third one's,
multiplied place by place. The vectors of all three-letter windows of a document are bundled, that is
added, into the document's vector, those of a language's documents into its prototype. A document's
language is the prototype of largest cosine.

Letters are what Unicode calls letters, in lower case; whatever stands between words is one boundary, which has a vector of its
own, and windows are those around each letter. Windows are counted and the counts multiplied with the vectors of the
distinct ones, which is the same sum in whole numbers: exact in any order.

Training adds up vectors on the executors; the driver sees one prototype a language, at most
BLOCK of them at a time (16 MB): with more languages a document meets them block by block.

Defined results: a text that is null or has no letter is ``und`` with score 0, as are all texts where no
language was learned; rows without a doc_id, and rows that repeat one, are predicted each by itself (without one: not held out, nor learned from); texts of any
length are read whole, runs of letters of over STEP_CHARS are cut into words of that length; equal cosines go to the
smaller lang in UTF-8 order; an empty table gives an empty table; no other column is read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import STEP_CHARS, arrow, durable, read, steps

#: Places of a vector.
WIDTH = 1024
SEED = b"letters"
#: One document in so many is held out.
FOLDS = 5
#: Languages whose prototypes are sent at a time.
BLOCK = 2048
#: Distinct windows whose vectors are made at a time, and cells of counts.
KINDS, CELLS = 8192, 1 << 22
UNKNOWN = "und"
#: Decimals of a cosine: sums of another order agree.
DECIMALS = 9

_LETTERS = None


def _letters() -> np.ndarray:
    """Whether each code point is a letter; made once in a worker."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTERS


def vectors(codes: np.ndarray) -> np.ndarray:
    """A row of +1 and -1 for each code point."""
    bits = b"".join(hashlib.shake_128(SEED + int(c).to_bytes(4, "little")).digest(WIDTH // 8) for c in codes)
    return np.unpackbits(np.frombuffer(bits, np.uint8)).reshape(len(codes), WIDTH).astype(np.int8) * 2 - 1


def _slices(text: str) -> Iterator[str]:
    """A text in parts of about STEP_CHARS, cut where a word ends."""
    at = 0
    while len(text) - at > STEP_CHARS:
        end = at + STEP_CHARS
        while end > at and text[end - 1].isalpha():
            end -= 1
        end = end if end > at else at + STEP_CHARS
        yield text[at:end]
        at = end
    yield text[at:]


def _windows(parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part of each window, its kind, letters of each kind)."""
    folded = [p.lower() for p in parts]
    codes = np.frombuffer("\0".join(["", *folded, ""]).encode("utf-32-le"), np.uint32)
    owner = np.repeat(np.arange(len(folded) + 1), [1, *(len(p) + 1 for p in folded)]) - 1
    codes = np.where(_letters()[codes], codes, 0)
    kept = np.ones(len(codes), bool)
    kept[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    codes, owner = codes[kept], owner[kept]
    there = np.zeros(0x110000, bool)
    there[codes] = True
    there[0] = True
    alphabet = np.flatnonzero(there)
    place = np.zeros(0x110000, np.int64)
    place[alphabet] = np.arange(len(alphabet))
    x, n = place[codes], len(alphabet)
    at = np.flatnonzero(codes[1:-1]) + 1
    window = (x[at - 1] * n + x[at]) * n + x[at + 1]
    if n**3 <= CELLS:
        kinds = np.flatnonzero(np.bincount(window, minlength=n**3))
        of = np.zeros(n**3, np.int64)
        of[kinds] = np.arange(len(kinds))
        kind = of[window]
    else:
        kinds, kind = np.unique(window, return_inverse=True)
    return owner[at], kind, alphabet[np.stack([kinds // (n * n), kinds // n % n, kinds % n])]


def _bound(letters: np.ndarray) -> np.ndarray:
    """The vectors of windows of three letters."""
    alphabet, places = np.unique(letters, return_inverse=True)
    v, (a, b, c) = vectors(alphabet), places.reshape(letters.shape)
    return np.roll(v, 2, 1)[a] * np.roll(v, 1, 1)[b] * v[c]


def bundled(texts: list[str], groups: np.ndarray | None = None) -> np.ndarray:
    """A row for each text, or for each group of texts (numbered from 0): the sum of its windows' vectors."""
    groups = np.arange(len(texts)) if groups is None else groups
    out = np.zeros((int(groups.max()) + 1 if len(groups) else 0, WIDTH))
    parts, owners, held = [], [], 0

    def add() -> None:
        part, kind, letters = _windows(parts)
        rows, row = np.unique(np.array(owners)[part], return_inverse=True)
        exact = np.float32 if len(part) < 1 << 24 else np.float64  # whole numbers up to the number of windows
        for k in range(0, letters.shape[1], KINDS):
            v = _bound(letters[:, k : k + KINDS]).astype(exact)
            inside = (kind >= k) & (kind < k + KINDS)
            r, x, step = row[inside], kind[inside] - k, max(1, CELLS // len(v))
            order = np.argsort(r, kind="stable") if len(rows) > step else slice(None)
            r, x = r[order], x[order]
            for at in range(0, len(rows), step):
                upto = min(at + step, len(rows))
                some = slice(*np.searchsorted(r, [at, upto])) if len(rows) > step else slice(None)
                counts = np.bincount((r[some] - at) * len(v) + x[some], minlength=(upto - at) * len(v))
                out[rows[at:upto]] += counts.reshape(upto - at, len(v)).astype(exact) @ v

    for g, text in zip(groups, texts, strict=True):
        for part in _slices(text):
            parts.append(part)
            owners.append(g)
            held += len(part)
            if held >= STEP_CHARS:
                add()
                parts, owners, held = [], [], 0
    if parts:
        add()
    return out


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, vector): sums of what a task reads."""
    held: dict[str, np.ndarray] = {}

    def emit() -> Iterator[pa.RecordBatch]:
        for lang, v in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([v.astype(np.int64).tolist()], pa.list_(pa.int64()))], ["lang", "vector"])
        held.clear()

    for langs, texts in steps(batches, key="lang"):
        names, groups = np.unique(np.array(langs, object), return_inverse=True)
        for lang, v in zip(names, bundled(texts, groups), strict=True):
            held[lang] = held.get(lang, 0) + v
        if len(held) > BLOCK:
            yield from emit()
    yield from emit()


def _predict(batches: Iterator[pa.RecordBatch], langs: list[str], model: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The nearest of these languages, unless an earlier one is as near."""
    model = model / np.maximum(np.linalg.norm(model, axis=1), 1)[:, None]
    for b in batches:
        found, score = list(b.column("lang_pred").to_pylist()), np.array(b.column("score").to_pylist(), float)
        at = 0
        for _, texts in steps(iter([b])):
            v = bundled(texts)
            length = np.linalg.norm(v, axis=1)
            cosines = np.clip(np.round(v @ model.T / np.maximum(length, 1)[:, None], DECIMALS), 0, 1)
            best = cosines.argmax(1)
            for k in np.flatnonzero(length > 0):
                if cosines[k, best[k]] > score[at + k]:
                    found[at + k], score[at + k] = langs[best[k]], cosines[k, best[k]]
            at += len(texts)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), b.column("held_out"), pa.array(found, pa.string()), pa.array(score)], ["doc_id", "text", "held_out", "lang_pred", "score"])


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def learn(rows: DataFrame) -> DataFrame:
    """(lang, vector array<long>): prototypes of rows (lang, text)."""
    sums = arrow(rows, _learn, "lang string, vector array<long>").select("lang", F.posexplode("vector").alias("at", "x"))
    each = sums.groupBy("lang", "at").agg(F.sum("x").alias("x"))
    return each.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("vector"))


def identify(docs: DataFrame, prototypes: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"), held_out(id_col).alias("held_out"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(-1.0).alias("score"))
    last = None
    while block := (prototypes if last is None else prototypes.filter(F.col("lang") > last)).orderBy("lang").limit(BLOCK).collect():
        rows = arrow(rows, _predict, "doc_id long, text string, held_out boolean, lang_pred string, score double", langs=[r["lang"] for r in block], model=np.array([r["vector"] for r in block], float))
        last = block[-1]["lang"]
        if len(block) < BLOCK:
            break
    return rows.select("doc_id", "held_out", "lang_pred", F.greatest("score", F.lit(0.0)).alias("score"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    known = docs.filter(~held_out("doc_id") & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    return identify(docs, durable(learn(known.select("lang", "text"))))
