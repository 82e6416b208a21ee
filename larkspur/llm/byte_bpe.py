"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash (hash and displace) over the vocabulary resolves a whole
pre-token in one probe. Tier two, for the rest: a heap of ranked neighbour pairs over a linked
list of the pre-token's bytes, O(n log n) even for a pre-token of a whole long text.

A worker keeps results of recent pre-token groups in a two-generation memo of bounded size, so
that the Python cost is that of distinct groups. A group ends where a space
stands alone between other text: no token of the split pattern begins before it and goes past it.

Defined results: a null or empty text has no tokens (digests of zero bytes); rows that repeat a doc_id, or have none, each
have their own; a text of any length is encoded whole, the memo staying within its bound; pairs of one rank merge from the left; an
empty table gives an empty table; only the id and the text are read, whatever other columns are called.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession

from .common import arrow, read, steps, texts

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Entries of one memo generation; two are held.
MEMO = 300_000
#: Words that are looked up between two looks at the memo's size.
STEP = 100_000
#: Keys per bucket of the perfect hash, on average.
BUCKET = 3

_BREAK = re.compile(r"(?<=\S)(?=[ \n\t\r])")
_TANGLED = re.compile(r" \s|\s ")


class PerfectHash:
    """A minimal perfect hash of byte strings: n keys, n slots; a probe reads one displacement and compares one key."""

    def __init__(self, keys: list[bytes]) -> None:
        n = self.n = len(keys)
        self.buckets = max(1, n // BUCKET)
        groups: list[list[tuple[int, int, int]]] = [[] for _ in range(self.buckets)]
        for k, key in enumerate(keys):
            h = xxhash.xxh3_128_intdigest(key)
            groups[(h >> 96) % self.buckets].append((h & 0xFFFFFFFF, (h >> 32) & 0xFFFFFFFF, k))
        self.slots: list[int] = [-1] * n
        self.shift = [0] * self.buckets
        order = sorted((b for b in range(self.buckets) if groups[b]), key=lambda b: -len(groups[b]))
        free = None
        for b in order:
            group = groups[b]
            if len(group) == 1:  # a lone key goes to any free slot, named directly
                free = iter([i for i in range(n) if self.slots[i] < 0]) if free is None else free
                at = next(free)
                self.slots[at], self.shift[b] = group[0][2], -at - 1
                continue
            d = 0
            while True:
                spots = [(x + d * y + d * d) % n for x, y, _ in group]
                if len(set(spots)) == len(spots) and all(self.slots[s] < 0 for s in spots):
                    break
                d += 1
            for s, (_, _, k) in zip(spots, group, strict=True):
                self.slots[s] = k
            self.shift[b] = d

    def slot(self, key: bytes) -> int:
        """The index of ``key``, if it is one of the keys; else any index."""
        h = xxhash.xxh3_128_intdigest(key)
        d = self.shift[(h >> 96) % self.buckets]
        return self.slots[-d - 1 if d < 0 else ((h & 0xFFFFFFFF) + d * ((h >> 32) & 0xFFFFFFFF) + d * d) % self.n]


class Memo(dict):
    """Ids of a word with the space before it; what is missing comes from the older generation or is encoded."""

    def __init__(self, group, old: dict) -> None:
        self.group, self.old = group, dict(old)

    def __missing__(self, word: str) -> bytes:
        got = self.old.get(word)
        if got is None:
            got = self.group(" " + word)
        if len(word) <= 64:
            self[word] = got
        return got


class Codec:
    """Encoder and decoder for one rank file."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:  # a vocabulary that is installed on every executor, not data
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.keys = list(ranks)
        self.ids = [ranks[k] for k in self.keys]
        self.hash = PerfectHash(self.keys)
        self.single = [ranks[bytes([i])] for i in range(256)]
        #: left id and right id -> id of what they merge into, for every way to cut a token in two tokens
        self.merges = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.merges[left << 32 | right] = rank
        self.split = regex.compile(pattern).findall
        self.memo = Memo(self.group, {})

    def whole(self, piece: bytes) -> int | None:
        k = self.hash.slot(piece)
        return self.ids[k] if self.keys[k] == piece else None

    def merged(self, piece: bytes) -> list[int]:
        """Ids of a pre-token that isn't in the vocabulary: lowest rank first, leftmost of equals."""
        get = self.merges.get
        ids = [self.single[b] for b in piece]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank, i, ids[i], ids[i + 1]) for i in range(n - 1) if (rank := get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue  # one side has merged since
            ids[i], ids[j] = rank, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := get(rank << 32 | ids[k])) is not None:
                    heapq.heappush(heap, (r, i, rank, ids[k]))
            if (h := before[i]) >= 0 and (r := get(ids[h] << 32 | rank)) is not None:
                heapq.heappush(heap, (r, h, ids[h], rank))
        return [x for x in ids if x >= 0]

    def group(self, text: str) -> bytes:
        """Little-endian ids of ``text``, split by the pattern."""
        out: list[int] = []
        for token in [text] if text.removeprefix(" ").isalpha() else self.split(text):
            piece = token.encode()
            if (one := self.whole(piece)) is not None:
                out.append(one)
            else:
                out += self.merged(piece)
        return struct.pack(f"<{len(out)}I", *out)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if _TANGLED.search(text):  # white space beside a space: cut only where a token surely ends
            return b"".join([self.group(x) for x in _BREAK.split(text)])
        first, *rest = text.split(" ")
        out = [self.group(first)]
        for i in range(0, len(rest), STEP):  # a text's words may be more than the memo holds
            if len(self.memo) > MEMO:
                self.memo = Memo(self.group, self.memo)
            out += map(self.memo.__getitem__, rest[i : i + STEP])
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in memoryview(ids).cast("I")])


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One for each worker process."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def _digest(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    own = codec(path, pattern)
    for ids, found in steps(batches):
        n, enc, dec = [], [], []
        for text in found:
            data = own.encode(text)
            n.append(len(data) // 4)
            enc.append(hashlib.sha256(data).hexdigest())
            dec.append(hashlib.sha256(own.decode(data)).hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(enc), pa.array(dec)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _encode(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    own = codec(path, pattern)
    for ids, found in steps(batches):
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([list(memoryview(own.encode(x)).cast("I")) for x in found], pa.list_(pa.int32()))], ["doc_id", "ids"])


def _decode(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    own = codec(path, pattern)
    for b in batches:
        ids = [b"".join([own.tokens[i] for i in x or ()]).decode(errors="replace") for x in b.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.string())], ["doc_id", "text"])


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>)."""
    return arrow(texts(docs, id_col, text_col), _encode, "doc_id long, ids array<int>", path=path, pattern=pattern)


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) -> (doc_id, text); null ids give an empty text."""
    return arrow(tokens.select("doc_id", "ids"), _decode, "doc_id long, text string", path=path, pattern=pattern)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the number of tokens, the digest of its ids, and that of the bytes they decode to."""
    return arrow(texts(docs, id_col, text_col), _digest, SCHEMA, path=path, pattern=pattern)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
