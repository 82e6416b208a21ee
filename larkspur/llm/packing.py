"""Best-fit packing of token sequences in bulk-synchronous rounds.

A document's ids are cut into pieces of at most ``capacity`` tokens, and pieces share sequences. What is
left of a sequence is its gap. A round:

1. opens sequences. Pieces longer than every gap fit nowhere; what they need at least by themselves (by their sum, and by
   how many are longer than half a sequence) is opened as empty gaps.
2. sorts pieces and gaps together into ranges of size, pieces before gaps of their size.
3. sweeps each range: its pieces, longest first, each go to the smallest gap of the range that holds them (their
   successor), and gaps shrink as they are filled. What is left over are gaps below all of the range's waiting pieces.
4. matches across ranges. Pieces that wait in one range and gaps that are left in a higher one pair up as brackets do:
   each gap takes the longest pieces that wait below it. The driver pairs whole stretches from two counts for each
   range; which piece goes to which gap follows from their ranks, in the tasks, and so no two claim the same room.
   Where the pieces of a range are short, a gap takes as many as surely fit at once.
5. updates the gaps, and repeats with what still waits. Gaps too small for all that waits leave.

Within one range that is best-fit decreasing; a gap holds at least one more piece after each round in which pieces below
it wait, so rounds follow the pieces of a sequence, not of the corpus. The number of ranges follows the rows that
are left. Nothing but counts reaches the driver: of each size, and four numbers for each range.

Defined results: a null or empty text is one piece, the end mark alone; pieces that tie in length
go by (doc_id, piece); rows that repeat a doc_id are documents of their own; null doc_ids too; special tokens that stand
in a text are read as the tokenizer reads them; texts of any length are cut after they are encoded; an empty table gives
an empty table; only the id and the text are read.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow, drop, durable, read, steps, texts

CAPACITY = 4096
END = 1
#: Characters that words are gathered from at a time: the more, the fewer are met again.
STEP = 4_000_000
#: Words that one memo generation of a worker holds.
MEMO = 500_000
#: Words with other than Latin letters and ASCII marks, one to a line: those that the pattern below might split otherwise than the tokenizer, or that NFC changes.
_ODD = re.compile(r"^.*[^!-~À-ÖØ-öø-įıĲ-ſ\n].*$", re.MULTILINE)
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^a-z0-9ß-öø-ſ\n]+|\n")
#: Rows (pieces and gaps) of a range that one task sweeps.
RANGE = 200_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordTokens:
    """Ids by a tokenizer that lower-cases, drops white space and marks the ends of its pre-tokens.

    Such a tokenizer's ids of a text are those of its white-space separated words one after the
    other, and a word's are those of its pre-tokens. Both are kept: words in a memo of two
    generations, so that each is worked out about once, and pre-tokens in another, so that case
    and marks around a word cost no second encoding. Words with other than Latin letters and ASCII
    marks, or with a special token in them, go to the tokenizer as they are; other pre-tokens, found
    already, go to its model alone. Words are split, numbered and put together again as Arrow columns, so that Python
    meets each word once in a step.
    """

    #: Stands between words while they are joined; no id has such bytes, at any offset.
    BETWEEN = b"\xff\xff\xff\xff"

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)  # a vocabulary installed on every executor
        self.model = Tokenizer(self.tokenizer.model)  # the same merges, for lower-cased pre-tokens between spaces
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        special = "|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        self.special = re.compile(f"^.*(?:{special or '(?!)'}).*$", re.MULTILINE)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def pre_tokens(self, parts: list[str]) -> None:
        """Learns pre-tokens, many encoded as one text: each has one id that ends it, its last."""
        lines = [" ".join(parts[i : i + 1000]) for i in range(0, len(parts), 1000)]
        for i, e in enumerate(self.model.encode_batch_fast(lines, add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            data = ids.tobytes()
            self.parts.update(zip(parts[1000 * i : 1000 * i + 1000], (data[x:y] for x, y in zip([0, *cuts[:-1]], cuts, strict=True)), strict=True))

    def learn(self, missing: list[bytes]) -> None:
        text = b"\n".join(missing).decode()
        odd = {*_ODD.findall(text), *self.special.findall(text)}
        if odd:
            for w, e in zip(odd, self.tokenizer.encode_batch_fast([*odd], add_special_tokens=False), strict=True):
                self.new[w.encode()] = np.array(e.ids, "<u4").tobytes()
            missing = [w for w in missing if w not in self.new]
            text = b"\n".join(missing).decode()
        if not missing:
            return
        parts = _PARTS.findall(text.lower())
        if len(self.parts) > MEMO:
            self.parts = {}
        self.parts["\n"] = self.BETWEEN
        self.pre_tokens([*(set(parts) - self.parts.keys())])
        self.new.update(zip(missing, b"".join(map(self.parts.__getitem__, parts)).split(self.BETWEEN), strict=True))

    def known(self, words: list[bytes]) -> list[bytes]:
        """The ids of each of these words, which differ."""
        if len(self.new) > MEMO:
            self.old, self.new = self.new, {}
        found = [*map(self.new.get, words)]
        places = [k for k, ids in enumerate(found) if ids is None]
        missing = []
        for k in places:
            if (ids := self.old.get(words[k])) is None:
                missing.append(words[k])
            else:
                self.new[words[k]] = ids
        self.learn(missing)
        for k in places:
            found[k] = self.new[words[k]]
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        words = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))  # what begins or ends with white space has an empty word there
        numbered = words.flatten().dictionary_encode()
        known = self.known(numbered.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist())
        ids = pa.array(known, pa.large_binary()).take(numbered.indices)
        _, at, data = ids.buffers()
        if data is None:
            return [b""] * len(texts)
        begins = np.frombuffer(at, np.int64)[ids.offset :][words.offsets.to_numpy()].tolist()
        held = memoryview(data)
        return [bytes(held[x:y]) for x, y in zip(begins, begins[1:], strict=False)]


_TOKENIZERS: dict[str, WordTokens] = {}


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end: int) -> Iterator[pa.RecordBatch]:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    own = _TOKENIZERS.setdefault(path, None) or WordTokens(path)
    _TOKENIZERS[path] = own
    mark = np.array([end], "<u4").tobytes()
    for ids, found in steps(batches, STEP):
        out: list[tuple] = []
        for i, data in zip(ids, own.encode(found), strict=True):
            data += mark
            for k, at in enumerate(range(0, len(data), 4 * capacity)):
                part = data[at : at + 4 * capacity]
                out.append((i, k, at // 4, len(part) // 4, zlib.crc32(part)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()], strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32."""
    return arrow(texts(docs, id_col, text_col), _pieces, PIECES, path=path, capacity=capacity, end=end)


def fill(counts: dict[int, int], sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-fit decreasing of ``counts[length]`` pieces into gaps of these ascending sizes, and the gaps' sizes after it.

    A row (length, rank, n, gap, each, offset) says: the n pieces of that length from that rank on go to the
    gaps gap, gap+1, ..., ``each`` pieces to each, the first at offset. Pieces that no gap holds have no row.
    """
    starts = np.flatnonzero(np.r_[True, sizes[1:] != sizes[:-1]][: len(sizes)])
    gaps = {int(sizes[i]): [(int(i), int(n))] for i, n in zip(starts, np.diff(np.r_[starts, len(sizes)]), strict=True)}
    known = sorted(gaps)
    rows: list[tuple[int, int, int, int, int, int]] = []

    def leave(size: int, first: int, many: int) -> None:
        if size > 0 and many > 0:
            if size not in gaps:
                bisect.insort(known, size)
                gaps[size] = []
            gaps[size].append((first, many))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left and (at := bisect.bisect_left(known, length)) < len(known):
            size = known[at]
            first, many = gaps[size].pop()
            if not gaps[size]:
                del gaps[size], known[at]
            each = size // length
            full, rest = divmod(min(left, many * each), each)
            offset = capacity - size
            if full:
                rows.append((length, rank, full * each, first, each, offset))
                leave(size - each * length, first, full)
            if rest:
                rows.append((length, rank + full * each, rest, first + full, rest, offset))
                leave(size - rest * length, first + full, 1)
            leave(size, first + full + bool(rest), many - full - bool(rest))
            rank += full * each + rest
            left -= full * each + rest
    after = np.zeros(len(sizes), np.int64)
    for size, held in gaps.items():
        for first, many in held:
            after[first : first + many] = size
    return np.array(rows, np.int64).reshape(-1, 6), after


def _sweep(batches: Iterator[pa.RecordBatch], capacity: int) -> Iterator[pa.RecordBatch]:
    """A range's pieces and gaps, sorted by size, swept once. ``what``: 0 placed, 1 waiting, 2 gap; ``rank`` numbers
    the range's waiting pieces and the gaps that nothing went to, and is -1 for others."""
    from pyspark import TaskContext

    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    size, gap = t.column("size").to_numpy(), t.column("gap").to_numpy(zero_copy_only=False)
    at_piece, at_gap = np.flatnonzero(~gap), np.flatnonzero(gap)
    length = size[at_piece]
    begins = np.flatnonzero(np.r_[True, length[1:] != length[:-1]][: len(length)])
    many = np.diff(np.r_[begins, len(length)])
    rows, after = fill(dict(zip(length[begins].tolist(), many.tolist(), strict=True)), size[at_gap], capacity)
    what, rank, offset = np.where(gap, 2, 1), np.full(len(size), -1), np.zeros(len(size), np.int64)
    sequence = t.column("sequence_id").to_numpy().copy()
    if len(rows):
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        key = rows[:, 0] << 40 | rows[:, 1]
        nth = np.arange(len(length)) - np.repeat(begins, many)
        r = np.searchsorted(key, length << 40 | nth, side="right") - 1
        run = rows[np.maximum(r, 0)]
        rest = nth - run[:, 1]
        fits = (r >= 0) & (run[:, 0] == length) & (rest < run[:, 2])
        where, run, rest = at_piece[fits], run[fits], rest[fits]
        what[where] = 0
        sequence[where] = sequence[at_gap[run[:, 3] + rest // run[:, 4]]]
        offset[where] = run[:, 5] + rest % run[:, 4] * length[fits]
    free = at_gap[after == size[at_gap]]
    waits = np.flatnonzero(what == 1)
    rank[free], rank[waits] = np.arange(len(free)), np.arange(len(waits))
    size = size.copy()
    size[at_gap] = after
    new = {"size": size, "sequence_id": sequence, "what": what.astype(np.int32), "part": np.full(len(size), TaskContext.get().partitionId()), "rank": rank, "offset": offset}
    cols = [pa.array(new[c]) if c in new else t.column(c) for c in _SWEPT]
    yield pa.RecordBatch.from_arrays(cols, list(_SWEPT))


_SWEPT = ("doc_id", "piece", "start", "length", "ids_crc32", "size", "sequence_id", "what", "part", "rank", "offset")
SWEPT = f"{PIECES}, size long, sequence_id long, what int, part long, rank long, offset long"


def brackets(parts: list[tuple[int, int, int, int, int]]) -> np.ndarray:
    """Stretches of waiting pieces and of gaps that pair up across ranges.

    ``parts``: for each range in order (range, free gaps, their smallest size, waiting pieces, their largest size); the gaps of a
    range lie below its waiting pieces. A row (gaps' range, first gap, range of pieces, first piece, pieces, each,
    number) says: these pieces, the last of them first, go ``each`` to a gap from the first gap on; gaps are numbered from ``number``.
    """
    rows, waiting, number = [], [], 0
    for part, free, least, pieces, largest in parts:
        first = 0
        while free and waiting:
            of, left, longest = waiting[-1]
            each = max(1, least // longest)
            taken = min(left, free * each)
            gaps = -(-taken // each)
            rows.append((part, first, of, left - taken, taken, each, number))
            number, first, free = number + gaps, first + gaps, free - gaps
            if taken == left:
                waiting.pop()
            else:
                waiting[-1] = of, left - taken, longest
        if pieces:
            waiting.append((part, pieces, largest))
    return np.array(rows, np.int64).reshape(-1, 7)


def _pair(batches: Iterator[pa.RecordBatch], rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Adds the number of the gap that a waiting piece or a free gap pairs up in (-1: none), and a piece's turn in it."""
    by_gap = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    by_piece = rows[np.lexsort((rows[:, 3], rows[:, 2]))]
    for b in batches:
        what, part, rank = (b.column(c).to_numpy() for c in ("what", "part", "rank"))
        pair, turn = np.full(len(what), -1), np.zeros(len(what), np.int64)
        for kind, table, p, r in ((2, by_gap, 0, 1), (1, by_piece, 2, 3)):
            at = np.flatnonzero((what == kind) & (rank >= 0))
            k = np.searchsorted(table[:, p] << 40 | table[:, r], part[at] << 40 | rank[at], side="right") - 1
            row = table[np.maximum(k, 0)]
            nth = rank[at] - row[:, r]
            inside = (k >= 0) & (row[:, p] == part[at]) & (nth < (-(-row[:, 4] // row[:, 5]) if kind == 2 else row[:, 4]))
            at, row, nth = at[inside], row[inside], nth[inside]
            if kind == 2:
                pair[at] = row[:, 6] + nth
            else:
                back = row[:, 4] - 1 - nth
                pair[at], turn[at] = row[:, 6] + back // row[:, 5], back % row[:, 5]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pair), pa.array(turn)], [*b.schema.names, "pair", "turn"])


def _ranges(state: DataFrame, rows: int, many: int) -> DataFrame:
    """``state`` in ranges of size of about ``rows`` rows, sorted; pieces or gaps of one size may be divided over ranges."""
    order = ["size", "gap", "doc_id", "piece", "sequence_id"]
    n = -(-many // rows)
    return (state.repartitionByRange(n, *order) if n > 1 else state.coalesce(1)).sortWithinPartitions(*order)


def pack(pieces: DataFrame, capacity: int = CAPACITY, rows: int = RANGE) -> DataFrame:
    """Adds sequence_id and offset to pieces with a ``length`` from 1 to ``capacity``."""
    spark = pieces.sparkSession
    waits = pieces = durable(pieces.select(*_SWEPT[:5]))  # texts are tokenised once, though a range sort reads its input twice
    none = [F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in PIECES.split(", "))]
    gaps = spark.createDataFrame([], "size long, sequence_id long")
    waiting, free = Counter(dict(waits.groupBy("length").count().collect())), Counter()  # how many of each size: at most ``capacity`` numbers
    done, opened = [], 0
    while waiting:
        largest = max(free, default=0)
        unfit = {n: k for n, k in waiting.items() if n > largest}
        more = max(-(-sum(n * k for n, k in unfit.items()) // capacity), sum(k for n, k in unfit.items() if 2 * n > capacity))
        # opened sequences are counted off, not listed on the driver
        fresh = spark.range(opened, opened + more, 1, -(-more // rows) or 1).select(F.lit(capacity).cast("long").alias("size"), F.col("id").alias("sequence_id"))
        state = waits.select(*_SWEPT[:5], F.col("length").alias("size"), F.lit(False).alias("gap"), F.lit(-1).cast("long").alias("sequence_id"))
        state = state.unionByName(gaps.unionByName(fresh).select(*none, "size", F.lit(True).alias("gap"), "sequence_id"))
        many = sum(waiting.values()) + sum(free.values()) + more
        opened += more
        swept = durable(arrow(_ranges(state, rows, many), _sweep, SWEPT, capacity=capacity))
        done.append(swept.filter("what = 0").select(*_PLACED))
        paired, met = _across(swept, capacity) if many > rows else (None, None)
        waits, gaps = swept.filter("what = 1"), swept.filter("what = 2")
        if paired is not None:
            done.append(met.select(*_PLACED))
            used = met.groupBy("sequence_id").agg(F.sum("length").alias("used"))
            waits = paired.filter("what = 1 and pair < 0")
            gaps = paired.filter("what = 2").join(used, "sequence_id", "left").withColumn("size", F.col("size") - F.coalesce("used", F.lit(0)))
        tally = waits.select("length", F.lit(0).alias("gap")).unionByName(gaps.select(F.col("size").alias("length"), F.lit(1).alias("gap"))).groupBy("length", "gap").count().collect()
        waiting = Counter({r.length: r["count"] for r in tally if not r.gap})
        least = min(waiting, default=capacity + 1)
        gaps = gaps.filter(F.col("size") >= least).select("size", "sequence_id")
        free = Counter({r.length: r["count"] for r in tally if r.gap and r.length >= least})
    drop(pieces)
    return reduce(DataFrame.unionByName, done) if done else spark.createDataFrame([], f"{PIECES}, sequence_id long, offset long")


_PLACED = ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def _across(swept: DataFrame, capacity: int) -> tuple[DataFrame | None, DataFrame | None]:
    """Waiting pieces and free gaps with the number they pair up under (-1: none), and the pieces that go to a gap."""
    tally: dict[int, list[int]] = {}
    for r in swept.filter("rank >= 0").groupBy("part", "what").agg(F.count("*").alias("n"), F.min("size").alias("lo"), F.max("size").alias("hi")).collect():
        at = tally.setdefault(r.part, [r.part, 0, 0, 0, 0])
        at[1 if r.what == 2 else 3], at[2 if r.what == 2 else 4] = r.n, r.lo if r.what == 2 else r.hi
    stretches = brackets([tuple(tally[k]) for k in sorted(tally)])
    if not len(stretches):
        return None, None
    paired = durable(arrow(swept.filter("what > 0"), _pair, f"{SWEPT}, pair long, turn long", rows=stretches))
    room = paired.filter("what = 2 and pair >= 0").select("pair", F.col("size").alias("room"), "sequence_id")
    until = F.sum("length").over(Window.partitionBy("pair").orderBy("turn"))  # at most ``capacity`` pieces go to a gap
    pieces = paired.filter("what = 1 and pair >= 0").withColumn("until", until).drop("sequence_id", "offset")
    return paired, durable(pieces.join(room, "pair").withColumn("offset", capacity - F.col("room") + F.col("until") - F.col("length")))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(token_pieces(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: pieces with their places."""
    import public_tokenizers

    return pack(token_pieces(docs, public_tokenizers.path("word_bpe_49k.json")))
