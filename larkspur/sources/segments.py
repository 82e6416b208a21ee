"""A keyword index of immutable segments: positions in postings, tombstones, tiered merges, exact top k by block maxima.

A segment is written once. Its documents are dealt into blocks by their hash, and its postings table has a row for each
(term, block): how many documents, the highest score of any of them (``top``), and the documents with length and
positions. A block is inverted where its documents are, so only texts are shuffled, never a row a token; each file holds whole
blocks, sorted by (term, block), so that a query's terms and blocks are pushed-down filters.
What an upsert or a delete takes away is a row of a tombstone table; documents of the same segment never
share an id. Once a level has MERGE segments they become one of the next level: postings are taken over
without the dead, no text is read again. So what a sync writes follows what has changed.

The pointer file holds the list of segments with their numbers of documents and tokens; it is replaced after
all tables are written. Statistics follow deletions: counts of documents and tokens leave the list, and
document frequencies are those of living postings.

Defined results: rows that repeat an id within one upsert count once, by their largest text; rows without an
id are left out; a null text is an empty one, which counts as a document without tokens; no document at all gives no hits.
"""

from __future__ import annotations

import json
import math
import operator
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import bm25
from ..operators.query import Group, Leaf, Parsed, Range, parse
from ..operators.scratch import releasing
from .index import _fs

#: Documents of a block, about; segments of a level that are merged.
BLOCK, MERGE = 128, 4
#: Blocks that are scored first, to know what the others must reach.
FIRST = 64
#: So many blocks are named in a pushed-down filter; more are joined.
NAMED = 1000
#: Scores are compared after rounding, so bounds are widened by as much.
SLACK = 10.0**-bm25.DECIMALS
F_ = bm25.KEYWORD


def _impact(tf: Column, dl: Column, avgdl: float | Column) -> Column:
    return tf * (F_.k1 + 1) / (tf + F_.k1 * (1 - F_.b + F_.b * F.greatest(dl, F.lit(1)) / avgdl))


def _inverted(avgdl: float):  # noqa: ANN202
    """For ``mapInArrow``: (block, doc, dl, tokens), in order of blocks, to (term, block, n, top, hits). It holds a batch and what a block has from the batch before."""

    def invert(rows):  # noqa: ANN001, ANN202
        import numpy as np
        import pyarrow as pa

        rows = rows.combine_chunks()
        block, doc, dl, tokens = (c.chunk(0) for c in rows.columns)
        block, size = block.to_numpy(), np.diff(tokens.offsets.to_numpy())
        words = tokens.flatten().dictionary_encode()
        row = np.repeat(np.arange(len(size)), size)
        at = (np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)).astype("int32")
        key = block[row].astype("int64") * len(words.dictionary) + words.indices.to_numpy()
        order = np.argsort(key, kind="stable")  # within a (block, term) documents and places keep their order
        key, row, at = key[order], row[order], at[order]
        of_term = np.append(True, key[1:] != key[:-1])
        first = np.flatnonzero(of_term | np.append(True, row[1:] != row[:-1]))  # of each (block, term, document)
        begin = np.flatnonzero(of_term[first])  # of each (block, term), among those
        tf, row = np.diff(np.append(first, len(key))), row[first]
        impact = tf * (F_.k1 + 1) / (tf + F_.k1 * (1 - F_.b + F_.b * np.maximum(dl.to_numpy()[row], 1) / avgdl))
        lists = lambda begins, values: pa.ListArray.from_arrays(pa.array(np.append(begins, len(values)).astype("int32")), values)
        hits = pa.StructArray.from_arrays([doc.take(pa.array(row)), dl.take(pa.array(row)), lists(first, pa.array(at))], ["doc", "dl", "at"])
        each = key[first[begin]]
        return pa.RecordBatch.from_arrays(
            [words.dictionary.take(pa.array(each % len(words.dictionary))), pa.array((each // len(words.dictionary)).astype("int32")), pa.array(np.diff(np.append(begin, len(first)))),
             pa.array(np.maximum.reduceat(impact, begin)), lists(begin, hits)], ["term", "block", "n", "top", "hits"],
        )

    def run(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa
        import pyarrow.compute as pc

        waiting = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if waiting is None else pa.concat_tables([waiting, rows])
            last = rows["block"][-1]
            whole = rows.filter(pc.not_equal(rows["block"], last))
            waiting = rows.filter(pc.equal(rows["block"], last))
            if whole.num_rows:
                yield invert(whole)
        if waiting is not None:
            yield invert(waiting)

    return run


@dataclass(frozen=True)
class Report:
    """Blocks of a query's terms, and those whose documents were read."""

    blocks: int
    read: int


class SegmentIndex:
    """Documents (id, text) below ``home``; ids are of one type."""

    def __init__(self, spark: SparkSession, home: str, block: int = BLOCK, merge: int = MERGE, first: int = FIRST) -> None:
        self.spark, self.home, self.block, self.merge, self.first = spark, home, block, merge, first
        fs, path = _fs(spark, f"{home}/SEGMENTS")
        self.state = json.loads("".join(r[0] for r in spark.read.text(f"{home}/SEGMENTS").collect())) if fs.exists(path) else {"segments": [], "dead": [], "n_docs": 0, "total": 0}

    # writing

    def upsert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), blanks: bool = True) -> None:
        """Adds documents; those that are there are replaced.

        ``keep`` names columns that ``live`` gives back; without ``blanks`` an empty text is kept but is no document of the statistics.
        """
        more = [c for c in keep if c != "text"]
        one = F.max(F.struct(F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more)).alias("x")
        rows = docs.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc")).agg(one).select("doc", "x.*")
        tokens = T.keyword_tokens(F.col("text"))
        counted = F.lit(True) if blanks else F.col("text") != ""
        name = self._lengths(rows.select("doc", F.when(counted, F.size(tokens)).alias("dl"), *keep))
        segment = self._sized(name, 0)
        if not segment["rows"]:
            self._remove(name)
            return
        if "text" in keep:  # then the source need not be read again
            held = self._table(name, "docs").select("doc", "text").withColumn("block", self._block(segment)).repartition("block")
        else:
            held = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
            held = held.withColumn("block", self._block(segment)).repartition("block").groupBy("block", "doc").agg(F.max("text").alias("text"))
        held = held.select("block", "doc", tokens.alias("tokens")).filter(F.size("tokens") > 0).select("block", "doc", F.size("tokens").alias("dl"), "tokens").sortWithinPartitions("block")
        kind = held.schema["doc"].dataType.simpleString()
        schema = f"term string, block int, n long, top double, hits array<struct<doc:{kind},dl:int,at:array<int>>>"
        self._written(segment, held.mapInArrow(_inverted(segment["avgdl"]), schema))
        self._bury(self._table(name, "docs").select("doc"))
        self._add(segment)

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> None:
        if self._bury(ids.select(F.col(id_col).alias("doc")).filter("doc is not null").distinct()):
            self._save()

    def _remove(self, name: str) -> None:
        fs, path = _fs(self.spark, f"{self.home}/{name}")
        fs.delete(path, True)

    def _table(self, name: str, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.home}/{name}/{table}")

    def _lengths(self, docs: DataFrame) -> str:
        name = uuid.uuid4().hex
        docs.write.parquet(f"{self.home}/{name}/docs")
        return name

    def _sized(self, name: str, level: int) -> dict:
        rows, n, total = self._table(name, "docs").agg(F.count("*"), F.count("dl"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        return {"name": name, "level": level, "rows": rows, "docs": n, "blocks": -(-n // self.block), "avgdl": max(total, 1) / max(n, 1), "total": total}

    def _block(self, segment: dict) -> Column:
        return F.pmod(F.xxhash64("doc"), F.lit(max(segment["blocks"], 1))).cast("int")

    def _postings(self, segment: dict, places: DataFrame) -> None:
        """places: (doc, dl, term, at)."""
        rows = places.withColumn("block", self._block(segment)).repartition("block")
        top = F.max(_impact(F.size("at"), F.col("dl"), F.lit(segment["avgdl"])))
        self._written(segment, rows.groupBy("term", "block").agg(F.count("*").alias("n"), top.alias("top"), F.collect_list(F.struct("doc", "dl", "at")).alias("hits")))

    def _written(self, segment: dict, postings: DataFrame) -> None:
        postings.sortWithinPartitions("term", "block").write.parquet(f"{self.home}/{segment['name']}/postings")

    def _union(self, table: str, f) -> DataFrame | None:  # noqa: ANN001
        each = [f(self._table(s["name"], table)).withColumn("segment", F.lit(s["name"])) for s in self.state["segments"]]
        return reduce(DataFrame.unionByName, each) if each else None

    def _dead(self) -> DataFrame | None:
        """(segment, doc)."""
        each = [self.spark.read.parquet(f"{self.home}/{d}") for d in self.state["dead"]]
        return reduce(DataFrame.unionByName, each) if each else None

    def _bury(self, ids: DataFrame) -> bool:
        """Tombstones for the living documents of these ids; the counts lose them. Whether there were any."""
        live = self._union("docs", lambda t: t.select("doc", "dl"))
        if live is None:
            return False
        if (dead := self._dead()) is not None:
            live = live.join(dead, ["segment", "doc"], "left_anti")
        name = f"dead-{uuid.uuid4().hex}"
        live.join(ids, "doc", "left_semi").select("segment", "doc", "dl").write.parquet(f"{self.home}/{name}")
        rows, n, total = self.spark.read.parquet(f"{self.home}/{name}").agg(F.count("*"), F.count("dl"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        if not rows:
            self._remove(name)
            return False
        self.state = {**self.state, "dead": [*self.state["dead"], name], "n_docs": self.state["n_docs"] - n, "total": self.state["total"] - total}
        return True

    def _add(self, segment: dict) -> None:
        self.state = {**self.state, "segments": [*self.state["segments"], segment], "n_docs": self.state["n_docs"] + segment["docs"], "total": self.state["total"] + segment["total"]}
        for level in range(64):
            same = [s for s in self.state["segments"] if s["level"] == level]
            if len(same) < self.merge:
                break
            self._merge(same, level + 1)
        self._save()

    def _merge(self, old: list[dict], level: int) -> None:
        names = [s["name"] for s in old]
        here, dead = F.col("segment").isin(names), self._dead()
        docs, hits = self._union("docs", lambda t: t).filter(here), self._union("postings", lambda t: t.select("term", F.inline("hits"))).filter(here)
        if dead is not None:
            docs, hits = (x.join(dead.select("segment", "doc"), ["segment", "doc"], "left_anti") for x in (docs, hits))
        segment = self._sized(self._lengths(docs.drop("segment")), level)
        self._postings(segment, hits.select("doc", "dl", "term", "at"))
        kept = [s for s in self.state["segments"] if s["name"] not in names]
        rest = []
        if dead is not None and kept:
            rest = [f"dead-{uuid.uuid4().hex}"]
            dead.filter(~here).write.parquet(f"{self.home}/{rest[0]}")
        self.state = {**self.state, "segments": [*kept, segment], "dead": rest}

    def _save(self) -> None:
        """The new list takes the old one's place. What the old one names stays for who still reads it; what only lists before it named goes."""
        fs, path = _fs(self.spark, f"{self.home}/SEGMENTS")
        before = json.loads("".join(r[0] for r in self.spark.read.text(f"{self.home}/SEGMENTS").collect())) if fs.exists(path) else None
        names = lambda state: {s["name"] for s in state["segments"]} | {*state["dead"]}
        gone = {*before.get("old", [])} - names(before) - names(self.state) if before else set()
        self.state = {**self.state, "old": sorted(names(before)) if before else []}
        out = fs.create(path, True)
        out.write(json.dumps(self.state).encode())
        out.close()
        for name in gone:
            self._remove(name)

    # reading

    def live(self) -> DataFrame | None:
        """(doc, dl, kept columns...) of living documents; None if nothing was ever added."""
        docs, dead = self._union("docs", lambda t: t), self._dead()
        if docs is not None and dead is not None:
            docs = docs.join(dead.select("segment", "doc"), ["segment", "doc"], "left_anti")
        return None if docs is None else docs.drop("segment")

    def _hits(self, wanted: Column, blocks: DataFrame | None = None) -> DataFrame:
        """(segment, block, term, doc, dl, at) of living documents, of these (segment, block) alone if given."""
        rows = self._union("postings", lambda t: t.filter(wanted).select("term", "block", "hits"))
        if blocks is not None:
            rows = rows.join(blocks, ["segment", "block"], "left_semi")
        rows = rows.select("segment", "block", "term", F.inline("hits"))
        dead = self._dead()
        return rows if dead is None else rows.join(dead.select("segment", "doc"), ["segment", "doc"], "left_anti")

    def _scored(self, hits: DataFrame, parsed: Parsed, dfs: dict[str, int]) -> DataFrame:
        """(doc, score) of the documents that match, by the tree over each document's postings."""
        leaves = sorted({t for p in _leaves(parsed.root) if isinstance(p, Leaf) for t in p.tokens})
        place = {t: f"t{k}" for k, t in enumerate(leaves)}
        ranges = [p for p in _leaves(parsed.root) if isinstance(p, Range)]
        found = [F.max(F.when(F.col("term") == t, F.col("at"))).alias(c) for t, c in place.items()]
        inside = [F.max(F.when(_inside(r), True)).alias(f"r{k}") for k, r in enumerate(ranges)]
        rows = hits.groupBy("segment", "doc").agg(F.first("dl").alias("dl"), *found, *inside)

        def holds(part: Leaf | Range | Group) -> Column:
            if isinstance(part, Range):
                return F.coalesce(F.col(f"r{next(k for k, r in enumerate(ranges) if r is part)}"), F.lit(False))
            if isinstance(part, Leaf):
                there = reduce(operator.and_, [F.col(place[t]).isNotNull() for t in part.tokens])
                rest = [(place[t], k) for k, t in enumerate(part.tokens) if k]
                if not rest:
                    return there
                follows = F.exists(place[part.tokens[0]], lambda x: reduce(operator.and_, [F.array_contains(F.col(c), x + k) for c, k in rest]))
                return F.coalesce(there & follows, F.lit(False))
            out = [*map(holds, part.must), *(~holds(p) for p in part.must_not)]
            if not part.must:
                out.append(reduce(operator.or_, map(holds, part.may)))
            return reduce(operator.and_, out)

        avgdl = max(self.state["total"], 1) / max(self.state["n_docs"], 1)
        total: Column = F.lit(0.0)
        for t, w in parsed.terms.items():
            if dfs.get(t):
                idf = F.log(F.lit((self.state["n_docs"] - dfs[t] + 0.5) / (dfs[t] + 0.5) + 1))
                total = total + F.when(F.col(place[t]).isNotNull(), w * idf * _impact(F.size(place[t]), F.col("dl"), F.lit(avgdl))).otherwise(0.0)
        more = reduce(operator.add, [F.when(holds(r), F.lit(w)).otherwise(0.0) for r, w in parsed.ranges], F.lit(0.0))
        score = F.round(F.round(total, bm25.DECIMALS) + more, bm25.DECIMALS)
        return rows.filter(holds(parsed.root)).select("doc", score.alias("score")).filter("score > 0")

    def _wanted(self, parsed: Parsed) -> Column:
        leaves = _leaves(parsed.root)
        terms = sorted({t for p in leaves if isinstance(p, Leaf) for t in p.tokens})
        return reduce(operator.or_, [F.col("term").isin(terms), *(_inside(r) for r in leaves if isinstance(r, Range))])

    def _nothing(self) -> DataFrame:
        kind = self._union("docs", lambda t: t).schema["doc"].dataType.simpleString() if self.state["segments"] else "string"
        return self.spark.createDataFrame([], f"doc {kind}, score double")

    def search(self, query: str, k: int = 10) -> DataFrame:
        """(doc, score) in the grammar of ``operators.query``, from the postings of the query's terms alone."""
        parsed = parse(query)
        if parsed is None or parsed.root is None or k <= 0 or not self.state["segments"]:
            return self._nothing()
        scoring = F.col("term").isin(list(parsed.terms))
        dfs = {r["term"]: r["count"] for r in self._hits(scoring).groupBy("term").count().collect()}  # a row a term of the query
        return self._scored(self._hits(self._wanted(parsed)), parsed, dfs).orderBy(F.desc("score"), "doc").limit(k)

    def search_pruned(self, query: str, k: int = 10) -> tuple[DataFrame, Report]:
        """The same hits for plain terms, any of which may match; only blocks whose bound reaches the k-th best are read.

        A block's bound is the sum over terms of weight, idf and ``top``, the largest of its documents' scores at the
        segment's average length; a collection that is longer on average by some factor can raise scores by that factor at most.
        """
        parsed = parse(query)
        if parsed is None or parsed.root is None or k <= 0 or not self.state["segments"]:
            return self._nothing(), Report(0, 0)
        if parsed.root.must or parsed.root.must_not or not all(isinstance(p, Leaf) and len(p.tokens) == 1 for p in parsed.root.may):
            raise ValueError("pruning is for plain terms")
        wanted = F.col("term").isin(list(parsed.terms))
        heads = self._union("postings", lambda t: t.filter(wanted).select("term", "block", "n", "top"))
        dfs = {r["term"]: r["n"] for r in heads.groupBy("term").agg(F.sum("n").alias("n")).collect()}
        if (dead := self._dead()) is not None:  # of blocks with dead documents, those are counted
            sizes = F.create_map(*[F.lit(x) for s in self.state["segments"] for x in (s["name"], max(s["blocks"], 1))])
            touched = dead.select("segment", "doc", F.pmod(F.xxhash64("doc"), sizes[F.col("segment")]).cast("int").alias("block"))
            rows = self._union("postings", lambda t: t.filter(wanted)).join(touched.select("segment", "block").distinct(), ["segment", "block"], "left_semi")
            gone = rows.select("segment", "term", F.inline("hits")).join(dead.select("segment", "doc"), ["segment", "doc"], "left_semi")
            for r in gone.groupBy("term").count().collect():
                dfs[r["term"]] -= r["count"]
        avgdl = max(self.state["total"], 1) / max(self.state["n_docs"], 1)
        weigh = F.create_map(*[F.lit(x) for t, w in parsed.terms.items() for x in (t, float(w) * _idf(self.state["n_docs"], max(dfs.get(t, 0), 0)))])
        rise = F.create_map(*[F.lit(x) for s in self.state["segments"] for x in (s["name"], max(1.0, avgdl / s["avgdl"]))])
        bounds = heads.groupBy("segment", "block").agg(F.sum(weigh[F.col("term")] * F.col("top") * rise[F.col("segment")]).alias("bound")).persist()
        blocks = bounds.count()
        best = bounds.orderBy(F.desc("bound"), "segment", "block").limit(self.first)
        first = self._read(wanted, best.collect())
        top = self._scored(first, parsed, dfs).orderBy(F.desc("score"), "doc").limit(k).persist()
        scores = [r["score"] for r in top.collect()]  # k rows
        least = scores[-1] - SLACK if len(scores) == k else 0.0
        rest = bounds.filter(F.col("bound") >= least).join(F.broadcast(best.select("segment", "block")), ["segment", "block"], "left_anti")
        n = rest.count()
        out = top
        if n:
            more = self._read(wanted, rest.collect()) if n <= NAMED else self._hits(wanted, rest.select("segment", "block"))
            out = top.unionByName(self._scored(more, parsed, dfs)).orderBy(F.desc("score"), "doc").limit(k)
        return releasing(out.select("*"), top, bounds), Report(blocks, min(blocks, self.first) + n)

    def _read(self, wanted: Column, blocks: list) -> DataFrame:
        """Hits of few blocks, which are named in a filter that the scan skips pages by."""
        named: dict[str, list[int]] = {}
        for r in blocks:
            named.setdefault(r["segment"], []).append(r["block"])
        each = [self._table(s, "postings").filter(wanted & F.col("block").isin(b)).select(F.lit(s).alias("segment"), "block", "term", F.inline("hits")) for s, b in named.items()]
        rows = reduce(DataFrame.unionByName, each) if each else self._hits(F.lit(False))
        dead = self._dead()
        return rows if dead is None or not each else rows.join(dead.select("segment", "doc"), ["segment", "doc"], "left_anti")


def _idf(n: int, df: int) -> float:
    return math.log((n - df + 0.5) / (df + 0.5) + 1)


def _leaves(part: Group) -> list[Leaf | Range]:
    """All leaves, those that must not match too."""
    out = []
    for p in [*part.must, *part.may, *part.must_not]:
        out += _leaves(p) if isinstance(p, Group) else [p]
    return out


def _inside(r: Range) -> Column:
    t = F.col("term")
    low = F.lit(True) if r.low is None else (t >= r.low if r.closed[0] else t > r.low)
    return low & (F.lit(True) if r.high is None else (t <= r.high if r.closed[1] else t < r.high))
