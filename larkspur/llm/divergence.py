"""How far the sources of a language differ, by wide term vectors.

Each kept term of a language is pivoted into one array that is indexed by source: (place of the
source, occurrences there), by place; zeros are left out, as most terms stand in few sources. Higher-order
functions emit what a term adds to each pair of sources, and a map-side aggregation sums it.

A zero's p is the same for all terms of a source (``p0``), so what a pair (a, b) sums over all kept terms is

- V x f(p0 of a, p0 of b), as if no term occurred in either,
- for each term of a, f(p, p0 of b) instead of that, and for each term of b likewise. Terms that occur
  equally often in a source add the same: they are counted by (source, occurrences) first,
- for each term of both, f(p of a, p of b) instead of those two.

So only terms that two sources share emit pairs, and an array's pairs are emitted one source at a
time, from a row each. The sums are whole numbers below 2^63 up to 2^30 kept terms a language, and p is divided
out a thousandfold at a time, so it is exact up to 2^53 occurrences.

Defined results: a null text, lang or source is an empty one; each row is a document, whatever its doc_id; a text of
any length is read whole; a language whose terms are all rare has V = 0, pairs of value 0 and no terms; values that
tie rank by item in UTF-8 order; an empty table gives an empty table; no other column is read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import STEP_CHARS, arrow, durable, read

#: A term is kept by a language in at least so many of its documents.
LEAST_DOCS = 3
#: Ranks of the terms that set a source apart.
TERM_RANKS = 200
#: Terms that one task counts before it hands them on.
HELD = 300_000
#: A language's row of sources meets its terms in so many parts.
SALTS = 32

#: Bytes of UTF-8: capital letters fold, all that is neither a letter nor beyond ASCII parts words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _words(text: str) -> Iterator[list[bytes]]:
    """A text's terms, about STEP_CHARS bytes at a time."""
    data, at = text.encode().translate(_FOLD), 0
    while at < len(data):
        end = data.find(b" ", at + STEP_CHARS)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of what a task reads, summed up before it is shuffled."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def emit() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            for at in range(0, len(terms), 50_000):
                some = terms[at : at + 50_000]
                same = [pa.array([x] * len(some), pa.string()) for x in (lang, source)]
                counts = [pa.array([c[t] for t in some], pa.int64()) for c in (n, docs)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(some, pa.binary()).cast(pa.string()), *counts], ["lang", "source", "term", "n", "docs"])
        held.clear()

    size = 0
    for b in batches:
        for lang, source, text in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            before, seen = len(n), set()
            for words in _words(text):
                n.update(words)
                seen.update(words)
            docs.update(seen)
            size += len(n) - before
            if size > HELD:
                yield from emit()
                size = 0
    yield from emit()


def _p(n: str, total: str, v: str) -> str:
    """1 + floor(10^9 (n + 1) / (total + v)); where the product may not fit, by long division in steps of a thousand."""
    by = f"({total} + {v})"
    rest = [f"(({n} + 1) % {by})"]
    out = f"(({n} + 1) div {by}) * 1000000000"
    for scale in (1_000_000, 1000, 1):
        out += f" + (({rest[-1]} * 1000) div {by}) * {scale}"
        rest.append(f"(({rest[-1]} * 1000) % {by})")
    return f"(1 + if({by} < 9000000000, (({n} + 1) * 1000000000) div {by}, {out}))"


def _f(p: str, q: str) -> str:
    return f"((({p} - {q}) * ({p} - {q})) div {q})"


def term_vectors(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(lang, term, total, entries array<(at, n)>) of kept terms, and (lang, at, source, total, lang_total, v) of all groups."""
    rows = docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    counts = arrow(rows, _counted, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    groups = rows.select("lang", "source").distinct().withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("source")))
    placed = counts.join(groups, ["lang", "source"])
    wide = placed.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("at", "n"))).alias("entries"))
    wide = durable(wide.filter(F.col("docs") >= LEAST_DOCS).drop("docs"))
    of_groups = wide.select("lang", F.inline("entries")).groupBy("lang", "at").agg(F.sum("n").alias("total"))
    of_langs = wide.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_total"))
    known = groups.join(of_groups, ["lang", "at"], "left").join(of_langs, "lang", "left")
    return wide, durable(known.select("lang", "at", "source", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "lang_total", "v"))))


def _salted(rows: DataFrame, langs: DataFrame, by: str) -> DataFrame:
    """``rows`` with their language's array of sources; a language with most of the rows is no hot key."""
    each = langs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.hash(by), F.lit(SALTS))).join(each, ["lang", "salt"]).drop("salt")


def divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): how far each other source of the language is, and the terms that set a source apart."""
    wide, known = term_vectors(docs, lang_col, source_col, text_col)
    zero = F.when(F.col("v") > 0, F.expr(_p("0", "total", "v"))).alias("p0")
    held = known.select("lang", "lang_total", "v", F.struct("at", "source", "total", zero).alias("s"))
    langs = held.groupBy("lang", "lang_total", "v").agg(F.sort_array(F.collect_list("s")).alias("sources"))

    # what a lambda computes is interpreted, so lambdas only make and pick pairs; the rest is compiled
    vectors = _salted(wide, langs, "term")
    terms = vectors.select("lang", F.col("term").alias("item"), "v", F.expr(_p("total", "lang_total", "v")).alias("q"), "sources", F.inline("entries"))
    terms = terms.select("lang", "item", "q", F.expr("element_at(sources, at).source").alias("source"), F.expr(_p("n", "element_at(sources, at).total", "v")).alias("p")).filter("p > q")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), "item", F.expr(_f("p", "q")).alias("value"))

    entry = f"struct(e.at AS at, {_p('e.n', 'element_at(sources, e.at).total', 'v')} AS p, element_at(sources, e.at).p0 AS p0)"
    shared = vectors.filter(F.size("entries") > 1).select("lang", F.expr(f"transform(entries, e -> {entry})").alias("entries"))
    shared = shared.select("lang", "entries", F.explode("entries").alias("x")).select("lang", "x", F.explode(F.expr("filter(entries, y -> y.at > x.at)")).alias("y"))

    def added(x: str, y: str) -> Column:
        return F.expr(f"{_f(f'{x}.p', f'{y}.p')} - {_f(f'{x}.p', f'{y}.p0')} - {_f(f'{x}.p0', f'{y}.p')} + {_f(f'{x}.p0', f'{y}.p0')}")

    shared = shared.groupBy("lang", F.col("x.at").alias("x"), F.col("y.at").alias("y")).agg(F.sum(added("x", "y")).alias("xy"), F.sum(added("y", "x")).alias("yx"))
    shared = shared.select("lang", F.expr("inline(array(struct(x AS a, y AS b, xy AS value), struct(y AS a, x AS b, yx AS value)))"))
    often = wide.select("lang", F.inline("entries")).groupBy("lang", "at", "n").agg(F.count("*").alias("m"))
    often = _salted(often, langs, "n").select("lang", "m", "sources", F.expr("element_at(sources, at)").alias("a"), F.expr(_p("n", "element_at(sources, at).total", "v")).alias("p"))
    there = f"struct(a.at AS a, b.at AS b, m * ({_f('p', 'b.p0')} - {_f('a.p0', 'b.p0')}) AS value)"
    back = f"struct(b.at AS a, a.at AS b, m * ({_f('b.p0', 'p')} - {_f('b.p0', 'a.p0')}) AS value)"
    often = often.select("lang", F.expr(f"inline(flatten(transform(filter(sources, b -> b.at <> a.at), b -> array({there}, {back}))))"))
    base = langs.select("lang", "v", "sources", F.explode("sources").alias("a"))
    none = f"struct(b.at AS b, coalesce(v * {_f('a.p0', 'b.p0')}, 0L) AS value, b.source AS item)"
    base = base.select("lang", F.col("a.at").alias("a"), F.col("a.source").alias("source"), F.expr(f"inline(transform(filter(sources, b -> b.at <> a.at), b -> {none}))"))
    every = base.unionByName(shared, allowMissingColumns=True).unionByName(often, allowMissingColumns=True)
    pairs = every.groupBy("lang", "a", "b").agg(F.max("source").alias("source"), F.max("item").alias("item"), F.sum("value").alias("value"))

    def ranked(rows: DataFrame) -> DataFrame:
        by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        return rows.withColumn("rank", F.row_number().over(by))

    pairs = ranked(pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value"))
    return pairs.unionByName(ranked(terms).filter(F.col("rank") <= TERM_RANKS))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(read(spark, sf_dir, "documents"))
