"""Secret scans over a trigram inverted index, in DataFrame functions alone.

``trigrams`` derives a Boolean trigram query from each rule's regular expression. The index holds, for each
trigram that some rule asks for, the list of documents that contain it, kept by trigram in shards of
documents. A clause of a query intersects the lists of its trigrams, the clauses' results are united, and the
documents found are the rule's candidates, which the regular expression then verifies. A rule without a mandatory trigram
scans every document.

A shard has about ``SHARD`` documents, so no list is longer, however common its trigram. Documents are known by a
64-bit hash of id and text: were two to share it, both would be candidates, and verification decides. Candidates
are sent to where the texts are read while they are at most ``SENT``; beyond that texts and candidates are joined by a shuffle.

Defined results: a null or empty text has no spans; rows that repeat a doc_id, or have none, each have their own;
an empty table gives an empty table; only the id and the text are read; of matches that tie in their start the kinds' order decides;
places in a text of any length and number of matches are summed up in two levels, n^1.5 steps for n matches.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, durable, read, texts
from .trigrams import ANY, Query, query

#: Documents of a shard of the index.
SHARD = 20_000
#: Candidates, at most, that are broadcast (a hash and a few small numbers each).
SENT = 500_000


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: a match counts if this group of it has so many characters
    group: int = 0
    least: int = 1

    @cached_property
    def query(self) -> Query:
        return query(self.pattern)


RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("forge", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
BASE = ("assign", "access", "hex")
_SPANS = "array<struct<start:int,kind:int,end:int>>"


def trigram_terms(rules: tuple[Rule, ...] = RULES) -> list[str]:
    return sorted({t for r in rules for c in r.query for t in c})


def postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES, shard: int = SHARD) -> DataFrame:
    """The index: (term, shard, rows), a list of documents for each of the rules' trigrams; ``docs`` has (row, text)."""
    shards = -(-docs.count() // shard) or 1
    terms = trigram_terms(rules)
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(i)) for i, t in enumerate(terms)]).cast("array<int>"))
    each = docs.select("row", F.lower("text").alias("low")).select("row", F.explode(held).alias("term"))
    return each.groupBy("term", F.pmod("row", F.lit(shards)).alias("shard")).agg(F.collect_set("row").alias("rows"))


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(row, rules array<int>): rules one of whose clauses has the document in the lists of all its trigrams."""
    number = {t: i for i, t in enumerate(trigram_terms(rules))}
    none = F.array().cast("array<long>")
    lists = [F.first(F.when(F.col("term") == i, F.col("rows")), ignorenulls=True).alias(f"t{i}") for i in number.values()]
    shards = index.groupBy("shard").agg(F.count("*").alias("n"), *lists)

    def found(q: Query) -> Column:
        clauses = [reduce(F.array_intersect, [F.coalesce(f"t{number[t]}", none) for t in sorted(c)]) for c in sorted(q, key=sorted)]
        return reduce(F.array_union, clauses, none)

    def hit(rows: Column, k: int) -> Column:
        return F.transform(rows, lambda row: F.struct(row.alias("row"), F.lit(k).alias("rule")))

    asked = [(k, r.query) for k, r in enumerate(rules) if r.query != ANY]
    hits = [hit(found(q), k) for k, q in asked]
    some = shards.select(F.explode(F.concat(*hits)).alias("hit")) if hits else shards.select(F.struct(F.lit(0).cast("long").alias("row"), F.lit(0).alias("rule")).alias("hit")).limit(0)
    return some.groupBy("hit.row").agg(F.collect_set("hit.rule").alias("rules"))


def _spans(k: int, rule: Rule) -> Column:
    """Spans of a rule in ``text``: matches alternate with what stands between them, so lengths add up to places."""
    between = F.split("text", F.lit(rule.pattern), -1)
    whole = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0))
    part = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(rule.group))
    rows = F.transform(F.arrays_zip(between.alias("b"), whole.alias("w"), part.alias("p")), lambda x: F.struct(F.length(x["b"]).alias("gap"), F.length(x["w"]).alias("n"), F.length(x["p"]).alias("counted")))
    rows = F.filter(rows, lambda x: x["n"].isNotNull())  # what follows the last match has none
    size = F.greatest(F.lit(32), F.ceil(F.sqrt(F.size(rows)))).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(rows) / size).cast("int")), lambda j: F.slice(rows, j * size + 1, size))

    def all_of(chunk: Column, at: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            begin = acc["at"] + x["gap"]
            end = begin + x["n"]
            span = F.struct(begin.alias("start"), F.lit(k).alias("kind"), end.alias("end"))
            return F.struct(end.alias("at"), F.when(x["counted"] >= rule.least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

        return F.aggregate(chunk, F.struct(at.alias("at"), F.array().cast(_SPANS).alias("out")), step)

    def place(acc: Column, chunk: Column) -> Column:
        at = acc["at"] + F.aggregate(chunk, F.lit(0), lambda n, x: n + x["gap"] + x["n"])
        return F.struct(at.alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    begins = F.aggregate(chunks, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), place, lambda acc: acc["out"])
    return F.flatten(F.zip_with(chunks, begins, lambda chunk, at: all_of(chunk, at)["out"]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, base: tuple[str, ...] = BASE, shard: int = SHARD, sent: int = SENT) -> DataFrame:
    """Per document: n_<kind> of the base kinds, digest of the base spans and all spans (code points)."""
    keyed = texts(docs, id_col, text_col).withColumn("row", F.xxhash64("doc_id", "text"))
    kinds = [r.kind for r in rules]
    index = durable(postings(keyed.select("row", "text"), rules, shard))
    wanted = durable(candidates(index, rules))
    drop(index)
    joined = keyed.join(F.broadcast(wanted) if wanted.count() <= sent else wanted, "row", "left")
    # a match is looked for before spans are built: most of a full scan's documents hold none
    matches = [(F.lit(True) if r.query == ANY else F.array_contains("rules", k)) & F.col("text").rlike(r.pattern) for k, r in enumerate(rules)]
    each = [F.when(m, _spans(k, r)).otherwise(F.array().cast(_SPANS)) for k, (m, r) in enumerate(zip(matches, rules, strict=True))]
    spans = joined.select("doc_id", F.array_sort(F.concat(*each)).alias("spans"))
    own = [kinds.index(b) for b in base]
    is_base = F.filter("spans", lambda x: x["kind"].isin(own))

    def text_of(x: Column) -> Column:
        names = F.array(*map(F.lit, kinds))
        return F.array_join(F.transform(x, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(k: int) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{kinds[k]}")

    return spans.select("doc_id", *map(count, own), F.sha2(text_of(is_base), 256).alias("base_sha256"), text_of(F.col("spans")).alias("spans"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))
