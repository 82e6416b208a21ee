"""Longest prefixes by nested intervals: one range sort and a sweep.

A prefix is the interval of the strings that begin with it, and two such intervals are nested or apart. Rules
and requests are sorted by string together; a sweep keeps the prefixes that are still open on a stack, whose
top is a request's longest. Equal requests are split by a salt, so a request with a third of all rows makes no hot task. A request
shuffles once, as it is.

Where a partition begins, prefixes from partitions before may be open. Each of them begins the partition's
first string too, so a request that finds its stack empty asks for the longest rule of what it has in common
with that string: few distinct strings, at most one for each length and partition. These are joined by equality.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts that equal requests are split into.
SALTS = 64


def longest_prefix(requests: DataFrame, rules: DataFrame, key: str = "path", id_col: str = "path_id", prefix_col: str = "prefix") -> DataFrame:
    """Requests with ``rule_`` columns of their rule (null without one): that of the longest prefix, of equals the first by id.

    Null keys and prefixes match nothing. Keys are compared by code points.
    """
    rule = rules.select(*[F.col(c).alias(f"rule_{c}") for c in rules.columns]).filter(F.col(f"rule_{prefix_col}").isNotNull())
    first = F.min_by(F.struct(*rule.columns), f"rule_{id_col}").alias("_rule")
    rule = rule.groupBy(F.col(f"rule_{prefix_col}").alias("_prefix")).agg(first)
    asked = requests.select(F.col(key).alias("_key"), F.lit(1).alias("_kind"), F.struct(*requests.columns).alias("_row"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("_salt"))
    named = rule.select(F.col("_prefix").alias("_key"), F.lit(0).alias("_kind"), F.lit(None).cast(asked.schema["_row"].dataType).alias("_row"), F.lit(-1).alias("_salt"))
    swept = asked.unionByName(named).repartitionByRange("_key", "_kind", "_salt").sortWithinPartitions("_key", "_kind", "_salt")

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begin, stack = None, []
        for b in batches:
            found, common = [], []
            for k, kind in zip(b["_key"], b["_kind"], strict=True):
                top = shared = None
                if k is not None:
                    begin = k if begin is None else begin
                    while stack and not k.startswith(stack[-1]):
                        stack.pop()
                    if kind == 0:
                        stack.append(k)
                    elif stack:
                        top = stack[-1]
                    else:
                        n = len(begin) if k.startswith(begin) else next((i for i, (x, y) in enumerate(zip(begin, k, strict=False)) if x != y), min(len(begin), len(k)))
                        shared = begin[:n]
                found.append(top)
                common.append(shared)
            out = b.assign(_found=found, _common=common)
            yield out.loc[out["_kind"] == 1, ["_row", "_found", "_common"]]

    row = asked.schema["_row"].dataType.simpleString()
    met = swept.mapInPandas(sweep, f"_row {row}, _found string, _common string")
    met = met.select("_row.*", "_found", "_common")
    # what is open where a partition begins
    longest = rule.agg(F.coalesce(F.max(F.length("_prefix")), F.lit(0))).first()[0]
    open_ = met.filter("_common is not null").select("_common").distinct()
    heads = open_.select("_common", F.explode(F.sequence(F.lit(0), F.least(F.length("_common"), F.lit(longest)))).alias("n"))
    heads = heads.withColumn("_prefix", F.expr("left(_common, n)")).join(rule.select("_prefix"), "_prefix")
    heads = heads.groupBy("_common").agg(F.max_by("_prefix", "n").alias("_carried"))
    met = met.join(heads, "_common", "left").withColumn("_prefix", F.coalesce("_found", "_carried"))
    return met.join(rule, "_prefix", "left").select(*requests.columns, "_rule.*")
