"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next stage's docs. All but the last return the columns of ``documents``, and further columns
that docs have, whatever their names.

Defined results, each stage's being its operator's: a null text is judged as an empty one and stays null until it is
packed, as the end mark alone; texts of any length are read whole; rows without a doc_id are judged by the classifier, and
the later stages keep them; rows that repeat a doc_id are rows of their own, and all of them go if the classifier rejects one; of
texts that are similar, or tie, the one with the smallest doc_id stays; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm import packing, pii, quality, simhash, substring_dedup
from larkspur.llm.common import delete, scope, shared_dir

STAGES = [
    ("quality classifier", quality.stage),
    ("simhash near-dedup", simhash.stage),
    ("substring dedup", substring_dedup.stage),
    ("pii", pii.stage),
    ("best-fit packing", packing.stage),
]

#: Fingerprint majorities, a fitted classifier and packing aren't expressible in SQL; the tests hold
#: run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each stage returns is written to the shared folder, and goes once the next one is."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        with scope(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{top}/{k}")
        if k:
            delete(spark, f"{top}/{k - 1}")
        docs = spark.read.parquet(f"{top}/{k}")
    return docs
