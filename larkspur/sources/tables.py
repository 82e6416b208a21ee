"""Tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Below so many bytes for each core, a table is dealt out after reading: a small file may be one
#: row group, which one task reads alone. Larger tables have row groups for every core and aren't moved.
SMALL_BYTES = 8 << 20


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """``df``, spread over all cores if it is small; its columns and filters are still pruned at the scan."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(cores) if int(str(size)) < SMALL_BYTES * cores else df
