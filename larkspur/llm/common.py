"""What the training-data operators share: input columns, Arrow streams, durable intermediate tables."""

from __future__ import annotations

import contextlib
import operator
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch; whole texts may be long, so batches are kept short.
ARROW_ROWS = 1000
#: Characters of text that one vectorised step works on at a time.
STEP_CHARS = 1_000_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text), null text as empty. Other columns, whatever their names, stay behind."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def arrow(df: DataFrame, target: Callable, schema: str, **params) -> DataFrame:
    """mapInArrow with a module-level function that workers import by name.

    The wrapper travels by value and adds the library's folder to the search path, so that
    workers in local mode find it whatever the working folder; a cluster ships the package.
    ``params`` are plain values (numbers, texts, arrays, tuples): an instance of a class of this
    library would be unpickled before the path is there.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    root, module, name = str(Path(__file__).resolve().parents[2]), target.__module__, target.__name__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import importlib
        import sys

        if root not in sys.path:
            sys.path.append(root)
        yield from getattr(importlib.import_module(module), name)(batches, **params)

    return df.mapInArrow(run, schema)


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings that hold inside, and are as before after it."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def steps(batches: Iterator[pa.RecordBatch], chars: int = STEP_CHARS, key: str = "doc_id") -> Iterator[tuple[list, list[str]]]:
    """(keys, texts) lists of about ``chars`` characters; one long text makes a list of its own."""
    ids: list[int] = []
    out: list[str] = []
    held = 0
    for batch in batches:
        for i, x in zip(batch.column(key).to_pylist(), batch.column("text").to_pylist(), strict=True):
            ids.append(i)
            out.append(x)
            held += len(x)
            if held >= chars:
                yield ids, out
                ids, out, held = [], [], 0
    if ids:
        yield ids, out


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a local one only where none is set and Spark runs on one machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='larkspur-')}"
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Durable tables of this session that are not dropped yet.
_TABLES: set[str] = set()


def durable(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: it is computed once, and a lost executor costs no rerun.

    Parquet is written rather than checkpoint()ed: it is compressed, read by column and its
    statistics are exact sizes for the planner.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/larkspur-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _TABLES.add(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _TABLES.discard(path)


def drop(df: DataFrame) -> None:
    """Deletes a durable() table that nothing reads any more."""
    spark = df.sparkSession
    ends = {x.rpartition("/")[0].rpartition("/")[2] for x in df.inputFiles()}
    for path in [t for t in _TABLES if t.rpartition("/")[2] in ends]:
        delete(spark, path)


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the durable tables that were made inside; what they led to must be written by then."""
    before = set(_TABLES)
    try:
        yield
    finally:
        for path in _TABLES - before:
            delete(spark, path)


#: Keys that more than one in so many rows have (and more than OFTEN_ROWS) meet their table without a shuffle.
OFTEN, OFTEN_ROWS = 1000, 10_000


def lookup(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the columns of ``table``, which has each of ``keys`` at most once (null where it has none).

    Keys that many rows share are counted first, and are fewer than OFTEN: their rows of ``table`` are sent to
    where ``rows`` are, and those rows, and rows without a key, are spread by a salt in the join that the others meet the table in. So no key
    makes a hot task, whatever its share. Both joins have a row for each of ``rows``.
    """
    names = [c for c in table.columns if c not in keys]
    many = rows.groupBy(*keys).count()
    most = F.lit(max(OFTEN_ROWS, rows.count() // OFTEN))
    often = many.filter(F.col("count") > most).select(*keys)
    sent = table.join(F.broadcast(often), keys, "left_semi").select(*keys, F.struct(*names).alias("_sent"))
    met = rows.join(F.broadcast(sent), keys, "left")
    meets = F.col("_sent").isNull() & reduce(operator.and_, [F.col(k).isNotNull() for k in keys])
    met = met.withColumn("_salt", F.when(meets, 0).otherwise(F.spark_partition_id() + 1))
    held = table.select(*keys, F.lit(0).alias("_salt"), F.struct(*names).alias("_held"))
    return met.join(held, [*keys, "_salt"], "left").withColumn("_found", F.coalesce("_sent", "_held")).select(*rows.columns, "_found.*")


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 100_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at least ``rows``, for steps with a cost per batch."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
