"""Hourly panes with revisions, by in-band punctuation.

Rows are cut into batches, which are written to the shared folder and fed one by one to a stateful
streaming query that is started anew for each, on one checkpoint. Panes live in state shards. Each batch,
even an empty one, also brings every shard a control row with W, the largest event time of all earlier
batches, and whether it is the last: a shard first adds what came to the panes in its MapState, then the
control row settles which are emitted, revised and forgotten.

What reaches a shard is summed before the shuffle: each task that reads a batch adds up its rows by pane, so a pane with a third of
all rows sends a row a task. Rows of panes that are closed at W stay whole, and go to shards by their id. The
driver sees one number a batch.

Defined results: rows without a time are dropped; of rows that repeat a click_id the smallest (arrived_at, ts, kind,
value) counts, and rows without one are one click, -1; without an arrived_at a row arrives on the day of its ts; a value that is null
or not finite is 0 cents; a null kind is ``none``; a batch without rows emits what became due; an empty table gives an empty table; no other
column is read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .common import arrow, delete, read, settings, shared_dir

BATCHES = 10
#: Groups of panes with a state of their own.
SHARDS = 64
#: Panes whose sums one task holds before it hands them on.
HELD = 100_000
#: Microseconds; from an hour's end until its pane is due, and closed.
HOUR, DAY = 3_600_000_000, 86_400_000_000
DUE, CLOSED = 12 * HOUR, 2 * DAY
NEVER = -(1 << 63)

FED = "kind string, hour long, event long, click_id long, cents long, shard int, w long, last boolean, batch long"
SENT = "batch long, kind string, hour long, click_id long, n long, cents long, shard int, w long, last boolean"
RESULT = "batch long, hour long, click_id long, n_rows long, cents long, record string, kind string"
#: Each batch is a run of its own, whose state stores executors keep open until maintenance finds that it has ended. There is a store for each
#: partition, however few its panes are, so stores don't take disk ahead of need. A commit
#: writes two files a partition, each by way of another name; a sum file beside each would double that, and file systems keep sums of their own.
#: Files are moved by the file system's plain rename, which took less time here than the default way (README).
STORES = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.maintenanceInterval": "2s",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.checkpoint.fileChecksum.enabled": "false",
    "spark.sql.streaming.checkpointFileManagerClass": "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager",
}


def _micros(ts: Column) -> Column:
    """Microseconds since 1970 as the clock shows them, whatever the session's zone."""
    parts = F.hour(ts) * F.lit(HOUR) + F.minute(ts).cast("long") * F.lit(HOUR // 60) + (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    return F.unix_date(ts.cast("date")) * F.lit(DAY) + parts


def cut(clicks: DataFrame) -> DataFrame:
    """(batch, kind, hour, event, click_id, cents): each click once, with the batch that it comes in."""
    one = F.min(F.struct(F.coalesce("arrived_at", "ts").alias("arrived_at"), "ts", "kind", "value")).alias("c")
    rows = clicks.filter(F.col("ts").isNotNull()).groupBy("click_id").agg(one).select("click_id", "c.*")
    day = F.unix_date(F.col("arrived_at").cast("date")).cast("long")
    rows = rows.withColumn("q", F.pmod(day, F.lit(BATCHES))).withColumn("event", _micros(F.col("ts")) - (day - F.col("q")) * DAY)
    late = F.greatest(F.lit(0), F.coalesce(F.crc32(F.col("click_id").cast("string").cast("binary")) % 30 - 23, F.lit(0)))
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    cents = F.when(finite, F.floor(100 * F.col("value") + 0.5)).otherwise(0).cast("long")
    return rows.select(
        F.least(F.lit(BATCHES - 1), F.col("q") + late).cast("long").alias("batch"), F.coalesce("kind", F.lit("none")).alias("kind"),
        F.expr(f"(event - pmod(event, {HOUR})) div {HOUR}").alias("hour"), "event", F.coalesce("click_id", F.lit(-1)).cast("long").alias("click_id"), cents.alias("cents"),
    )


def _summed(batches: Iterator[pa.RecordBatch], w: int) -> Iterator[pa.RecordBatch]:
    """A task's rows by pane; control rows, and rows of panes closed at ``w``, as they are."""
    closed = (w - CLOSED) // HOUR - 1  # the last hour that is
    held: dict[tuple[int, str, int], list[int]] = {}
    names = [x.split()[0] for x in SENT.split(", ")]

    def emit() -> Iterator[pa.RecordBatch]:
        if held:
            (batch, kind, hour), (n, cents) = (list(zip(*x, strict=True)) for x in (held.keys(), held.values()))
            rest = [[-1] * len(n), n, cents, [-1] * len(n), [0] * len(n), [False] * len(n)]
            kinds = [pa.int64(), pa.string(), *[pa.int64()] * 4, pa.int32(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([batch, kind, hour, *rest], kinds, strict=True)], names)
            held.clear()

    for b in batches:
        rows = pa.Table.from_batches([b])
        control = pc.greater_equal(rows["shard"], 0)
        whole = pc.or_(control, pc.less_equal(rows["hour"], max(closed, NEVER)))
        kept = rows.filter(whole)
        kept = kept.append_column("n", pc.cast(pc.less(kept["shard"], 0), pa.int64())).select(names)
        yield from kept.to_batches()
        sums = rows.filter(pc.invert(whole)).group_by(["batch", "kind", "hour"]).aggregate([("cents", "count"), ("cents", "sum")])
        for key, n, cents in zip(zip(*(sums[c].to_pylist() for c in ("batch", "kind", "hour")), strict=True), sums["cents_count"].to_pylist(), sums["cents_sum"].to_pylist(), strict=True):
            x = held.setdefault(key, [0, 0])
            x[0] += n
            x[1] += cents
        if len(held) > HELD:
            yield from emit()
    yield from emit()


def processor(due: int = DUE, closed: int = CLOSED, hour: int = HOUR) -> StatefulProcessor:
    """What a shard does with a batch. A class made here travels by value: workers need not find this module."""

    class Panes(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.panes = handle.getMapState("panes", "kind string, hour long", "n long, cents long, emitted boolean")

        def handleInputRows(self, key, rows, timerValues):  # noqa: ANN001, ANN201, N802, N803
            import pandas

            added: dict = {}
            batch, w, last = None, None, False
            for some in rows:
                control = some["n"] == 0
                if control.any():
                    batch, w, last = (some.loc[control, c].iloc[0] for c in ("batch", "w", "last"))
                whole = some[~control & (some["shard"] == -2)]
                if len(whole):
                    yield pandas.DataFrame({"batch": whole["batch"], "hour": whole["hour"], "click_id": whole["click_id"], "n_rows": whole["n"], "cents": whole["cents"], "record": "late", "kind": whole["kind"]})
                for pane, x in some[~control & (some["shard"] == -1)].groupby(["kind", "hour"])[["n", "cents"]].sum().iterrows():
                    n, cents = added.get(pane, (0, 0))
                    added[pane] = (n + int(x["n"]), cents + int(x["cents"]))
            out = []
            held = {(k, int(h)): (int(n), int(c), bool(e)) for (k, h), (n, c, e) in self.panes.iterator()}
            for k, h in sorted({*held, *added}):
                n, cents, emitted = held.get((k, h), (0, 0, False))
                more = added.get((k, h), (0, 0))
                now = (n + more[0], cents + more[1])
                if emitted and more[0]:
                    out += [(h, n, cents, "retract", k), (h, *now, "replace", k)]
                elif not emitted and (w >= (h + 1) * hour + due or last):
                    out.append((h, *now, "emit" if w >= (h + 1) * hour + due else "final", k))
                after = (*now, emitted or w >= (h + 1) * hour + due)
                if w >= (h + 1) * hour + closed:
                    if (k, h) in held:
                        self.panes.removeKey((k, h))
                elif after != held.get((k, h)):
                    self.panes.updateValue((k, h), after)
            if out:
                hours, ns, sums, records, kinds = zip(*out, strict=True)
                yield pandas.DataFrame({"batch": batch, "hour": hours, "click_id": -1, "n_rows": ns, "cents": sums, "record": records, "kind": kinds})

        def close(self) -> None:
            pass

    return Panes()


def _files(spark: SparkSession, path: str):  # noqa: ANN202  a file system of the JVM
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def revisions(clicks: DataFrame) -> DataFrame:
    """(batch, hour, click_id, n_rows, cents, record, kind): what each batch writes."""
    spark = clicks.sparkSession
    top = f"{shared_dir(spark)}/panes-{uuid.uuid4().hex}"
    none = [F.lit(-1).cast("int").alias("shard"), F.lit(0).cast("long").alias("w"), F.lit(False).alias("last")]
    cut(clicks).select("*", *none).hint("rebalance", "batch").write.partitionBy("batch").parquet(f"{top}/cut")
    staged = spark.read.schema(FED).parquet(f"{top}/cut")
    latest = {r["batch"]: r["event"] for r in staged.groupBy("batch").agg(F.max("event").alias("event")).collect()}  # BATCHES rows at most
    w = [max([NEVER, *(x for b, x in latest.items() if b < k)]) for k in range(BATCHES)]
    control = spark.createDataFrame([(k, w[k], k == BATCHES - 1) for k in range(BATCHES)], "batch long, w long, last boolean")
    control = control.select(F.lit("").alias("kind"), *(F.lit(0).cast("long").alias(c) for c in ("hour", "event", "click_id", "cents")), F.explode(F.sequence(F.lit(0), F.lit(SHARDS - 1))).alias("shard"), "w", "last", "batch")
    control.coalesce(1).write.mode("append").partitionBy("batch").parquet(f"{top}/cut")

    fs, fed = _files(spark, f"{top}/in")
    fs.mkdirs(fed)
    for k in range(BATCHES):
        fs.rename(_files(spark, f"{top}/cut/batch={k}")[1], _files(spark, f"{top}/in/batch={k}")[1])
        rows = spark.readStream.schema(FED).parquet(f"{top}/in").drop("event")
        # control rows keep their shard, panes have the one of their name, rows of closed panes that of their id; -1 and -2 then say which it was
        sent = arrow(rows, _summed, SENT, w=w[k])
        whole = (F.col("n") == 1) & (F.expr(f"(hour + 1) * {HOUR} + {CLOSED}") <= w[k]) & (F.col("shard") == -1)
        place = F.when(F.col("n") == 0, F.col("shard")).when(whole, F.pmod(F.hash("click_id"), F.lit(SHARDS))).otherwise(F.pmod(F.hash("kind", "hour"), F.lit(SHARDS)))
        sent = sent.select("*", place.alias("place")).withColumn("shard", F.when(whole, -2).otherwise(F.col("shard")))
        states = sent.groupBy("place").transformWithStateInPandas(statefulProcessor=processor(), outputStructType=RESULT, outputMode="append", timeMode="none")
        with settings(spark, STORES):
            query = states.writeStream.format("parquet").outputMode("append").option("path", f"{top}/out").option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    for name in ("cut", "in", "state"):
        delete(spark, f"{top}/{name}")
    return spark.read.schema(RESULT).parquet(f"{top}/out")


def op12_panes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisions(read(spark, sf_dir, "clicks"))
