"""Keyed state that streams share between batches and restarts: typed state in RocksDB, and a sink that a replay doesn't change.

A stream's results are written under the number of their batch, so a batch that is run again after a failure overwrites
what it wrote before, and readers take the latest of each key.
"""

from __future__ import annotations

import contextlib
import hashlib
import math
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions import validate as V
from ..operators.login import ID_CHARS, SESSION_S

STORES = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.maintenanceInterval": "2s",
    # state that ends by the clock asks for one more batch for ever, so a run that ends takes none without data
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
#: Hits that a search may ask for, at most.
LIMIT = 50
#: Keys are dealt into so many groups by their hash: a group costs a few state calls and frames however many keys it has. Fixed for the life of a checkpoint.
BUCKETS = 1024


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


def versioned(folder: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: each batch is a folder of its own, which a replay writes anew."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")

    return write


def latest(spark: SparkSession, folder: str, schema: str, keys: list[str]) -> DataFrame:
    """All rows that each key's last batch wrote."""
    rows = spark.read.schema(f"{schema}, epoch long").parquet(folder)
    last = rows.groupBy(*keys).agg(F.max("epoch").alias("epoch"))  # one row a key and task before it shuffles
    return rows.join(last, [*keys, "epoch"], "left_semi").drop("epoch")


def upserted(spark: SparkSession, folder: str, schema: str, key: str, by: list[str]) -> DataFrame:
    """One row a key: of each column the value that was last given, by batch and then ``by`` within it."""
    rows = spark.read.schema(f"{schema}, epoch long").parquet(folder)
    columns = [c for c in rows.columns if c not in (key, "epoch", *by)]
    order = F.struct("epoch", *by)
    return rows.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in columns])


def run(rows: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Takes in what is there, to ``folder``, and ends; started again on the same checkpoint it goes on from there. Returns the query, which has ended."""
    with settings(rows.sparkSession, STORES):  # the stream has a copy of the session's settings from its start on
        query = rows.writeStream.foreachBatch(versioned(folder)).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def _bucket(*keys: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


MERGED = "origin string, search_id long, rank int, peer string, doc string, score double"


def merge_hits(hits: DataFrame, ttl_ms: int = 900_000, buckets: int = BUCKETS) -> DataFrame:
    """Best hits of each search so far, as updates; from (origin, search_id, lim, peer, doc, score), as ``live.merge_hits``.

    A search's limit and best hits are one entry of its group's MapState, which ends ``ttl_ms`` after it was last written. A row
    without a doc opens a search; hits of a search that isn't open by the end of their batch are ignored. No more than LIMIT hits are held.
    """

    class Merge(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.held = handle.getMapState("searches", "origin string, search_id long", "lim int, score array<double>, peer array<string>, doc array<string>", ttl_ms)

        def handleInputRows(self, key, rows, timerValues):  # noqa: ANN001, ANN201, N802, N803
            import pandas

            best, opened = {}, {}
            trim = lambda x: sorted(x, key=lambda h: (-h[0], h[1], h[2]))[:LIMIT]
            for b in rows:
                b = b.astype({"score": float}).astype(object).where(b.notna(), None)
                for origin, search, limit, score, peer, doc in zip(*(b[c] for c in ("origin", "search_id", "lim", "score", "peer", "doc")), strict=True):
                    which = (origin, search)
                    some = best.setdefault(which, [])
                    if doc is None:
                        opened[which] = min(opened.get(which, LIMIT), int(limit))
                        continue
                    some.append((math.nan if score is None else score, peer, doc))
                    if len(some) >= 8 * LIMIT:
                        some[:] = trim(some)
            out = []
            for which, some in best.items():
                known = self.held.getValue(which)
                if known is None and which not in opened:
                    continue
                limit = max(1, min(LIMIT, opened[which])) if known is None else int(known[0])
                before = [] if known is None else zip(known[1], known[2], known[3], strict=True)
                held = trim([*before, *some])[:limit]
                self.held.updateValue(which, (limit, *([x[k] for x in held] for k in range(3))))
                out += [(*which, rank, peer, doc, score) for rank, (score, peer, doc) in enumerate(held, 1)]
            if out:
                yield pandas.DataFrame(out, columns=["origin", "search_id", "rank", "peer", "doc", "score"])

        def close(self) -> None:
            pass

    grouped = hits.withColumn("bucket", _bucket("origin", "search_id", buckets=buckets)).groupBy("bucket")
    return grouped.transformWithStateInPandas(statefulProcessor=Merge(), outputStructType=MERGED, outputMode="update", timeMode="processingTime")


JUDGED = "attempt long, user string, challenge string, verdict string, session_expires long"


def finish(messages: DataFrame, users: DataFrame, node: str, keep_s: int = 3600, buckets: int = BUCKETS) -> DataFrame:
    """(attempt, user, challenge, verdict, session_expires), as ``login.finish``, of a stream of challenges and attempts.

    messages: (ts, challenge, owner, expires, used, nonce) of those that are issued, (ts, challenge, attempt, user, proof, now) of attempts, and nulls for the rest. A
    challenge is state, and what uses it up is written with the batch: of right attempts in one batch or several only the first
    works, whatever is started anew between. It is forgotten, by an event-time timer, ``keep_s`` after it expires; attempts are then
    not_found, and rows that come later than the watermark's ten minutes are dropped.

    Challenges share a group by their hash. A batch appends what it issues and what it uses up to two lists of the group, and reads those
    of groups that it has rows for; what is forgotten leaves them once a timer runs out.
    """
    wide = messages.join(users.select("user", "locked", "pw_hash", F.lit(True).alias("known")), "user", "left")
    wide = wide.withColumn("valid", V.name_valid(F.col("user")) & (F.length(F.trim("challenge")) == ID_CHARS)).withWatermark("ts", "10 minutes")
    issues = F.col("owner").isNotNull()  # numbers that the other kind has not are 0 rather than null, as pandas makes nulls inexact
    wide = wide.withColumns({"expires": F.when(issues, F.col("expires")).otherwise(0)} | {c: F.when(issues, 0).otherwise(F.col(c)) for c in ("attempt", "now")})

    class Once(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.held = handle.getListState("challenges", "challenge string, owner string, expires long, used boolean, nonce binary")
            self.spent = handle.getListState("spent", "challenge string")

        def judge(self, r, now, spent):  # noqa: ANN001, ANN202
            if not r.valid:
                return "invalid_input"
            if now is None:
                return "not_found"
            _, owner, expires, used, nonce = now
            if used or r.challenge in spent or owner != r.user:
                return "unauthorized"
            if expires < r.now:
                return "expired"
            if r.known is None:
                return "not_found"
            if r.locked:
                return "locked"
            digest = hashlib.sha256()
            for part in (hashlib.sha256(r.pw_hash.encode()).digest(), bytes(nonce), r.challenge.encode(), node.encode()):
                digest.update(part)
            return "ok" if digest.hexdigest() == (r.proof or "").lower() else "unauthorized"

        def handleInputRows(self, key, rows, timerValues):  # noqa: ANN001, ANN201, N802, N803
            import pandas

            held, spent = {x[0]: tuple(x) for x in self.held.get()}, {x[0] for x in self.spent.get()}
            tries, new, used_up = [], [], []
            for b in rows:
                issued = b["owner"].notna()
                for r in b[issued].itertuples():
                    if r.challenge not in held:
                        held[r.challenge] = (r.challenge, r.owner, int(r.expires), bool(r.used), bytes(r.nonce))
                        new.append(held[r.challenge])
                tries += b[~issued].itertuples()
            out = []
            for r in sorted(tries, key=lambda r: r.attempt):
                verdict = self.judge(r, held.get(r.challenge), spent)
                if verdict == "ok":
                    spent.add(r.challenge)
                    used_up.append((r.challenge,))
                out.append((int(r.attempt), r.user, r.challenge, verdict, int(r.now) + SESSION_S if verdict == "ok" else None))
            if new:
                self.held.appendList(new)
                for expires in {x[2] for x in new}:
                    self.handle.registerTimer((expires + keep_s) * 1000)
            if used_up:
                self.spent.appendList(used_up)
            if out:
                frame = pandas.DataFrame(out, columns=["attempt", "user", "challenge", "verdict", "session_expires"])
                yield frame.astype({"session_expires": "Int64"})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: ANN001, ANN201, N802, N803
            end = expiredTimerInfo.getExpiryTimeInMs()
            held = [tuple(x) for x in self.held.get()]
            left = [x for x in held if (x[2] + keep_s) * 1000 > end]
            if len(left) < len(held):
                names = {x[0] for x in left}
                spent = [tuple(x) for x in self.spent.get() if x[0] in names]
                for state, kept in ((self.held, left), (self.spent, spent)):
                    state.put(kept) if kept else state.clear()
            return iter([])

        def close(self) -> None:
            pass

    grouped = wide.withColumn("bucket", _bucket("challenge", buckets=buckets)).groupBy("bucket")
    return grouped.transformWithStateInPandas(statefulProcessor=Once(), outputStructType=JUDGED, outputMode="append", timeMode="eventTime")
