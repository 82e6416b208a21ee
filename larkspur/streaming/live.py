"""Streams: relayed copies dropped, presence, merged search results, expiry, routing by kind.

All state is keyed and has an end: duplicates by a watermark, searches and sessions by a time to live.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

HITS = "origin string, search_id long, rank int, peer string, doc string, score double"


def dedup_messages(messages: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """The first of each (kind, payload) hash within the watermark over ``ts``; works on batches too."""
    hashed = messages.withColumn("hash", F.sha2(F.concat_ws("|", "kind", "payload"), 256))
    if not messages.isStreaming:
        return hashed.dropDuplicates(["hash"])
    return hashed.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["hash"])


def message_counts(messages: DataFrame) -> DataFrame:
    """(kind, n): how many messages of each kind; works on streams too."""
    return messages.groupBy("kind").agg(F.count("*").alias("n"))


def presence(events: DataFrame) -> DataFrame:
    """(peer, online): one row a peer, by its latest event (peer, ts, seq, status discovered or expired)."""
    last = F.max_by("status", F.struct("ts", "seq"))
    return events.groupBy("peer").agg((last == "discovered").alias("online"))


def live(rows: DataFrame, now: Column | None = None) -> DataFrame:
    """Rows (expires: epoch seconds) that haven't expired: only once now is later."""
    return rows.filter(F.col("expires") >= (F.unix_timestamp() if now is None else now))


#: The kind of response that is merged into searches that are polled; others are only shown.
MERGED_KIND = "hybrid"


def merged_kind(responses: DataFrame) -> DataFrame:
    """Responses (kind, ...) of the kind that searches are merged from, without the kind."""
    return responses.filter(F.col("kind") == MERGED_KIND).drop("kind")


def poll(searches: DataFrame, hits: DataFrame, origin: str, search_id: int) -> DataFrame:
    """What a search holds so far, one row: (search_id, ok, error, partial, hits); from what ``merge_hits`` has written.

    ``searches`` (origin, search_id) are those that were opened; an unknown one is not_found. More hits
    may always come, so an answer is always partial.
    """
    ours = (F.col("origin") == origin) & (F.col("search_id") == search_id)
    last = hits.filter(ours).select(F.struct("rank", "peer", "doc", "score").alias("hit"))
    held = last.agg(F.array_sort(F.collect_list("hit")).alias("hits"))  # at most the search's limit
    known = searches.filter(ours).agg((F.count("*") > 0).alias("ok"))
    rows = known.crossJoin(held)  # one row each
    empty = F.array().cast("array<struct<rank:int,peer:string,doc:string,score:double>>")
    return rows.select(F.lit(search_id).cast("long").alias("search_id"), "ok", F.when(F.col("ok"), "").otherwise("not_found").alias("error"), F.lit(True).alias("partial"), F.when(F.col("ok"), F.col("hits")).otherwise(empty).alias("hits"))


def merge_hits(hits: DataFrame, ttl_ms: int = 900_000) -> DataFrame:
    """Best hits of each search so far, as updates; from (origin, search_id, lim, peer, doc, score).

    A row with a null doc opens a search and sets its limit; hits of a search that isn't open are
    ignored, copies are kept, late hits are merged whenever they come, and a search that is quiet
    for ``ttl_ms`` is closed. Searches are keyed by their origin too, as ids are local to a node.
    """

    def merge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = json.loads(state.get[0]) if state.exists else None
        for b in batches:
            if held is None and len(opens := b[b["doc"].isna()]):
                held = {"limit": int(opens["lim"].iloc[0]), "hits": []}
            if held is not None:
                rows = b[b["doc"].notna()]
                held["hits"] += [[float(s), p, d] for s, p, d in zip(rows["score"], rows["peer"], rows["doc"], strict=True)]
                held["hits"] = sorted(held["hits"], key=lambda x: (-x[0], x[1], x[2]))[: held["limit"]]
        if held is None:
            return
        state.update((json.dumps(held),))
        state.setTimeoutDuration(ttl_ms)
        if held["hits"]:
            s, p, d = zip(*held["hits"], strict=True)
            yield pd.DataFrame({"origin": key[0], "search_id": key[1], "rank": range(1, len(s) + 1), "peer": p, "doc": d, "score": s})

    return hits.groupBy("origin", "search_id").applyInPandasWithState(merge, HITS, "held string", "update", GroupStateTimeout.ProcessingTimeTimeout)


def route(messages: DataFrame, handlers: dict[str, Callable[[DataFrame, int], None]], checkpoint: str) -> StreamingQuery:
    """A query that hands each micro-batch's rows to the handler of their kind; other kinds are left."""

    def fan_out(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        for kind, handle in handlers.items():
            handle(batch.filter(F.col("kind") == kind), epoch)
        batch.unpersist()

    return messages.writeStream.foreachBatch(fan_out).option("checkpointLocation", checkpoint).start()


def ring(events: DataFrame, size: int = 200, by: str = "event_id") -> DataFrame:
    """The latest ``size`` events."""
    return events.orderBy(F.desc(by)).limit(size)


def every(spark: SparkSession, seconds: int, action: Callable[[], None], checkpoint: str) -> StreamingQuery:
    """Runs ``action`` each so many seconds, one after the other, until the query is stopped; such as a corpus' sync."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(lambda _, __: action()).trigger(processingTime=f"{seconds} seconds").option("checkpointLocation", checkpoint).start()
