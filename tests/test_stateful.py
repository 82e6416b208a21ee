"""Streams with typed state: started anew, replayed, and used up once."""

import hashlib

import pytest

from larkspur.streaming import stateful

HITS = "origin string, search_id long, lim int, peer string, doc string, score double"


def feed(spark, top, rows, schema, plan, mode="append"):
    spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{top}/in")
    stateful.run(plan(spark.readStream.schema(schema).parquet(f"{top}/in")), f"{top}/out", f"{top}/state", mode)


def test_searches_over_restarts(spark, tmp_path):
    def got():
        rows = stateful.latest(spark, f"{tmp_path}/out", stateful.MERGED, ["origin", "search_id"]).collect()
        return sorted((r.origin, r.search_id, r["rank"], r.doc) for r in rows)

    hit = lambda o, s, d, x: (o, s, None, "p", d, x)
    opens = lambda o, s, n: (o, s, n, None, None, None)
    feed(spark, tmp_path, [hit("a", 1, "x", 1.0), opens("a", 1, 2), hit("a", 1, "y", 2.0), hit("b", 1, "early", 9.0)], HITS, stateful.merge_hits, "update")
    assert got() == [("a", 1, 1, "y"), ("a", 1, 2, "x")]
    feed(spark, tmp_path, [hit("a", 1, "z", 1.5), opens("b", 1, 9), hit("b", 1, "v", 1.0), hit("b", 1, "v", 1.0), opens("a", 1, 7)], HITS, stateful.merge_hits, "update")
    assert got() == [("a", 1, 1, "y"), ("a", 1, 2, "z"), ("b", 1, 1, "v"), ("b", 1, 2, "v")]
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", "")


def test_replayed_batches_change_nothing(spark, tmp_path):
    """A batch that fails after it has written is run again, and its rows are there once."""
    schema, failing = "k long, a string, b string", [True]
    spark.createDataFrame([(1, "x", None), (2, "y", None)], schema).write.parquet(f"{tmp_path}/in")
    write = stateful.versioned(f"{tmp_path}/out")

    def once(batch, epoch):
        write(batch, epoch)
        if failing:
            failing.clear()
            raise RuntimeError("lost")

    def go():
        q = spark.readStream.schema(schema).parquet(f"{tmp_path}/in").writeStream.foreachBatch(once).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination()

    with pytest.raises(Exception, match="lost"):
        go()
    go()
    spark.createDataFrame([(2, None, "z"), (3, "n", "m")], schema).write.mode("append").parquet(f"{tmp_path}/in")
    go()
    rows = stateful.upserted(spark, f"{tmp_path}/out", schema, "k", []).collect()
    assert sorted(tuple(r) for r in rows) == [(1, "x", None), (2, "y", "z"), (3, "n", "m")]
    assert spark.read.parquet(f"{tmp_path}/out").count() == 4


MESSAGES = "ts timestamp, challenge string, owner string, expires long, used boolean, nonce binary, attempt long, user string, proof string, now long"


def test_challenges_work_once(spark, tmp_path):
    users = spark.createDataFrame([("ann", False, "h"), ("bob", True, "h")], "user string, locked boolean, pw_hash string")
    at = lambda s: spark.sql(f"SELECT timestamp_seconds({s})").first()[0]
    c = lambda x: x * 32
    proof = lambda x: hashlib.sha256(hashlib.sha256(b"h").digest() + b"\0" + c(x).encode() + b"node").hexdigest()
    issue = lambda x, user, expires=1060: (at(1000), c(x), user, expires, False, bytearray(b"\0"), None, None, None, None)
    attempt = lambda n, x, user, p, now=1001: (at(now), c(x), None, None, None, None, n, user, p, now)
    plan = lambda s: stateful.finish(s, users, "node", keep_s=100)
    feed(spark, tmp_path, [issue("a", "ann"), issue("b", "ann"), issue("l", "bob"), issue("t", "ann", 1000), attempt(2, "a", "ann", proof("a")), attempt(1, "a", "ann", "no"), attempt(3, "a", "ann", proof("a")), attempt(4, "l", "bob", proof("l")), attempt(5, "t", "ann", proof("t")), attempt(6, "b", "bob", proof("b")), attempt(7, "z", "ann", "no")], MESSAGES, plan)
    feed(spark, tmp_path, [attempt(8, "a", "ann", proof("a")), attempt(9, "b", "ann", proof("b").upper()), attempt(10, "b", "a b", "")], MESSAGES, plan)
    rows = {r.attempt: (r.verdict, r.session_expires) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    no = ("unauthorized", None)
    assert rows == {1: no, 2: ("ok", 1901), 3: no, 4: ("locked", None), 5: ("expired", None), 6: no, 7: ("not_found", None), 8: no, 9: ("ok", 1901), 10: ("invalid_input", None)}
    for n, now in ((11, 9000), (12, 9001), (13, 9002)):  # time goes on: at the end of a batch the timer forgets the challenge
        feed(spark, tmp_path, [attempt(n, "b", "ann", proof("b"), now)], MESSAGES, plan)
    rows = {r.attempt: r.verdict for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert rows[13] == "not_found"


def test_challenges_share_groups(spark, tmp_path):
    """What a batch asks of its state grows with the groups, not with the challenges."""
    users = spark.createDataFrame([("ann", False, "h")], "user string, locked boolean, pw_hash string")
    at, c, big = spark.sql("SELECT timestamp_seconds(1000)").first()[0], lambda k: f"{k:032d}", 2**60 + 1
    proof = lambda k: hashlib.sha256(hashlib.sha256(b"h").digest() + b"\0" + c(k).encode() + b"node").hexdigest()
    issued = [(at, c(k), "ann", 1060 + k % 2, False, bytearray(b"\0"), None, None, None, None) for k in range(400)]
    tries = [(at, c(k), None, None, None, None, big + k, "ann", proof(k), 1001) for k in range(400)]
    top = tmp_path
    for rows in (issued + tries[::2], tries):  # even ones come again, after a restart
        spark.createDataFrame(rows, MESSAGES).write.mode("append").parquet(f"{top}/in")
        plan = stateful.finish(spark.readStream.schema(MESSAGES).parquet(f"{top}/in"), users, "node", buckets=8)
        query = stateful.run(plan, f"{top}/out", f"{top}/state")
        timers = [p["stateOperators"][0]["customMetrics"]["numRegisteredTimers"] for p in query.recentProgress if p["stateOperators"]]
        assert timers and max(timers) <= 16
    got = sorted((r.attempt, r.verdict) for r in spark.read.parquet(f"{top}/out").collect())
    assert got == sorted([(big + k, "ok") for k in range(400)] + [(big + k, "unauthorized") for k in range(0, 400, 2)])


def test_searches_share_groups(spark, tmp_path):
    """Many searches take few groups, and come out as each by itself."""
    rows = [("a", 2**60 + 1 + k, 3, None, None, None) for k in range(300)] + [("a", 2**60 + 1 + k, None, "p", f"d{n}", float(n * k % 7)) for k in range(300) for n in range(5)]
    for part in (rows[::2], rows[1::2]):
        spark.createDataFrame(part, HITS).write.mode("append").parquet(f"{tmp_path}/in")
        query = stateful.run(stateful.merge_hits(spark.readStream.schema(HITS).parquet(f"{tmp_path}/in"), buckets=4), f"{tmp_path}/out", f"{tmp_path}/state", "update")
        assert query.exception() is None
    got = {}
    for r in sorted(stateful.latest(spark, f"{tmp_path}/out", stateful.MERGED, ["origin", "search_id"]).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.search_id, []).append((r.score, r.doc))
    want = {}
    for k in range(300):
        # a search that opens in the second part has lost the first part's hits
        late = rows.index(("a", 2**60 + 1 + k, 3, None, None, None)) % 2
        mine = [(float(n * k % 7), f"d{n}") for i, n in ((300 + 5 * k + n, n) for n in range(5)) if i % 2 >= late]
        want[2**60 + 1 + k] = sorted(mine, key=lambda x: (-x[0], x[1]))[:3]
    assert got == want
