"""Logins in batches: challenges are issued to users, and attempts judged against them.

Password hashes are opaque text here, and a proof is a digest over them (``access.login_proof``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import validate as V
from .access import login_proof

# Lifetimes in seconds, and the length of an id.
CHALLENGE_S, SESSION_S = 60, 900
ID_CHARS = 32


def new_id() -> Column:
    """32 hex digits at random."""
    return F.replace(F.uuid(), F.lit("-"), F.lit(""))


def begin(requests: DataFrame, users: DataFrame, now: int) -> DataFrame:
    """(user, challenge, expires, used, error) for requests (user, challenge): invalid_input, not_found and locked in that order, or null."""
    joined = requests.select("user", "challenge").join(users.select("user", "locked"), "user", "left")
    error = F.when(~V.name_valid(F.col("user")), "invalid_input").when(F.col("locked").isNull(), "not_found").when(F.col("locked"), "locked")
    return joined.select("user", "challenge", F.lit(now + CHALLENGE_S).cast("long").alias("expires"), F.lit(False).alias("used"), error.alias("error"))


def finish(attempts: DataFrame, challenges: DataFrame, users: DataFrame, node: str, now: int) -> DataFrame:
    """(attempt, user, challenge, verdict, session_expires) for attempts (attempt, user, challenge, proof).

    A challenge works once: of several right attempts the one with the smallest number wins. Verdicts
    in order: invalid_input, not_found, unauthorized (used or another's), expired, locked,
    unauthorized (wrong proof), ok.
    """
    held = challenges.select("challenge", F.col("user").alias("owner"), "expires", "used", "nonce")
    rows = attempts.join(held, "challenge", "left").join(users.select("user", "locked", "pw_hash"), "user", "left").withColumn("node", F.lit(node))
    verdict = (
        F.when(~V.name_valid(F.col("user")) | (F.length(F.trim("challenge")) != ID_CHARS), "invalid_input")
        .when(F.col("owner").isNull(), "not_found")
        .when(F.col("used") | (F.col("owner") != F.col("user")), "unauthorized")
        .when(F.col("expires") < now, "expired")
        .when(F.col("locked").isNull(), "not_found")
        .when(F.col("locked"), "locked")
        .when(login_proof("pw_hash", "nonce", "challenge", "node") != F.lower("proof"), "unauthorized")
        .otherwise("ok")
    )
    rows = rows.select("attempt", "user", "challenge", verdict.alias("verdict"))
    nth = F.row_number().over(Window.partitionBy("challenge", "verdict").orderBy("attempt"))
    rows = rows.withColumn("verdict", F.when((F.col("verdict") == "ok") & (nth > 1), "unauthorized").otherwise(F.col("verdict")))
    return rows.withColumn("session_expires", F.when(F.col("verdict") == "ok", F.lit(now + SESSION_S).cast("long")))
