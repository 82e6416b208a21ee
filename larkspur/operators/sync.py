"""Change detection between a snapshot of files and what an index has of them.

Trackers are tables (path, mtime) or (path, mtime, sha256); files are (path, mtime, text). A table's
new state is one full-outer join, so a document has one live version, and an index and its tracker
are written together (see ``sources.index``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip


def changed(files: DataFrame, tracker: DataFrame) -> DataFrame:
    """(path, mtime, status): files that are new or whose mtime differs. Mtime alone decides."""
    old = tracker.select("path", F.col("mtime").alias("old"))
    rows = files.select("path", "mtime").join(old, "path", "left")
    status = F.when(F.col("old").isNull(), "new").when(F.col("old") != F.col("mtime"), "changed")
    return rows.select("path", "mtime", status.alias("status")).filter(F.col("status").isNotNull())


def content_changed(files: DataFrame, tracker: DataFrame) -> DataFrame:
    """(path, mtime, sha256, status): files with text that are new or whose mtime or content differs."""
    now = files.filter(strip(F.coalesce("text", F.lit(""))) != "").select("path", "mtime", F.sha2("text", 256).alias("sha256"))
    old = tracker.select("path", F.col("mtime").alias("old"), F.col("sha256").alias("old_sha"))
    status = F.when(F.col("old").isNull(), "new").when((F.col("old") != F.col("mtime")) | (F.col("old_sha") != F.col("sha256")), "changed")
    return now.join(old, "path", "left").select("path", "mtime", "sha256", status.alias("status")).filter(F.col("status").isNotNull())


def deleted(tracker: DataFrame, files: DataFrame) -> DataFrame:
    """(path): what is tracked and no longer there."""
    return tracker.select("path").join(files.select("path"), "path", "left_anti")


def next_keyword_state(files: DataFrame, tracker: DataFrame) -> DataFrame:
    """(path, mtime) after a pass: files with any text, white space included; a file that became empty goes."""
    return files.filter(F.coalesce("text", F.lit("")) != "").select("path", "mtime")


def next_vector_state(files: DataFrame, vectors: DataFrame, tracker: DataFrame, encoded: DataFrame) -> DataFrame:
    """(path, mtime, sha256, vec): new vectors for what changed, old ones for the rest; what is gone or blank goes."""
    live = files.filter(strip(F.coalesce("text", F.lit(""))) != "").select("path", "mtime", F.sha2("text", 256).alias("sha256"))
    fresh = encoded.select("path", F.col("vec").alias("new"))
    old = vectors.select("path", F.col("vec").alias("old"))
    return live.join(fresh, "path", "left").join(old, "path", "left").select("path", "mtime", "sha256", F.coalesce("new", "old").alias("vec")).filter(F.col("vec").isNotNull())


def upsert(pending: DataFrame, responses: DataFrame, key: str = "req_id") -> DataFrame:
    """Pending fetches (key, peer, path) with their responses (key, text, error); unknown responses are inserted."""
    joined = pending.join(responses.withColumn("_done", F.lit(True)), key, "full_outer")
    return joined.select(key, "peer", "path", F.coalesce("_done", F.lit(False)).alias("done"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("error", F.lit("")).alias("error"))
