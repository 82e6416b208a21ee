"""What outlives a call: folders that driver and executors share, and rows that are cached."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections import Counter

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder below the cluster's shared checkpoint folder; a local one only where none is set and Spark runs on one machine."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = f"file://{tempfile.gettempdir()}"
    return f"{top}/larkspur-{uuid.uuid4().hex}"


#: How many results read each cached plan: Spark caches equal plans once.
_HELD: Counter[int] = Counter()


def releasing(result: DataFrame, *cached: DataFrame) -> DataFrame:
    """``result``, with what it reads from the cache released once it is no longer held.

    What is derived from it is right without the cache too, but reads its source again: return it through ``keeping``.
    """

    keys = [f.semanticHash() for f in cached]
    _HELD.update(keys)

    def release(frames: tuple[DataFrame, ...]) -> None:
        for key, f in zip(keys, frames, strict=True):
            _HELD[key] -= 1
            if _HELD[key] <= 0:
                del _HELD[key]
                if f.sparkSession.sparkContext._jsc is not None:  # else Spark has ended
                    f.unpersist()

    weakref.finalize(result, release, cached).atexit = False
    return result


def keeping(result: DataFrame, source: DataFrame) -> DataFrame:
    """``result``, with what ``source`` reads from the cache held as long as it is: ``source`` was derived from, and is not held by anyone else."""
    weakref.finalize(result, lambda _: None, source).atexit = False
    return result
