"""Tables that cut lineage: written once to the folder all executors share, then read back."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="catalogspark-")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, a temporary one if there is one machine."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known is None and not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (known or _own_dir()).rstrip("/")


class _Open(threading.local):
    """Scratches open in a thread, the innermost last."""

    def __init__(self):
        self.made: list[list[DataFrame]] = []


_open = _Open()


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables stored within are deleted at the end, but for those that the function given is called with."""
    made: list[DataFrame] = []
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    _open.made.append(made)
    try:
        yield keep
    finally:
        _open.made.pop()
        for df in made:
            if not any(df is k for k in kept):
                drop_stored(df)
            elif _open.made:
                _open.made[-1].append(df)


def stored(df: DataFrame, tag: str, compression: str = "snappy") -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    Unlike a checkpoint of rows the result has known sizes, so that the planner itself decides whether a side is
    small enough to be broadcast. Lost executors cost nothing: the files outlive them."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    if _open.made:
        _open.made[-1].append(out)
    return out


def drop_stored(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`stored` that nothing reads any more."""
    spark, path = df.sparkSession, getattr(df, "_stored_at", None)
    if path:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
