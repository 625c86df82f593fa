"""What several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as characters and as a regex class; words are runs of anything else.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = "[\\x20\\x09-\\x0D]"


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    split = F.split(F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES)), f"{SPACE_CLASS}+")
    return F.array_remove(split, "")


def count_words(text: Column) -> Column:
    """How many words a text has; 0 for null."""
    return F.size(words(text)).cast("long")


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns of these names, in any case of letters, so that a result can carry them."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; a temporary one where a session on one machine names none (tests)."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="parchment-"))
    return f"{sc.getCheckpointDir().rstrip('/')}/{uuid.uuid4().hex}"


_noted: ContextVar[list[str] | None] = ContextVar("noted", default=None)


@contextmanager
def noting_folders() -> Iterator[list[str]]:
    """While it lasts, lists in order the folders that saved() writes on behalf of the caller; other threads have their own lists."""
    own: list[str] = []
    before = _noted.set(own)
    try:
        yield own
    finally:
        _noted.reset(before)



def saved(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back, which cuts its lineage."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    df.write.parquet(path)
    if (own := _noted.get()) is not None:
        own.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, folders: list[str]) -> None:
    """Deletes folders of saved() that nothing reads any more."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """At the end of a task: what its worker, which waits for the next one, has freed but not yet returned to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # where C's library can't
        ctypes.CDLL(None).malloc_trim(0)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def partitions_for(spark: SparkSession, size: int, each: int = 48 << 20) -> int:
    """How many partitions a shuffle of so many bytes takes: each of a bounded size, and not fewer than the session has."""
    return max(shuffle_partitions(spark), math.ceil(size / each))
