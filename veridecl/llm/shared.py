"""Intermediate tables in the folder that driver and executors share.

Lineage is cut with written Parquet tables rather than with ``checkpoint()``: they are compressed, pruned by
column on rereading, and survive lost executors.
"""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="veridecl-")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where that is unset and all runs on one machine (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = _own_folder()
    return folder.rstrip("/")


_tables: ContextVar[list[DataFrame] | None] = ContextVar("tables", default=None)


def materialize(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder, and read again.

    Inside passing_tables() it goes at the end, unless it is ``lasting``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    if not lasting and _tables.get() is not None:
        _tables.get().append(table)
    return table


@contextmanager
def passing_tables() -> Iterator[None]:
    """Deletes the tables that materialize() makes inside, but for lasting ones: what is returned must rest on those."""
    token = _tables.set([])
    try:
        yield
    finally:
        for table in _tables.get():
            forget(table)
        _tables.reset(token)


def forget(df: DataFrame) -> None:
    """Deletes the files of a table that materialize() returned; nothing may read it afterwards."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


#: A key that more than one row in so many has is dealt over several tasks; there are fewer such keys than that.
SHARES = 500


def join_spread(rows: DataFrame, few: DataFrame, counts: DataFrame, keys: list[str], of: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``few``, which has a row for each of ``keys`` at most, where some keys hold many of the rows.

    ``counts`` (keys, count) says how many rows a key has; keys of few rows may be absent. Keys of over a SHARES-th of
    the sum of all counts, so fewer than SHARES, are broadcast; their rows are dealt on by a hash of the column ``of``,
    and their row of ``few`` goes to each part. Wrong counts would only deal the rows otherwise. The result is that of
    the plain join.
    """
    most = (counts.agg(F.sum("count")).first()[0] or 0) // SHARES + 1
    hot = F.broadcast(counts.filter(F.col("count") > most).select(*keys, F.ceil(F.col("count") / most).cast("int").alias("__parts")))
    parts = F.coalesce("__parts", F.lit(1))
    left = rows.join(hot, keys, "left").withColumn("__part", F.pmod(F.xxhash64(of), parts).cast("int"))
    right = few.join(hot, keys, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return left.join(right, [*keys, "__part"], how).drop("__part", "__parts")
