"""Tables that the batches of a stream keep up to date: a ledger of contents, and a rollup by key.

Both are folders with one part for each batch. A batch that is run again after a failure overwrites its own part and
reads only those before it, so it gives the same result; nothing else is ever rewritten, and compact() merges parts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _parts(spark: SparkSession, path: str, before: int | None, schema: str) -> DataFrame:
    """All parts of a folder, or those of batches before one; none where nothing was written yet."""
    try:
        rows = spark.read.schema(f"{schema}, batch long").parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{schema}, batch long")
    return rows if before is None else rows.filter(F.col("batch") < before)  # prunes folders


def start_each(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    return stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


LEDGER = "content_hash string, id long, uploaded_at timestamp"


def note_new_contents(batch: DataFrame, number: int, ledger: str) -> None:
    """Adds the first upload of each content of a batch (content_hash, id, uploaded_at) that no earlier batch had.

    Of equal contents in a batch the earliest counts, of equal times the smallest id. The ledger is only scanned for the
    batch's hashes: Spark broadcasts these where they are few, and joins by hash where they are many.
    """
    spark = batch.sparkSession
    fresh = batch.groupBy("content_hash").agg(F.min_by(F.struct("id", "uploaded_at"), F.struct("uploaded_at", "id")).alias("u")).select("content_hash", "u.id", "u.uploaded_at").persist()
    try:
        # a content without a hash is one content too
        same = lambda one, other: F.col(f"{one}.content_hash").eqNullSafe(F.col(f"{other}.content_hash"))
        known = _parts(spark, ledger, number, LEDGER).alias("l").join(fresh.select("content_hash").alias("f"), same("l", "f"), "left_semi").select("content_hash")
        fresh.alias("f").join(known.alias("k"), same("f", "k"), "left_anti").write.mode("overwrite").parquet(f"{ledger}/batch={number}")
    finally:
        fresh.unpersist()


def stream_ledger(uploads: DataFrame, ledger: str, checkpoint: str) -> StreamingQuery:
    """Uploads of a stream (content_hash, id, uploaded_at) against all contents ever seen: however late a content comes
    back, it is no new one. The ledger is a table, so nothing is held as state of the stream."""
    return start_each(uploads, lambda batch, number: note_new_contents(batch, number, ledger), checkpoint)


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """The first upload of every content."""
    return _parts(spark, ledger, None, LEDGER).drop("batch")


ROLLUP = "day timestamp, overall_status string, n long"


def stream_rollup_upserts(inspections: DataFrame, path: str, checkpoint: str, late: str = "1 day") -> StreamingQuery:
    """Inspections by day and status, kept up to date: each batch adds the new counts of the keys that it changed.

    In update output a batch hands on the changed keys only, and the state of a day goes when the watermark, ``late``
    behind the newest inspection, has passed its end; rows for such a day are dropped.
    """
    counts = inspections.withWatermark("created_at", late).groupBy(F.window("created_at", "1 day"), "overall_status").agg(F.count("*").alias("n"))
    rows = counts.select(F.col("window.start").alias("day"), "overall_status", "n")
    return start_each(rows, lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}"), checkpoint, "update")


def _latest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("day", "overall_status").agg(F.max_by("n", "batch").alias("n"), F.max("batch").alias("batch"))


def read_rollup(spark: SparkSession, path: str) -> DataFrame:
    """The rollup as of the last batch: of each key the count of the last batch that changed it."""
    return _latest(_parts(spark, path, None, ROLLUP)).drop("batch")


def compact_rollup(spark: SparkSession, path: str, to: str) -> None:
    """The rollup in a folder of its own, each key once, as part of the batch that changed it last."""
    _latest(_parts(spark, path, None, ROLLUP)).write.partitionBy("batch").parquet(to)
