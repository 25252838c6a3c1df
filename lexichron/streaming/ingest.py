"""Saved pages or rows that arrive in a folder, taken in as they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from ..sources.shared import unused


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df, form: str = "parquet", key: str | None = None, order: tuple[str, ...] = (), files_per_batch: int = 10, rows_per_file: int = 0) -> StreamingQuery:
    """Takes in what is in the source folder and not taken in before, a few files a batch, and appends it to the target.

    With a key, only the first row of each key over all batches stays: within a batch the first in the order (without one, the least by all its columns), and
    a batch is held against the keys that the target has already, so the state is the target itself and no memory grows. A batch that is repeated
    after a failure replaces its own rows. Rows whose key is null count as one."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(form).load(source)

    def write(batch: DataFrame, number: int) -> None:
        rows = transform(batch)
        s = batch.sparkSession
        if key:
            n, taken = unused(rows, "_n"), unused(rows, "_taken")
            by = Window.partitionBy(key).orderBy(*(order or sorted(c for c in rows.columns if c != key) or [key]))
            rows = rows.withColumn(n, F.row_number().over(by)).where(F.col(n) == 1).drop(n)
            if _exists(s, target):
                before = s.read.schema(StructType([*rows.schema.fields, StructField("_batch", LongType())])).parquet(target).where(F.col("_batch") != number)
                rows = rows.join(before.select(F.col(key).alias(taken)), F.col(key).eqNullSafe(F.col(taken)), "left_anti")
        w = rows.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file)
        w.parquet(f"{target}/_batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark: SparkSession, path: str) -> bool:
    from ..sources.readers import exists

    return exists(spark, path)
