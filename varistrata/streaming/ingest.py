"""Chunk-wise ingestion as a stream: new files of a table are projected, changed row by row and appended."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def read_chunks(spark: SparkSession, folder: str, schema: StructType, files_at_once: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def append_subset(chunks: DataFrame, path: str, checkpoint: str, columns: Sequence[str], fn: Callable[[DataFrame], DataFrame] | None = None, key: str = "eid") -> StreamingQuery:
    """What is there is written to `path` and the query ends; a later call goes on with new files. fn must look at single rows."""
    out = chunks.select(key, *[F.col(f"`{c}`") for c in columns])
    out = out if fn is None else out.transform(fn)
    return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def running_missing(chunks: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, n, missing: the share of NULLs so far, for output mode complete."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").isNull().cast("double").alias("gone")) for c in columns])
    return chunks.select(F.explode(cells).alias("x")).groupBy("x.column").agg(F.count("*").alias("n"), F.avg("x.gone").alias("missing"))


def keep_missing(chunks: DataFrame, columns: Sequence[str], path: str, checkpoint: str) -> StreamingQuery:
    """The shares so far are written to `path` after each chunk, instead of those before; the query ends with what is there."""
    write = lambda told, _: told.coalesce(1).write.mode("overwrite").parquet(path)  # noqa: E731  a row for each column
    return running_missing(chunks, columns).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("complete").trigger(availableNow=True).start()
