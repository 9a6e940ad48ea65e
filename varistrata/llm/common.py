"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Arrow batches are cut into pieces of about this many characters before Python works on them.
PIECE_CHARS = 8_000_000


#: Rows that go to Python in one Arrow batch; texts are long, so far fewer than Spark's default.
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches for this session, unless it asks for still smaller ones."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str | Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; null where the key is null."""
    col = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.crc32(col.cast("string")), F.lit(n))


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder, but only in a single process (tests): executors don't share one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="varistrata-")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: later reads see the same rows in the same partitions."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Checkpoints of one job: those that its result doesn't read are deleted at its end."""

    def __init__(self):
        self.held: list[DataFrame] = []

    def __call__(self, df: DataFrame) -> DataFrame:
        out = cut_lineage(df)
        self.held.append(out)
        return out

    def release(self, *keep: DataFrame) -> None:
        for df in self.held:
            if not any(df is k for k in keep):
                file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
                if file.isDefined():
                    delete_folder(df.sparkSession, file.get())
        self.held = [df for df in self.held if any(df is k for k in keep)]


def pieces(batches: Iterable[pa.RecordBatch], text: str = "text", chars: int = PIECE_CHARS) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of record batches with their texts as Python strings, of bounded size each (a longer single text stands alone)."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        texts = column.to_pylist()
        start, held = 0, 0
        for i, value in enumerate(texts):
            held += len(value or "")
            if held >= chars or i + 1 == len(texts):
                yield batch.slice(start, i + 1 - start), texts[start : i + 1]
                start, held = i + 1, 0


def bounded_ids(df: DataFrame, key: str, n: int) -> DataFrame:
    """At most n keys, those with the smallest hash: each task sends n keys at most, never texts."""
    return df.select(key).where(F.col(key).isNotNull()).orderBy(F.xxhash64(F.col(key)), F.col(key)).limit(n)


def labelled_texts(docs: DataFrame, ids: DataFrame, label: str, most_bytes: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text, label: one text (the first in order of several) for each of a bounded set of keys.

    Of each label's rows, in the order of their hashes, those stay with which the texts have most_bytes in all; a
    row stays whole or goes. ids has a proven bound, so it is broadcast, and so are the windows bounded.
    """
    wanted = F.broadcast(ids.groupBy(key).agg(F.max(label).alias(label)))
    found = docs.select(key, text).join(wanted, key).groupBy(key, label).agg(F.min(text).alias(text))
    size = F.coalesce(F.octet_length(text), F.lit(0))
    held = F.sum(size).over(Window.partitionBy(label).orderBy(F.xxhash64(key), key).rowsBetween(Window.unboundedPreceding, 0))
    return found.where(size <= most_bytes).withColumn("_held", held).where(F.col("_held") <= most_bytes).select(key, text, label)


def text_schema(df: DataFrame, key: str) -> str:
    return df.schema[key].dataType.simpleString()


def salted_join(large: DataFrame, small: DataFrame, on: list[str], spread: Column, salts: int = 16) -> DataFrame:
    """Inner join in which the rows of one key of `large` are dealt to several tasks; `small` is repeated for each salt."""
    left = large.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"]).drop("_salt")
