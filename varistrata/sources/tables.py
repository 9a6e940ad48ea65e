"""Reading and writing tables, column identifiers, result paths and small configuration files."""

from __future__ import annotations

import csv
import json
import os
import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import asdict, dataclass, fields, is_dataclass
from functools import reduce
from pathlib import PurePosixPath

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A column identifier: field, instance and array index.
UDI = r"(\d+)-(\d+)\.(\d+)"


def load_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None, nrows: int | None = None, sep: str = ",", schema: str | StructType | None = None) -> DataFrame:
    """A CSV/TSV file with header, or Parquet. Only the wanted columns are scanned; NaN and infinities become NULL.

    Without a schema the types of text files are worked out from all of their rows, which is one more scan.
    """
    if path.rstrip("/").endswith((".csv", ".tsv", ".txt")):
        tabs = path.rstrip("/").endswith((".tsv", ".txt")) and sep == ","
        options = {"inferSchema": True} if schema is None else {"schema": schema}
        df = spark.read.csv(path, header=True, sep="\t" if tabs else sep, escape='"', **options)
    else:
        df = spark.read.parquet(path)
    if columns is not None:
        df = df.select(*[F.col(f"`{c}`") for c in columns])
    df = missing_to_null(df)
    return df if nrows is None else df.limit(nrows)


def missing_to_null(df: DataFrame) -> DataFrame:
    """NULL is the only mark of a missing value."""
    inf = float("inf")
    fix = {c: F.when(~(F.isnan(f"`{c}`") | F.abs(f"`{c}`").isin(inf)), F.col(f"`{c}`")) for c, t in df.dtypes if t in ("double", "float")}
    return df.withColumns(fix) if fix else df


def load_encoded(spark: SparkSession, path: str) -> tuple[DataFrame, list[tuple[str, str]]]:
    """CSV files with two header rows each (identifier, encoded identifier): their rows under the encoded names, and the pairs of names.

    Fields may be quoted. A folder's files must have the same headers; each file's are left out.
    """
    head = next(csv.reader([spark.read.text(path).first()[0]]))
    raw = spark.read.csv(path, header=False, escape='"', schema=", ".join(f"c{i} string" for i in range(len(head))))
    first = reduce(lambda a, b: a & b, [F.col(f"c{i}") == F.lit(h) for i, h in enumerate(head) if i])
    # The second header row is the one that begins every field with the first's and has no key.
    second = reduce(lambda a, b: a & b, [F.startswith(F.col(f"c{i}"), F.lit(h)) for i, h in enumerate(head) if i])
    keyless = F.col("c0").isNull() | ~F.col("c0").rlike(r"^\s*-?\d+\s*$")
    names = raw.where(second & ~first & keyless).first() or raw.where(first).first()
    pairs = [(a, b) for a, b in zip(head, names, strict=True)]
    rows = raw.where(~(keyless & F.coalesce(second, F.lit(False))))
    new = [head[0] or "eid", *[b for _, b in pairs[1:]]]
    df = rows.select(F.col("c0").cast("long").alias(new[0]), *[F.col(f"c{i}").alias(n) for i, n in enumerate(new) if i])
    return df, pairs[1:]


def udi_parts(name: str | Column) -> list[Column]:
    col = F.col(name) if isinstance(name, str) else name
    return [F.regexp_extract(col, f"^{UDI}", i).cast("int").alias(n) for i, n in ((1, "field_id"), (2, "instance"), (3, "array_index"))]


def parse_udis(spark: SparkSession, columns: Iterable[str]) -> DataFrame:
    """udi, field_id, instance, array_index of column names; a name that doesn't begin like one is an error."""
    rows = []
    for name in columns:
        m = re.match(UDI, name)
        if not m:
            raise ValueError(f"not a column identifier: {name}")
        rows.append((name, *map(int, m.groups())))
    return spark.createDataFrame(rows, "udi string, field_id int, instance int, array_index int")


def write_subset(df: DataFrame, path: str, columns: Sequence[str], fn: Callable[[DataFrame], DataFrame] | None = None, key: str = "eid") -> tuple[int, int]:
    """Project to the key and the columns, apply fn, write Parquet; rows and columns (without key) written. The rows are counted by the job that writes them."""
    wanted = [key, *[c for c in columns if c != key]]
    out = df.select(*[F.col(f"`{c}`") for c in wanted])
    out = out if fn is None else out.transform(fn)
    seen = Observation()
    out.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
    return seen.get["rows"], len(out.columns) - 1


def add_suffix(path: str, suffix: str) -> str:
    """The suffix goes before the extension."""
    p = PurePosixPath(path)
    return str(p.with_name(p.stem + suffix + p.suffix))


def data_path(name: str, clean: bool = False, extension: str = ".csv") -> str:
    return f"{name}{'-clean' if clean else ''}{extension}"


def with_suffix(path: Column, suffix: str | Column) -> Column:
    """add_suffix for a column of paths; null stays null."""
    extension = F.regexp_extract(path, r"(?<=[^/])\.[^./]+$", 0)
    return F.concat(F.substring(path, F.lit(1), F.length(path) - F.length(extension)), suffix if isinstance(suffix, Column) else F.lit(suffix), extension)


def data_name(name: Column, clean: bool | Column = False, extension: str = ".csv") -> Column:
    """data_path for a column of names."""
    return F.concat(name, F.when(clean if isinstance(clean, Column) else F.lit(clean), F.lit("-clean")).otherwise(F.lit("")), F.lit(extension))


def write_text(path: str, text: str, spark: SparkSession | None = None) -> None:
    """A small file, replaced where there is one: on the file system that the path names to Spark, or without a session on the driver's own."""
    if spark is None:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
        return
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(path: str, spark: SparkSession | None = None) -> str:
    """A small file, whole. One that isn't there is an OSError either way."""
    if spark is None:
        with open(path, encoding="utf-8") as f:
            return f.read()
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(place):
        raise FileNotFoundError(path)
    source = system.open(place)
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()


def save_json(path: str, value, spark: SparkSession | None = None) -> None:
    write_text(path, json.dumps(value, indent=2), spark)


def load_json(path: str, kind: type | None = None, spark: SparkSession | None = None):
    value = json.loads(read_text(path, spark))
    if kind is not None and not isinstance(value, kind):
        raise TypeError(f"{path} holds a {type(value).__name__}, not a {kind.__name__}")
    return value


def object_text(value) -> str:
    """A dataclass, or a fitted kernel (its attributes, arrays as lists), with the name of its class, as JSON."""

    def plain(x):
        if isinstance(x, np.ndarray):
            return {"array": x.tolist()}
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, list | tuple) else x.item() if isinstance(x, np.generic) else x

    held = asdict(value) if is_dataclass(value) else dict(value.__dict__)
    return json.dumps({"class": type(value).__name__, "held": plain(held)})


def object_of(text: str, kind: type):
    """What object_text gave; an object of another class is an error."""

    def whole(x):
        if isinstance(x, dict):
            return np.array(x["array"]) if set(x) == {"array"} else {k: whole(v) for k, v in x.items()}
        return [whole(v) for v in x] if isinstance(x, list) else x

    found = json.loads(text)
    if not isinstance(found, dict) or found.get("class") != kind.__name__:
        raise TypeError(f"this is no saved {kind.__name__}")
    out = kind.__new__(kind)
    out.__dict__.update(whole(found["held"]))
    return out


def save_object(path: str, value, spark: SparkSession | None = None) -> None:
    write_text(path, object_text(value), spark)


def load_object(path: str, kind: type, spark: SparkSession | None = None):
    """No such file, or one that holds no saved object, is an error."""
    try:
        return object_of(read_text(path, spark), kind)
    except (OSError, ValueError) as error:
        raise RuntimeError(f"{path} holds no saved object") from error


@dataclass(frozen=True)
class Paths:
    """Where a study lies: folders under one root, each may be set by itself."""

    root: str = "."
    data: str | None = None
    schema: str | None = None
    samples: str | None = None
    results: str | None = None
    figures: str | None = None

    def of(self, what: str) -> str:
        if what not in {f.name for f in fields(self)} - {"root"}:
            raise ValueError(f"no folder is named {what}")
        return getattr(self, what) or f"{self.root.rstrip('/')}/{what}"

    @staticmethod
    def from_environment(prefix: str = "STUDY_") -> Paths:
        return Paths(**{f.name: os.environ[prefix + f.name.upper()] for f in fields(Paths) if prefix + f.name.upper() in os.environ})


def study_folders(root: Column, paths: Paths = Paths()) -> Column:
    """An array of (what, path) of all folders of a study whose root is a column; folders that `paths` sets by itself are the same for all roots."""
    base = F.regexp_replace(root, "/+$", "")
    own = {f.name: getattr(paths, f.name) for f in fields(Paths) if f.name != "root"}
    return F.array(*[F.struct(F.lit(what).alias("what"), (F.lit(path) if path else F.concat(base, F.lit(f"/{what}"))).alias("path")) for what, path in own.items()])


def sample_path(subset: str, n_reps: int, sizes: Sequence[int], stratified: bool = False, replace: bool = False) -> str:
    """The name of a design: subset, repetitions, sizes, and how it was drawn."""
    tags = [subset, f"{n_reps}reps", f"{len(sizes)}sizes_{min(sizes)}-{max(sizes)}", *(["stratified"] if stratified else []), *(["replace"] if replace else [])]
    return f"samples-{'-'.join(tags)}.parquet"


def result_path(n_pcs: Sequence[int], subset: str, sample_size: int, rep: int, null_model: bool = False) -> str:
    tag = subset + ("-null_model" if null_model else "")
    return f"PCs_{'_'.join(map(str, n_pcs))}/{tag}/sample_size_{sample_size}/sample_size_{sample_size}-rep{rep}.parquet"


def design_name(subset: Column, n_reps: Column, sizes: Column, stratified: bool | Column = False, replace: bool | Column = False) -> Column:
    """sample_path for columns; sizes is an array of them."""

    def tag(said: bool | Column, word: str) -> Column:
        return F.when(said if isinstance(said, Column) else F.lit(said), F.lit(word))

    span = F.concat(F.size(sizes), F.lit("sizes_"), F.array_min(sizes), F.lit("-"), F.array_max(sizes))
    parts = F.concat_ws("-", F.lit("samples"), F.concat(subset, F.lit("-"), n_reps, F.lit("reps")), span, tag(stratified, "stratified"), tag(replace, "replace"))
    return F.when(subset.isNotNull() & n_reps.isNotNull() & span.isNotNull(), F.concat(parts, F.lit(".parquet")))


def result_name(n_pcs: Sequence[int], subset: Column, sample_size: Column, rep: Column, null_model: bool | Column = False) -> Column:
    """result_path for columns: the file of each unit of a grid; null where a part is."""
    tag = F.concat(subset, F.when(null_model if isinstance(null_model, Column) else F.lit(null_model), F.lit("-null_model")).otherwise(F.lit("")))
    size = F.concat(F.lit("sample_size_"), sample_size)
    return F.concat(F.lit(f"PCs_{'_'.join(map(str, n_pcs))}/"), tag, F.lit("/"), size, F.lit("/"), size, F.lit("-rep"), rep, F.lit(".parquet"))


def find_results(paths: DataFrame, labels: DataFrame | None = None, label: int | None = None, limit: int | None = None) -> DataFrame:
    """path, sample_size, rep of result files (column `path`), largest size first, then by rep; of one label's repetitions if asked."""
    name = F.element_at(F.split("path", "/"), -1)
    out = paths.select("path", F.regexp_extract(name, r"^sample_size_(\d+)", 1).alias("s"), F.regexp_extract(name, r"rep(\d+)", 1).alias("r")).where("s != '' and r != ''")
    out = out.select("path", F.col("s").cast("int").alias("sample_size"), F.col("r").cast("int").alias("rep"))
    if label is not None:
        if labels is None:
            raise RuntimeError("there are no labels of repetitions")
        out = out.join(labels.where(F.col("label") == label).select(F.col("i_rep").alias("rep")), "rep", "left_semi")
    out = out.orderBy(F.desc("sample_size"), "rep", "path")
    return out if limit is None else out.limit(limit)


def write_long_csv(df: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    """A long table as CSV with header, ordered across files."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").option("header", True).csv(path)


def write_results(df: DataFrame, path: str) -> None:
    """Long result tables, one folder for each subset, model and sample size."""
    df.repartition("subset", "null_model", "sample_size").write.mode("overwrite").partitionBy("subset", "null_model", "sample_size").parquet(path)
