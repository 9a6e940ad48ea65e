"""Statistics of columns, filters by them, encoding and cleaning of wide tables. One pass over the data each."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from varistrata.functions import kernels, normal
from varistrata.sources.scratch import cut_lineage


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def wide_to_long(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "column", value: str = "value") -> DataFrame:
    """One row for each key and column; NULLs stay."""
    return df.select(*keys, *[_q(c).cast("double").alias(c) for c in columns]).unpivot(list(keys), [_q(c) for c in columns], name, value)


def long_to_wide(df: DataFrame, keys: Sequence[str], name: str, value: str, columns: Sequence | None = None) -> DataFrame:
    """Given columns save a pass over the data and come out even where they have no rows."""
    return df.groupBy(*keys).pivot(name, list(columns) if columns is not None else None).agg(F.first(value, ignorenulls=True))


def concat(tables: Sequence[DataFrame]) -> DataFrame:
    """Rows of several tables under one another, columns by name; one that a table lacks is NULL there."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def _one_row(df: DataFrame, exprs: dict[str, Column], value: str) -> DataFrame:
    """Aggregates of many columns in one pass, as rows (column, value)."""
    names = list(exprs)
    row = df.agg(*[e.cast("double").alias(f"c{i}") for i, e in enumerate(exprs.values())])
    pairs = F.array(*[F.struct(F.lit(n).alias("column"), F.col(f"c{i}").alias(value)) for i, n in enumerate(names)])
    return row.select(F.inline(pairs))


def missing_fraction(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, missing."""
    return _one_row(df, {c: F.avg(_q(c).isNull().cast("double")) for c in columns}, "missing")


def largest_value(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, largest."""
    return _one_row(df, {c: F.max(_q(c).cast("double")) for c in columns}, "largest")


def _as_text(df: DataFrame, column: str) -> Column:
    """A value as text that equal values, and no others, share, whatever the column's type."""
    fraction = isinstance(df.schema[column].dataType, (T.FloatType, T.DoubleType))
    return (_q(column) + F.lit(0.0).cast(df.schema[column].dataType) if fraction else _q(column)).cast("string")  # -0.0 is 0.0


def _texts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[_as_text(df, c).alias(c) for c in columns]).unpivot([], [_q(c) for c in columns], "column", "value")


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, kinds: distinct values that are not NULL, of columns of any type."""
    return _texts(df, columns).groupBy("column").agg(F.count_distinct("value").cast("double").alias("kinds"))


def mode_fraction(df: DataFrame, columns: Sequence[str], null_as_value: bool = False) -> DataFrame:
    """column, mode: the most frequent value's count over that of present values, of columns of any type. null_as_value: NULL may be that value.

    All values are shuffled; `majority_fraction` does without for shares over a half.
    """
    counts = _texts(df, columns).groupBy("column", "value").agg(F.count("*").alias("n"))
    present = F.sum(F.when(F.col("value").isNotNull(), F.col("n")))
    top = F.max("n") if null_as_value else F.max(F.when(F.col("value").isNotNull(), F.col("n")))
    return counts.groupBy("column").agg((top / present).alias("mode"))


def majority_candidates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """place (of the column), candidate (as text): the one value of each column that more than half of its present values can have.

    Every task keeps a candidate and a weight for each column by majority vote: a batch votes with its most frequent value,
    weighted by what it has over half of the batch, and unequal candidates cancel out. The candidate with the largest
    sum of weights over all tasks is the majority value if there is one. What is shuffled is a row for each task and column.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    def vote(batches):
        held = [(None, 0)] * len(columns)
        for batch in batches:
            for i in range(batch.num_columns):
                have = batch.column(i).drop_null()
                if not len(have):
                    continue
                counts = pc.value_counts(have)
                at = int(np.argmax(counts.field("counts").to_numpy(zero_copy_only=False)))
                value, weight = str(counts.field("values")[at].as_py()), 2 * counts.field("counts")[at].as_py() - len(have)
                old, before = held[i]
                if weight > 0:
                    held[i] = (value, before + weight) if value == old else (old, before - weight) if before >= weight else (value, weight - before)
        told = [(i, value, weight) for i, (value, weight) in enumerate(held) if weight > 0]
        yield pa.RecordBatch.from_arrays([pa.array([t[k] for t in told], kind) for k, kind in enumerate((pa.int32(), pa.string(), pa.int64()))], ["place", "candidate", "weight"])

    named = df.select(*[(_q(c) + F.lit(0.0).cast(df.schema[c].dataType) if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)) else _q(c)).alias(f"c{i}") for i, c in enumerate(columns)])
    votes = named.mapInArrow(vote, "place int, candidate string, weight long").groupBy("place", "candidate").agg(F.sum("weight").alias("weight"))
    return votes.groupBy("place").agg(F.max_by("candidate", F.struct("weight", "candidate")).alias("candidate"))


def majority_fraction(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, mode: the share of the value that more than half of the present values have; 0 if there is none, NULL without present values.

    Candidates by majority vote (one for each column), then one exact count of each: two passes, and no value is shuffled.
    """
    found = {r["place"]: r["candidate"] for r in majority_candidates(df, columns).collect()}
    exprs = {}
    for i, c in enumerate(columns):
        hits = F.count_if(_q(c) == F.lit(found[i]).cast(df.schema[c].dataType)) if i in found else F.lit(0)
        share = F.try_divide(hits, F.count(_q(c)))
        exprs[c] = F.when(share > 0.5, share).when(F.count(_q(c)) > 0, 0.0)
    return _one_row(df, exprs, "mode")


def outlier_ratio(df: DataFrame, columns: Sequence[str], prepare: str | None = None) -> DataFrame:
    """column, outlier: the largest squared distance from the median over the mean one; NULL if there is no spread.

    prepare changes the values first: "ranks" to normal scores of their ranks and then z-scores (as in cleaning),
    "standard" to z-scores (deviation with n), "quantiles" to those and then to normal scores by quantiles (as in a
    selection of features).
    """
    if prepare not in (None, "ranks", "standard", "quantiles"):
        raise ValueError(f"unknown preparation {prepare}")
    if prepare in ("standard", "quantiles"):
        df = zscore(df.select(*[_q(c).cast("double").alias(c) for c in columns]), columns, ddof=0)
    if prepare == "quantiles":
        df = quantile_transform(df, fit_quantiles(df, columns))
    long = wide_to_long(df, [], columns).where("value is not null")
    if prepare == "ranks":
        scored = inverse_normal(long).select("column", F.col("score").alias("value"))
        # Worked out once: sums come out otherwise in their last bits each time, and the windows of exact_quantiles need the same values in every pass.
        moments = cut_lineage(scored.groupBy("column").agg(F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s")))
        long = scored.join(F.broadcast(moments), "column").select("column", F.try_divide(F.col("value") - F.col("_m"), F.col("_s")).alias("value"))
    middle = exact_quantiles(long, ["column"], "value", [0.5]).withColumnRenamed("q0", "_middle")
    square = (F.col("value") - F.col("_middle")) ** 2
    found = long.join(F.broadcast(middle), "column").groupBy("column").agg(F.try_divide(F.max(square), F.avg(square)).alias("outlier"))
    names = F.explode(F.array(*[F.lit(c) for c in columns])).alias("column")
    return df.sparkSession.range(1).select(names).join(found, "column", "left")


def row_missing(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """key, missing: the share of the columns that are NULL in each row."""
    total = sum((_q(c).isNull().cast("int") for c in columns), F.lit(0))
    return df.select(key, (total / len(columns)).alias("missing"))


def histogram(df: DataFrame, value: str, bins: int = 21) -> DataFrame:
    """bin (0 to bins - 1) and n of values from 0 to 1."""
    at = F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, n, low, high, mean, sd, middle."""
    long = wide_to_long(df, [], columns)
    moments = long.groupBy("column").agg(F.count("value").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    middle = exact_quantiles(long, ["column"], "value", [0.5]).withColumnRenamed("q0", "middle")
    return moments.join(F.broadcast(middle), "column", "left")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """level and n; NULL is a level."""
    return df.groupBy(_q(column).alias("level")).agg(F.count("*").alias("n"))


def cohort_summary(df: DataFrame, keys: Sequence[str], numbers: Sequence[str] = (), categories: Sequence[str] = ()) -> DataFrame:
    """keys, column, level, n, percent, mean, sd: one row for each group and number, and for each group, category and level.

    Numbers have n, mean and sample deviation of their present values, categories the share of each level (NULL is one) in percent.
    """
    by = list(keys)
    told = []
    if numbers:
        long = wide_to_long(df, by, numbers)
        told.append(long.groupBy(*by, "column").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd")).select(*by, "column", F.lit(None).cast("string").alias("level"), "n", F.lit(None).cast("double").alias("percent"), "mean", "sd"))
    if categories:
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), _q(c).cast("string").alias("level")) for c in categories]))
        counts = df.select(*by, pairs.alias("_c")).groupBy(*by, "_c.column", "_c.level").agg(F.count("*").alias("n"))
        share = 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(*by, "column"))
        told.append(counts.select(*by, "column", "level", "n", share.alias("percent"), F.lit(None).cast("double").alias("mean"), F.lit(None).cast("double").alias("sd")))
    out = told[0]
    return out if len(told) == 1 else out.unionByName(told[1])


def absolute_limits(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, limit_value: the largest absolute value of each group."""
    return df.groupBy(*keys).agg(F.max(F.abs(value)).alias("limit_value"))


@dataclass
class BadColumns:
    """Columns dropped, by reason, and those that stay."""

    kept: list[str]
    dropped: dict[str, list[str]] = field(default_factory=dict)


def find_bad_columns(df: DataFrame, columns: Sequence[str], missing: float | None = None, mode: float | None = None, outlier: float | None = None, largest: float | None = None, prepare: str | None = "ranks") -> BadColumns:
    """Filters in this order, each on what the one before left: shares and ratios at the threshold or over it, any value over `largest`. prepare: as in outlier_ratio.

    Columns of any type; outliers and large values are looked for in numeric ones.
    """
    out = BadColumns(list(columns))
    steps = [("missing", missing, missing_fraction, lambda v, t: v >= t), ("mode", mode, majority_fraction if mode is not None and mode > 0.5 else mode_fraction, lambda v, t: v is None or v >= t), ("outlier", outlier, lambda d, c: outlier_ratio(d, c, prepare), lambda v, t: v is None or v >= t), ("largest", largest, largest_value, lambda v, t: v is not None and v > t)]
    for name, threshold, statistic, bad in steps:
        if threshold is None or not out.kept:
            continue
        if name in ("missing", "mode") and not 0 <= threshold <= 1:
            raise ValueError(f"{name} must be from 0 to 1")
        asked = [c for c in out.kept if isinstance(df.schema[c].dataType, (T.NumericType, T.BooleanType))] if name in ("outlier", "largest") else out.kept
        found = {r["column"]: r[name] for r in statistic(df, asked).collect()} if asked else {}
        out.dropped[name] = [c for c in asked if bad(found.get(c), threshold)]
        out.kept = [c for c in out.kept if c not in set(out.dropped[name])]
    return out


def row_means(df: DataFrame, groups: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """df with, instead of the columns of each field and instance (name of the field, columns), their row mean and sample deviation, NULLs left out; one projection.

    The new names have the array index that is first as text and the number of columns.
    """
    # One walk over the values: how many, their mean so far, and the sum of squares around it.
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("square"))

    def walk(so_far: Column, x: Column) -> Column:
        n = so_far["n"] + 1
        mean = so_far["mean"] + (x - so_far["mean"]) / n
        return F.struct(n.alias("n"), mean.alias("mean"), (so_far["square"] + (x - so_far["mean"]) * (x - mean)).alias("square"))

    walked, told, gone = {}, [], set()
    for i, (field_name, columns) in enumerate(groups):
        instances = {c.split("-")[1].split(".")[0] for c in columns}
        if len(instances) != 1:
            raise NotImplementedError("the columns are of several instances")
        values = F.filter(F.array(*[_q(c).cast("double") for c in columns]), lambda x: x.isNotNull())
        walked[f"_row{i}"] = F.aggregate(values, start, walk)
        n, mean, square = (F.col(f"_row{i}.{part}") for part in ("n", "mean", "square"))
        base, k = f"{field_name}-{instances.pop()}.{min(c.split('.')[1] for c in columns)}", len(columns)
        told += [F.when(n > 0, mean).alias(f"{base}_mean{k}"), F.when(n > 1, F.sqrt(square / (n - 1))).alias(f"{base}_std{k}")]
        gone |= set(columns)
    return df.withColumns(walked).select(*[_q(c) for c in df.columns if c not in gone], *told) if groups else df


def row_mean_std(df: DataFrame, columns: Sequence[str], field_name: str) -> DataFrame:
    """row_means of one field and instance."""
    return row_means(df, [(field_name, columns)])


def level_name(level) -> str:
    text = str(level)
    return text[:-2] if text.endswith(".0") else text


#: Levels that a column may have to be encoded, each of them a new column.
MOST_LEVELS = 10_000


def one_hot(df: DataFrame, column: str, levels: Sequence | None = None, keep=None) -> DataFrame:
    """df with a 0/1 column for each level instead of the column; NULL gives 0 everywhere. keep: that level's column only. More than MOST_LEVELS levels are an error."""
    if levels is None:
        found = df.select(_q(column)).where(_q(column).isNotNull()).distinct().limit(MOST_LEVELS + 1).collect()
        if len(found) > MOST_LEVELS:
            raise ValueError(f"{column} has more than {MOST_LEVELS} levels")
        levels = sorted(r[0] for r in found)
    if keep is not None and keep not in levels:
        raise KeyError(f"{column} has no level {keep}")
    wanted = [keep] if keep is not None else list(levels)
    return df.select(*[_q(c) for c in df.columns if c != column], *[F.coalesce((_q(column) == F.lit(v)).cast("int"), F.lit(0)).alias(f"{column}_{level_name(v)}") for v in wanted])


def square_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Squares of the columns after all others."""
    if gone := [c for c in columns if c not in df.columns]:
        raise RuntimeError(f"no columns {gone}")
    return df.select("*", *[(_q(c) * _q(c)).alias(f"{c}_squared") for c in columns])


def drop_empty_rows(domains: dict[str, DataFrame], others: dict[str, DataFrame] | None = None, key: str = "eid") -> tuple[dict[str, DataFrame], dict[str, DataFrame], DataFrame]:
    """Subjects without any value in one of the domains leave all tables, until none is left; the tables and who left.

    A column encoded as 0/1 is never NULL, so a domain with one drops nobody. Dropping rows makes no other row
    empty, so one round is the fixed point.
    """
    from varistrata.operators.cohort import all_missing

    gone = None
    for df in domains.values():
        own = df.where(all_missing([c for c in df.columns if c != key])).select(key)
        gone = own if gone is None else gone.unionByName(own)
    gone = gone.distinct()
    cut = lambda tables: {n: d.join(gone, key, "left_anti") for n, d in (tables or {}).items()}
    return cut(domains), cut(others), gone


@dataclass
class CleaningPlan:
    """What is done to a domain: fields to average (field: columns), columns to encode (column: level to keep or None), columns to square."""

    average: dict[str, list[str]] = field(default_factory=dict)
    encode: dict[str, object] = field(default_factory=dict)
    square: list[str] = field(default_factory=list)
    holdout: list[str] = field(default_factory=list)
    thresholds: dict[str, float] = field(default_factory=dict)


def clean(domains: dict[str, DataFrame], plans: dict[str, CleaningPlan], extra: dict[str, DataFrame] | None = None, key: str = "eid") -> tuple[dict[str, DataFrame], dict[str, DataFrame], DataFrame]:
    """Hold out, average, encode, square and (if thresholds are given) drop bad columns of each domain, then drop empty rows everywhere."""
    cleaned, others = {}, dict(extra or {})
    for name, df in domains.items():
        plan = plans.get(name, CleaningPlan())
        if plan.holdout:
            others[f"holdout_{name}"] = df.select(key, *[_q(c) for c in plan.holdout])
            df = df.select(*[_q(c) for c in df.columns if c not in set(plan.holdout)])
        df = row_means(df, list(plan.average.items()))
        for column, keep in plan.encode.items():
            df = one_hot(df, column, keep=keep)
        if plan.square:
            df = square_columns(df, plan.square)
        if plan.thresholds:
            good = find_bad_columns(df, [c for c in df.columns if c != key], **plan.thresholds).kept
            df = df.select(key, *[_q(c) for c in good])
        cleaned[name] = df
    return drop_empty_rows(cleaned, others, key)


# Scalings: each fits in one pass and gives expressions.


def zscore(df: DataFrame, columns: Sequence[str], ddof: int = 1) -> DataFrame:
    """(x - mean) / deviation; a column without spread becomes NULL."""
    sd = F.stddev_samp if ddof else F.stddev_pop
    row = df.agg(*[f(_q(c)).alias(f"{c}__{n}") for c in columns for n, f in (("m", F.avg), ("s", sd))]).first()
    scaled = {c: (_q(c) - F.lit(row[f"{c}__m"])) / F.lit(row[f"{c}__s"] or None) for c in columns}
    return df.withColumns(scaled)


def demean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    row = df.agg(*[F.avg(_q(c)).alias(c) for c in columns]).first()
    return df.withColumns({c: _q(c) - F.lit(row[c]) for c in columns})


def fill_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    row = df.agg(*[F.avg(_q(c)).alias(c) for c in columns]).first()
    return df.withColumns({c: F.coalesce(_q(c).cast("double"), F.lit(row[c])) for c in columns})


def robust_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - median) / interquartile range; a range of 0 counts as 1."""
    found = exact_quantiles(wide_to_long(df, [], columns), ["column"], "value", [0.25, 0.5, 0.75])
    row = {r["column"]: (r["q0"], r["q1"], r["q2"]) for r in found.collect()}
    scaled = {c: (_q(c) - F.lit(row[c][1])) / F.lit((row[c][2] - row[c][0]) or 1.0) for c in columns if c in row}
    return df.withColumns(scaled)


#: Ranges of values in which ranks are worked out separately, and how many groups' bounds are broadcast (about 500 bytes each).
RANGES, BROADCAST_GROUPS = 64, 10_000


def running_counts(counts: DataFrame, keys: Sequence[str], value: str, n: str = "_n") -> DataFrame:
    """counts (distinct values of each group and how often they occur) with `_upto`, the rows up to each value, and `_total`.

    Approximate quantiles part a group's values into ranges; each range is summed by itself and starts where
    the ones before end. Rough quantiles only make uneven ranges, the sums are exact. They are checkpointed, since
    they may come out otherwise when they are worked out again.
    """
    steps = [i / RANGES for i in range(1, RANGES)]
    bounds = cut_lineage(counts.groupBy(*keys).agg(F.percentile_approx(value, steps, 1000).alias("_bounds"), F.sum(n).alias("_total")))
    ranged = counts.join(F.broadcast(bounds) if bounds.count() <= BROADCAST_GROUPS else bounds, list(keys)).withColumn("_range", F.size(F.filter("_bounds", lambda b: b < F.col(value)))).drop("_bounds")
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(*keys, "_range").agg(F.sum(n).alias("_s")).withColumn("_start", F.coalesce(F.sum("_s").over(before), F.lit(0))).drop("_s")
    own = F.sum(n).over(Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn("_own", own).join(starts, [*keys, "_range"]).withColumn("_upto", F.col("_start") + F.col("_own")).drop("_range", "_own", "_start")


def numbered(df: DataFrame, order: Sequence[Column], place: str = "place") -> DataFrame:
    """df with its rows' places from 0 in an order of all rows, without a task that sees them all.

    Rows are parted by ranges of the order, sorted and numbered within their parts, and a part begins where the ones before
    end. The parts are checkpointed, so they are the same for their counts and their numbers; as many counts as parts are
    broadcast. Rows that are equal in the order have places next to each other, which of them first is open.
    """
    spread = df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    fixed = cut_lineage(spread.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    counts = fixed.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_from"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("_part").alias("_of"), "_from", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    joined = fixed.join(F.broadcast(starts), F.col("_part") == F.col("_of"))
    return joined.withColumn(place, F.col("_start") + F.col("_at") - F.col("_from")).drop("_part", "_at", "_of", "_from", "_start")


#: Accuracy of the approximate quantiles that windows are cut by, and by how many of its errors a window goes beyond the place wanted.
ACCURACY, MARGIN = 10_000, 5


def exact_quantiles(long: DataFrame, keys: Sequence[str], value: str, steps: Sequence[float]) -> DataFrame:
    """keys, q0, q1, ...: linearly interpolated quantiles of the present values of each group.

    Approximate quantiles a little below and above each step cut a window of values (about a thousandth of the rows) that
    holds the place wanted. One pass counts the rows below each window and the values inside; all other rows end as one count in
    the task that reads them, so values are neither shuffled nor sorted but for those in windows.
    """
    by = list(keys)
    present = long.where(F.col(value).isNotNull())
    ends = [min(1.0, max(0.0, q + side * MARGIN / ACCURACY)) for q in steps for side in (-1, 1)]
    bounds = cut_lineage(present.groupBy(*by).agg(F.percentile_approx(value, ends, ACCURACY).alias("_b"), F.count("*").alias("_total")))
    small = F.broadcast(bounds) if bounds.count() <= BROADCAST_GROUPS else bounds
    named = small.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(by)})
    joined = present.join(named, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(by)]) if by else present.join(named)
    v, many = F.col(value), range(len(steps))
    inside = [(v >= F.col("_b")[2 * i]) & (v <= F.col("_b")[2 * i + 1]) for i in many]
    told = F.array(*[F.when(c, F.lit(i)) for i, c in enumerate(inside)])
    low, high = (lambda i: F.col("_b")[2 * i]), (lambda i: F.col("_b")[2 * i + 1])
    # Beside a window count the nearest values outside, which interpolation may need.
    outside = [c for i in many for c in (F.count_if(v < low(i)).alias(f"_c{i}"), F.max(F.when(v < low(i), v)).alias(f"_p{i}"), F.min(F.when(v > high(i), v)).alias(f"_s{i}"))]
    cells = joined.groupBy(*by, F.when(F.array_size(F.array_compact(told)) > 0, v).alias("_v")).agg(F.count("*").alias("_n"), F.max("_total").alias("_total"), F.max("_b").alias("_b"), *outside)
    whole = Window.partitionBy(*by)
    step = [F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("q"), low(i).alias("low"), high(i).alias("high"), F.sum(f"_c{i}").over(whole).alias("below"), F.max(f"_p{i}").over(whole).alias("before"), F.min(f"_s{i}").over(whole).alias("after")) for i, q in enumerate(steps)]
    placed = cells.withColumn("_steps", F.array(*step)).where("_v is not null").select(*by, "_v", "_n", "_total", F.explode("_steps").alias("_s"))
    own = placed.where("_v >= _s.low and _v <= _s.high").withColumn("_i", F.col("_s.i"))
    upto = F.col("_s.below") + F.sum("_n").over(Window.partitionBy(*by, "_i").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    at = F.col("_s.q") * (F.col("_total") - 1)
    ranked = own.withColumns({"_upto": upto, "_t": at - F.floor(at), "_first": F.floor(at), "_next": F.least(F.floor(at) + 1, F.col("_total") - 1)})
    found = ranked.groupBy(*by, "_i").agg(*[F.min(F.when(F.col("_upto") > F.col(r), F.col("_v"))).alias(f"{r}_v") for r in ("_first", "_next")], F.max("_upto").alias("_end"), *[F.first(c).alias(n) for c, n in (("_t", "_t"), ("_first", "_first"), ("_next", "_next"), ("_s.below", "_below"), ("_s.before", "_before"), ("_s.after", "_after"))])

    def value_at(rank: str) -> Column:
        missed = F.raise_error(F.lit("a quantile lies outside of its window")).cast("double")
        at_edge = F.when(F.col(rank) == F.col("_below") - 1, F.col("_before")).when(F.col(rank) == F.col("_end"), F.col("_after")).otherwise(missed)
        return F.when((F.col(rank) >= F.col("_below")) & (F.col(rank) < F.col("_end")), F.col(f"{rank}_v")).otherwise(at_edge)

    ends = found.withColumns({"_low": value_at("_first"), "_high": value_at("_next")})
    told = ends.withColumn("_q", (F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_t")).cast("double"))
    return told.groupBy(*by).agg(*[F.max(F.when(F.col("_i") == i, F.col("_q"))).alias(f"q{i}") for i in many])


def inverse_normal(long: DataFrame, value: str = "value", partition: Sequence[str] = ("column",), method: str = "blom") -> DataFrame:
    """long with `score`: normal quantiles of the average ranks within each column.

    Equal values are ranked once from their counts, and the distinct values of a column are ranked range by range.
    """
    c = kernels.RANK_CONSTANTS[method]
    keys = list(partition)
    counts = long.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    rank = F.col("_upto") - (F.col("_n") - 1) / 2
    ranked = running_counts(counts, keys, value)
    scores = ranked.withColumn("_p", (rank - F.lit(c)) / (F.col("_total") - F.lit(2 * c) + 1))
    scores = normal.with_quantile(scores, "_p", "score").select(*keys, value, "score")
    return long.join(scores, [*keys, value], "left")


def fit_quantiles(df: DataFrame, columns: Sequence[str], most: int = 1000) -> dict[str, list[float]]:
    """Quantiles of each column at even steps (most of them, or as many as there are values), however many columns there are.

    Values are counted and their places worked out range by range; only those next to a wanted place, about three for
    each step, come to the driver. They are interpolated there, so ties stay ties to the last bit.
    """
    counts = wide_to_long(df, [], columns).where("value is not null").groupBy("column", "value").agg(F.count("*").alias("_n"))
    placed = running_counts(counts, ["column"], "value")
    step = (F.least(F.col("_total"), F.lit(most)) - 1) / F.greatest(F.col("_total") - 1, F.lit(1))
    near = F.floor((F.col("_upto") + 1) * step) > F.floor((F.col("_upto") - F.col("_n") - 2) * step)
    rows = placed.where(near | (F.col("_total") <= most)).select("column", "value", "_upto", "_total").orderBy("column", "_upto").toArrow()
    names = np.array(rows["column"].to_pylist())
    values, upto, total = (rows[c].to_numpy() for c in ("value", "_upto", "_total"))
    found = {}
    for c in dict.fromkeys(names.tolist()):
        own = names == c
        v, u, n = values[own], upto[own], int(total[own][0])
        at = np.linspace(0, 1, max(2, min(most, n))) * (n - 1)
        low = np.floor(at).astype(int)
        rank = lambda k: v[np.searchsorted(u, k, side="right")]  # noqa: B023, E731
        a, b, t = rank(low), rank(np.minimum(low + 1, n - 1)), at - low
        found[c] = np.where(t >= 0.5, b - (b - a) * (1 - t), a + (b - a) * t).tolist()
    return found


def quantile_transform(df: DataFrame, references: dict[str, list[float]]) -> DataFrame:
    """The columns with references as normal scores; others stay."""
    def scorer(q: list[float]):
        points = np.array(q)

        @F.pandas_udf(T.DoubleType())
        def score(x):
            import pandas as pd

            return pd.Series(kernels.quantile_normal(x.to_numpy(float), points))

        return score

    return df.withColumns({c: scorer(q)(_q(c).cast("double")) for c, q in references.items()})


def filtered_quantile_columns(columns: Sequence[str], value_type: dict[str, int]) -> list[str]:
    """Columns that a quantile transform applies to: of value types 11 and 31, and row means and deviations."""
    if len(set(columns)) != len(columns):
        raise RuntimeError("columns repeat")
    return [c for c in columns if value_type.get(c.split("_")[0]) in (11, 31) or "_mean" in c or "_std" in c]
