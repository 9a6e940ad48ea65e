"""Tables of results over repetitions: aggregates, significance, signs, ranks and reshaping."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, is_dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType
from pyspark.sql.window import Window

from varistrata.operators.columns import numbered

QUANTILES = (0.025, 0.975, 0.05, 0.95)


def summarise(df: DataFrame, keys: Sequence[str], value: str, functions: dict[str, Callable[[str], Column]]) -> DataFrame:
    """One row for each group and function: keys, func, value."""
    wide = df.groupBy(*keys).agg(*[fn(value).alias(n) for n, fn in functions.items()])
    return wide.unpivot(list(keys), list(functions), "func", "value")


def mean_std(df: DataFrame, keys: Sequence[str], value: str, loadings: bool) -> DataFrame:
    """keys, mean, std over repetitions; the deviation of loadings has n - 1, that of correlations and scores n."""
    sd = F.stddev_samp if loadings else F.stddev_pop
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), sd(value).alias("std"))


def null_quantiles(df: DataFrame, keys: Sequence[str], value: str, quantiles: Sequence[float] = QUANTILES, skip_missing: bool = True) -> DataFrame:
    """keys and one column for each quantile (q0 is 0.025, ...), linearly interpolated. Not skip_missing: one missing value makes all NULL."""
    cells = [F.percentile(value, F.lit(q)) for q in quantiles]
    if not skip_missing:
        cells = [F.when(F.count(value) == F.count("*"), c) for c in cells]
    return df.groupBy(*keys).agg(*[c.alias(f"q{i}") for i, c in enumerate(cells)])


def _beside(rows: DataFrame, totals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows with what totals (a row for each group, in equal names of keys) has for their group; NULL is a group."""
    named = totals.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    if not keys:
        return rows.join(F.broadcast(named))
    return rows.join(named, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]).drop(*[f"_k{i}" for i in range(len(keys))])


def significance_mask(means: DataFrame, null: DataFrame, feature: str = "feature", keys: Sequence[str] = ()) -> DataFrame:
    """means (keys, feature, value) with low, high, masked: true if the value lies inside the null band, so is not significant.

    null: feature, low, high of one (the largest) size. A band without width counts as missing; missing bounds get the mean bound.
    """
    band = null.select(feature, F.when(F.col("low") != F.col("high"), F.col("low")).alias("low"), F.when(F.col("low") != F.col("high"), F.col("high")).alias("high"))
    joined = means.join(band, feature, "left")
    middle = joined.groupBy(*keys).agg(F.avg("low").alias("_low"), F.avg("high").alias("_high"))  # one row without keys
    filled = _beside(joined, middle, keys).withColumns({"low": F.coalesce("low", "_low"), "high": F.coalesce("high", "_high")}).drop("_low", "_high")
    return filled.withColumn("masked", (F.col("low") < F.col("value")) & (F.col("value") < F.col("high")))


def significant(value: str, low: str, high: str) -> Column:
    return (F.col(value) > F.col(high)) | (F.col(value) < F.col(low))


def flip_bounds(df: DataFrame, sign: Column, value: str = "value", low: str = "low", high: str = "high") -> DataFrame:
    """Where sign is negative the value is negated, and the bounds are negated and swapped."""
    negative = sign < 0
    return df.withColumns({value: F.when(negative, -F.col(value)).otherwise(F.col(value)), low: F.when(negative, -F.col(high)).otherwise(F.col(low)), high: F.when(negative, -F.col(low)).otherwise(F.col(high))})


def ordinal_rank(df: DataFrame, keys: Sequence[str], value: str, feature: str) -> DataFrame:
    """df of present values with `rank` from 0, upwards by value, then by feature."""
    order = Window.partitionBy(*keys).orderBy(value, feature)
    return df.where(F.col(value).isNotNull()).withColumn("rank", F.row_number().over(order) - 1)


def top_and_bottom(df: DataFrame, keys: Sequence[str], value: str, feature: str, n: int = 10) -> DataFrame:
    """The n largest and n smallest of each group, with `end`."""
    up, down = Window.partitionBy(*keys).orderBy(F.desc(value), feature), Window.partitionBy(*keys).orderBy(F.asc(value), feature)
    ranked = df.where(F.col(value).isNotNull()).withColumns({"_d": F.row_number().over(up), "_a": F.row_number().over(down)})
    return ranked.where(f"_d <= {n}").withColumn("end", F.lit("top")).unionByName(ranked.where(f"_a <= {n}").withColumn("end", F.lit("bottom"))).drop("_d", "_a")


def sign_anchor(df: DataFrame, keys: Sequence[str], feature: str, value: str) -> DataFrame:
    """keys, anchor, sign: the feature with the largest absolute value and its sign (0 counts as +1)."""
    top = df.groupBy(*keys).agg(F.max_by(feature, F.struct(F.abs(value), F.col(feature))).alias("anchor"), F.max_by(value, F.struct(F.abs(value), F.col(feature))).alias("_v"))
    return top.select(*keys, "anchor", F.when(F.col("_v") < 0, -1.0).otherwise(1.0).alias("sign"))


def align_signs(loadings: DataFrame, reference: DataFrame, anchor_dataset: str = "brain", scores: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Loadings (and scores) of all repetitions with each component's sign such that the anchor's loading is positive.

    The anchor of a cca_type and component is the feature with the largest absolute learning loading of the anchor
    dataset in the reference result; in every other result it is found by name.
    """
    here = reference.where((F.col("dataset") == anchor_dataset) & (F.col("set_name") == "learn"))
    anchors = sign_anchor(here, ["cca_type", "component"], "feature", "loading").select("cca_type", "component", F.col("anchor").alias("feature"))
    keys = ["subset", "sample_size", "rep", "cca_type", "component"]
    own = loadings.where((F.col("dataset") == anchor_dataset) & (F.col("set_name") == "learn")).join(anchors, ["cca_type", "component", "feature"])
    signs = own.groupBy(*keys).agg(F.when(F.first("loading") < 0, -1.0).otherwise(1.0).alias("_sign"))
    turn = lambda df, value: df.join(signs, keys, "left").withColumn(value, F.col(value) * F.coalesce("_sign", F.lit(1.0))).drop("_sign")
    return turn(loadings, "loading"), None if scores is None else turn(scores, "value")


def flip_repeated(df: DataFrame) -> DataFrame:
    """r_learn and r_val of repeated_cv rows are negated where r_learn is negative."""
    turn = (F.col("cca_type") == "repeated_cv") & (F.col("r_learn") < 0)
    return df.withColumns({c: F.when(turn, -F.col(c)).otherwise(F.col(c)) for c in ("r_learn", "r_val")})


def with_inflation(df: DataFrame) -> DataFrame:
    return df.withColumn("inflation", F.col("r_learn") - F.col("r_val"))


def null_threshold(null: DataFrame, keys: Sequence[str], value: str = "r_val", q: float = 0.99, size: str = "sample_size") -> DataFrame:
    """keys, threshold: the quantile at the largest size of each group."""
    largest = _beside(null, null.groupBy(*keys).agg(F.max(size).alias("_most")), keys).where(F.col(size) == F.col("_most"))
    return largest.groupBy(*keys).agg(F.percentile(value, F.lit(q)).alias("threshold"))


def first_size_over(stats: DataFrame, thresholds: DataFrame, keys: Sequence[str], deviations: float = 1.0, size: str = "sample_size") -> DataFrame:
    """keys, size: the least size whose mean is over threshold + deviations * std."""
    joined = stats.join(thresholds, list(keys))
    return joined.where(F.col("mean") > F.col("threshold") + deviations * F.coalesce("std", F.lit(0.0))).groupBy(*keys).agg(F.min(size).alias(size))


def least_size_reaching(stats: DataFrame, keys: Sequence[str], level: float, size: str = "sample_size") -> DataFrame:
    """keys, size: the least size whose mean is at the level or over it."""
    return stats.where(F.col("mean") >= level).groupBy(*keys).agg(F.min(size).alias(size))


def first_significant(masks: DataFrame, keys: Sequence[str], dataset: str = "dataset", size: str = "sample_size") -> DataFrame:
    """keys, size: the least size with a significant loading in each dataset, and the largest of those."""
    each = masks.where(~F.col("masked")).groupBy(*keys, dataset).agg(F.min(size).alias("_s"))
    return each.groupBy(*keys).agg(F.max("_s").alias(size))


def summary_difference(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """a - b where both have a value."""
    joined = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), list(keys))
    return joined.select(*keys, (F.col("_a") - F.col("_b")).alias(value)).na.drop("any", subset=[value])


def size_gap(df: DataFrame, keys: Sequence[str], size: str = "sample_size") -> DataFrame:
    """df with `gap` to the next smaller size of its group."""
    return df.withColumn("gap", F.col(size) - F.lag(size).over(Window.partitionBy(*keys).orderBy(size)))


def use_largest_null(null: DataFrame, sizes: DataFrame, size: str = "sample_size") -> DataFrame:
    """The rows of the largest size of null, for every size."""
    most = null.agg(F.max(size).alias("_most"))  # one row
    return null.join(F.broadcast(most), F.col(size) == F.col("_most")).drop("_most", size).join(sizes.select(size).distinct())


def overlaps(members: DataFrame, key: str = "eid", group: str = "subset") -> DataFrame:
    """a, b, n: subjects that two groups share (a <= b); from distinct (group, key)."""
    each = members.select(group, key).distinct()
    sets = each.groupBy(key).agg(F.sort_array(F.collect_set(group)).alias("g"))
    pairs = sets.select(F.explode(F.flatten(F.transform("g", lambda a: F.transform(F.filter("g", lambda b: b >= a), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p"))
    return pairs.groupBy("p.a", "p.b").agg(F.count("*").alias("n"))


def clean_label(column: str) -> Column:
    """(mean25) to (mean), (std25) to (std), a number in brackets and a [category] away."""
    out = F.regexp_replace(F.col(column), r"\((mean|std)\d+\)", r"($1)")
    out = F.regexp_replace(out, r" \(\d+\)", "")
    return F.regexp_replace(out, r"^\[[^\]]*\] ", "")


def code_label(column: str, names: dict[int, str]) -> Column:
    """The name of a code, or of its thousands; NULL if neither has one."""
    out = F.lit(None).cast("string")
    for code, name in reversed(list(names.items())):
        out = F.when((F.col(column) == code) | (F.floor(F.col(column) / 1000) == code), F.lit(name)).otherwise(out)
    return out


def poisson_thresholds() -> list[str]:
    """Four hexadecimal digits each: a uniform number from 0 to ffff counts as often as it reaches one of them, by Poisson's law with mean 1."""
    share, term, out, k = 0.0, math.exp(-1), [], 0
    while (reached := round((share := share + term) * 65536)) < 65536:
        out.append(f"{reached:04x}")
        k += 1
        term /= k
    return out


#: Rows that are weighed for all resamples at once, and groups whose sums a task holds before it passes them on.
WEIGHED_ROWS, HELD_GROUPS = 2000, 1000


def bootstrap_intervals(df: DataFrame, keys: Sequence[str], value: str, level: float = 95, draws: int = 1000, seed: int = 3791, row: str | None = None) -> DataFrame:
    """keys, low, high: percentile interval of the mean of the present values.

    Each row counts a Poisson number of times in each resample, by a hash of the resample and of the column `row`, which
    tells rows apart (without it, of the row's place, so intervals then depend a little on how the rows are stored).
    A task adds the sums of all resamples up as it reads the rows, and passes on one record for each group: no row is
    repeated or shuffled, and no group gathered. A resample of a group in which no row counts is left out.
    """
    import hashlib

    import numpy as np
    import pandas as pd
    import pyarrow as pa

    names = list(keys)
    tag = F.monotonically_increasing_id() if row is None else F.col(row)
    rows = df.where(F.col(value).isNotNull()).select(*names, F.col(value).cast("double").alias("_value"), tag.cast("string").alias("_row"))
    steps, hashes = np.array([int(t, 16) for t in poisson_thresholds()]), (draws - 1) // 8 + 1
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in names)

    def weights(tags: list[str]) -> np.ndarray:
        """Rows by draws; one hash has the digits of eight resamples."""
        digests = b"".join(hashlib.md5(f"{seed}-{t}-{b}".encode()).digest() for t in tags for b in range(hashes))
        return np.searchsorted(steps, np.frombuffer(digests, ">u2"), side="right").reshape(len(tags), -1)[:, :draws].astype(float)

    def sums(batches):
        held: dict[tuple, np.ndarray] = {}
        types: list = []

        def told():
            cells = [pa.array([k[i] for k in held], types[i]) for i in range(len(names))]
            return pa.RecordBatch.from_arrays([*cells, pa.array([v.tobytes() for v in held.values()], pa.binary())], [*names, "_sums"])

        for whole in batches:
            types = types or [whole.schema.field(i).type for i in range(len(names))]
            for start in range(0, whole.num_rows, WEIGHED_ROWS):
                batch = whole.slice(start, WEIGHED_ROWS)
                w, x = weights(batch.column(len(names) + 1).to_pylist()), batch.column(len(names)).to_numpy(zero_copy_only=False)
                at: dict[tuple, list[int]] = {}
                for i, k in enumerate(zip(*[c.to_pylist() for c in batch.columns[: len(names)]], strict=True) if names else [()] * batch.num_rows):
                    at.setdefault(k, []).append(i)
                for k, own in at.items():
                    one = np.stack([w[own].sum(axis=0), x[own] @ w[own]])
                    held[k] = held[k] + one if k in held else one
                if len(held) > HELD_GROUPS:
                    yield told()
                    held = {}
        if held:
            yield told()

    low, high = 50 - level / 2, 50 + level / 2

    def interval(pdf):
        n, total = np.sum([np.frombuffer(v) for v in pdf["_sums"]], axis=0).reshape(2, -1)
        means = total[n > 0] / n[n > 0]
        ends = np.percentile(means, [low, high]) if len(means) else [None, None]
        return pd.DataFrame({k: pdf[k].iloc[:1] for k in names} | {"low": ends[:1], "high": ends[1:]})

    parts = rows.mapInArrow(sums, ", ".join(filter(None, [kinds, "_sums binary"])))
    return parts.groupBy(*names).applyInPandas(interval, ", ".join(filter(None, [kinds, "low double, high double"])))


def subset_label(df: DataFrame) -> DataFrame:
    """df with subset_cca_type, the two in one."""
    return df.withColumn("subset_cca_type", F.concat_ws("-", "subset", "cca_type"))


def mark_reference(df: DataFrame, column: str, reference) -> DataFrame:
    """df with is_ref: whether the column has the reference's value."""
    return df.withColumn("is_ref", F.coalesce(F.col(column) == F.lit(reference), F.lit(False)))


def _in_order(df: DataFrame, order: Sequence[Column], place: str | None) -> DataFrame:
    return df.orderBy(*order) if place is None else numbered(df, order, place)


def correlation_table(df: DataFrame, place: str | None = None) -> DataFrame:
    """Correlations in the order of subset, cca_type, size and repetition; place: instead of sorting all, a column with each row's place from 0."""
    return _in_order(df, [F.col(c) for c in ("subset", "cca_type", "sample_size", "rep", "component", "set_name") if c in df.columns], place)


def repetition_matrix(df: DataFrame, features: Sequence[str], rep: str = "rep", feature: str = "feature", value: str = "loading") -> DataFrame:
    """A row for each repetition, a column for each feature, in order of the repetitions."""
    return df.groupBy(rep).pivot(feature, list(features)).agg(F.first(value, ignorenulls=True)).orderBy(rep)


def by_largest_size(table: DataFrame, sizes: Sequence[int], feature: str = "feature", place: str | None = None) -> DataFrame:
    """Rows of a table with a column for each size, largest values of the largest size first, NULL last; place: as in correlation_table."""
    return _in_order(table, [F.desc_nulls_last(f"`{max(sizes)}`"), F.col(feature)], place)


def key_product(*tables: DataFrame) -> DataFrame:
    """All combinations of the distinct rows of small key tables."""
    out = tables[0].distinct()
    for t in tables[1:]:
        out = out.crossJoin(t.distinct())
    return out


def multiply_correlations(df: DataFrame, factors: Sequence[float], value: str = "corr") -> DataFrame:
    """Correlations of component k times the k-th factor; there must be one for each component."""
    n = df.agg(F.max("component")).first()[0]
    if n != len(factors):
        raise ValueError(f"{len(factors)} factors for {n} components")
    return df.withColumn(value, F.col(value) * F.element_at(F.array(*[F.lit(float(f)) for f in factors]), F.col("component").cast("int")))


def ensemble_scores(df: DataFrame, keys: Sequence[str], value: str = "value", method: str | Callable[[str], Column] = "nanmean") -> DataFrame:
    """keys, value: one score for each key from those of several models. Without `nan` a missing one makes the result NULL."""
    if callable(method):
        return df.groupBy(*keys).agg(method(value).alias(value))
    known = {"mean": F.avg, "median": lambda c: F.percentile(c, F.lit(0.5))}
    if method.removeprefix("nan") not in known:
        raise ValueError(f"unknown ensemble {method}")
    found = known[method.removeprefix("nan")](value)
    return df.groupBy(*keys).agg((found if method.startswith("nan") else F.when(F.count(value) == F.count("*"), found)).alias(value))


@dataclass(frozen=True)
class Nested:
    """Values under keys of several levels, as rows; a key with several rows holds a list."""

    frame: DataFrame
    levels: tuple[str, ...]
    value: str = "value"

    def _match(self, key: Sequence, whole: bool) -> Column:
        if len(key) > len(self.levels) or (whole and len(key) < len(self.levels)):
            raise KeyError(f"{len(key)} keys for {len(self.levels)} levels")
        return reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.lit(k)) for n, k in zip(self.levels, key, strict=False)], F.lit(True))

    def get(self, *key) -> list:
        """The values under a whole key."""
        found = [r[0] for r in self.frame.where(self._match(key, True)).select(self.value).collect()]
        if not found:
            raise KeyError(key)
        return found

    def under(self, *prefix) -> Nested:
        """What is under the first levels, by the levels that are left."""
        left = self.levels[len(prefix) :]
        return Nested(self.frame.where(self._match(prefix, False)).select(*left, self.value), left, self.value)

    def _with(self, frame: DataFrame, key: Sequence, value) -> Nested:
        row = frame.sparkSession.createDataFrame([(*key, value)], frame.select(*self.levels, self.value).schema)
        return replace(self, frame=frame.select(*self.levels, self.value).unionByName(row))

    def put(self, key: Sequence, value) -> Nested:
        """The value in place of what is under the key."""
        return self._with(self.frame.where(~self._match(key, True)), key, value)

    def append(self, key: Sequence, value) -> Nested:
        """The value after those under the key."""
        self._match(key, True)
        return self._with(self.frame, key, value)

    def apply_any(self, functions: dict[str, Callable], kind: str = "double", level: str = "func", order: Sequence[str] = ()) -> Nested:
        """What functions of Python make of the values under each key, with the functions' names as a further level.

        A function gets one numpy array for a key (rows of a matrix, if values are arrays), missing values as NaN, in the order of
        the columns `order` and then of the values; where it can't work on that (TypeError, AttributeError) it gets a
        pandas Series or DataFrame. It returns a `kind`. Each key is a group of its own with all its
        values, so there should be as many as there are repetitions or models, not rows of a cohort; keys are spread over the tasks.
        """
        import numpy as np
        import pandas as pd

        names, value, wanted = list(self.levels), self.value, list(order)
        several = self.frame.schema[value].dataType.typeName() == "array"

        def made(fn: Callable, values: np.ndarray):
            try:
                out = fn(values)
            except (TypeError, AttributeError):
                out = fn(pd.DataFrame(values) if several else pd.Series(values))
            return out.tolist() if isinstance(out, (np.ndarray, pd.Series)) else None if out is None or out != out else out

        def apply(pdf):
            if several:
                values = np.stack([np.asarray(v, float) for v in pdf["_v"]])
                values = values[np.lexsort((*values.T[::-1], *[pdf[f"_o{i}"].to_numpy() for i in reversed(range(len(wanted)))]))]
            else:
                values = pdf.sort_values([*[f"_o{i}" for i in range(len(wanted))], "_v"])["_v"].to_numpy(float)
            rows = [(*[pdf[f"_k{i}"].iloc[0] for i in range(len(names))], name, made(fn, values)) for name, fn in functions.items()]
            return pd.DataFrame(rows, columns=[*[f"_k{i}" for i in range(len(names))], "_f", "_r"])

        rows = self.frame.select(*[F.col(n).alias(f"_k{i}") for i, n in enumerate(names)], F.col(value).alias("_v"), *[F.col(o).alias(f"_o{i}") for i, o in enumerate(wanted)])
        schema = ", ".join([*[f"_k{i} {self.frame.schema[n].dataType.simpleString()}" for i, n in enumerate(names)], "_f string", f"_r {kind}"])
        out = rows.groupBy(*[f"_k{i}" for i in range(len(names))]).applyInPandas(apply, schema)
        return Nested(out.select(*[F.col(f"_k{i}").alias(n) for i, n in enumerate(names)], F.col("_f").alias(level), F.col("_r").alias(value)), (*names, level), value)

    def apply(self, functions: dict[str, Callable[[str], Column]]) -> DataFrame:
        """One row for each key, a column for each function of its values."""
        return self.frame.groupBy(*self.levels).agg(*[fn(self.value).alias(n) for n, fn in functions.items()])


def list_mean(column: str) -> Column:
    """The mean of an array's present values; NULL without any."""
    have = F.filter(column, lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(have, F.lit(0.0), lambda a, x: a + x), F.size(have))


def list_std(column: str) -> Column:
    """The deviation (with n) of an array's present values."""
    have = F.filter(column, lambda x: x.isNotNull())
    mean = list_mean(column)
    return F.sqrt(F.try_divide(F.aggregate(have, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)), F.size(have)))


def told(settings) -> str:
    """The parameters of a settings object or mapping, a line for each."""
    items = asdict(settings) if is_dataclass(settings) else dict(settings)
    width = max(map(len, map(str, items)), default=0)
    return "\n".join(f"{name!s:<{width}}  {value}" for name, value in items.items())


def heatmap_tables(means: DataFrame, stds: DataFrame, null: DataFrame, sizes: Sequence[int], feature: str = "feature", size: str = "sample_size") -> dict[str, DataFrame]:
    """mag, rank, mask and std: a row for each feature, a column for each size. means and stds: feature, size, value; null: feature, low, high of the largest size."""
    wide = lambda df, value: df.groupBy(feature).pivot(size, list(sizes)).agg(F.first(value))
    masks = significance_mask(means, null, feature, [size])
    magnitude = means.withColumn("value", F.abs("value"))
    return {"mag": wide(magnitude, "value"), "rank": wide(ordinal_rank(magnitude, [size], "value", feature), "rank"), "mask": wide(masks, "masked"), "std": wide(stds, "value")}


def loadings_with_bounds(loadings: DataFrame, low: DataFrame, high: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, value, low, high; a feature that one of them lacks stays, with NULL."""
    named = [loadings.select(*keys, "value"), low.select(*keys, F.col("value").alias("low")), high.select(*keys, F.col("value").alias("high"))]
    return named[0].join(named[1], list(keys), "full_outer").join(named[2], list(keys), "full_outer")


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df, after making sure that no two rows have the same keys."""
    twice = df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").limit(1).collect()
    if twice:
        raise RuntimeError(f"more than one row for {[twice[0][k] for k in keys]}")
    return df


def nested_rows(items: dict, levels: Sequence[str]) -> list[tuple]:
    """(level keys ..., value) of a nested mapping, down to the named levels; every branch must have the same keys at a level."""
    rows: list[tuple] = []
    known: dict[int, set] = {}

    def walk(value, at: int, path: tuple) -> None:
        if at == len(levels):
            rows.append((*path, value))
            return
        if not isinstance(value, dict):
            raise RuntimeError(f"there is no level {levels[at]} below {path}")
        if known.setdefault(at, set(value)) != set(value):
            raise RuntimeError(f"branches have different keys at level {levels[at]}")
        for k, v in value.items():
            walk(v, at + 1, (*path, k))

    walk(items, 0, ())
    if not rows:
        raise RuntimeError("nothing to aggregate")
    return rows


def nested_frame(df: DataFrame, column: str, levels: Sequence[str], value: str = "value") -> DataFrame:
    """nested_rows for a column of maps in maps: the other columns, a column for each level, and the value.

    Every branch of every row must have the same keys at a level. Rows whose map is null have no branch. What lies
    where: one aggregate over all levels, of which a row for each comes to the driver; keys, not values, are compared.
    """
    others = [c for c in df.columns if c != column]
    out = df.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{column}`").alias("_held"))
    seen = []
    for at, level in enumerate(levels):
        if not isinstance(out.schema["_held"].dataType, MapType):
            raise RuntimeError(f"there is no level {level} below {list(levels[:at])}")
        keys = F.sort_array(F.map_keys("_held"))
        seen.append(out.where("_held is not null").select(F.lit(at).alias("at"), F.to_json(F.struct(keys.alias("k"))).alias("k")))
        kept = [c for c in out.columns if c != "_held"]
        out = out.select(*[F.col(f"`{c}`") for c in kept], F.explode("_held").alias(level, "_held"))
    found = reduce(DataFrame.unionByName, seen).groupBy("at").agg(F.min("k").alias("least"), F.max("k").alias("most")).collect()
    for r in found:
        if r.least != r.most:
            raise RuntimeError(f"branches have different keys at level {levels[r['at']]}")
    if len(found) < len(levels) or any(r.least == '{"k":[]}' for r in found):
        raise RuntimeError("nothing to aggregate")
    return out.withColumnRenamed("_held", value)
