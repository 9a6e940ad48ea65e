"""Linear models on sufficient statistics: one pass over the data, algebra on small matrices.

Products of columns are summed inside tasks (Arrow blocks to numpy) and the partial sums in a second, narrow step,
so the driver gets a fixed number of small matrices, however many rows or partitions there are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varistrata.functions import kernels

#: Partial sums that reach the driver, at most.
BLOCKS = 16
#: Sets of missing columns whose products imputation takes to the driver (12 columns have no more; with more sets it passes over the rows), and rounds that one pass over the data measures.
MOST_PATTERNS, ROUNDS = 4096, 10


def _block(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(batch.num_columns)]) if batch.num_columns else np.zeros((batch.num_rows, 0))


@dataclass
class Moments:
    """Sums over rows of the values less `shift`, missing ones as 0: n, presence (N = M'M), products (S = Z'Z), mixed (T = Z'M) and squares (Q = (Z*Z)'M)."""

    columns: list[str]
    n: int
    both: np.ndarray
    products: np.ndarray
    mixed: np.ndarray
    squares: np.ndarray
    shift: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diag(self.both)

    @property
    def offsets(self) -> np.ndarray:
        """The means less the shift; 0 for a column without values."""
        with np.errstate(all="ignore"):
            return np.where(self.counts > 0, np.diag(self.mixed) / self.counts, 0.0)

    @property
    def means(self) -> np.ndarray:
        return np.where(self.counts > 0, self.shift + self.offsets, 0.0)

    def moved(self, shift: np.ndarray) -> Moments:
        """The sums of the values less another shift."""
        d = self.shift - shift
        products = self.products + d[:, None] * self.mixed.T + self.mixed * d[None, :] + np.outer(d, d) * self.both
        squares = self.squares + 2 * d[:, None] * self.mixed + (d * d)[:, None] * self.both
        return Moments(self.columns, self.n, self.both, products, self.mixed + d[:, None] * self.both, squares, np.asarray(shift, float))

    def centred(self) -> np.ndarray:
        """Z'Z of the columns less their means, missing values as 0 after that."""
        return self.moved(self.shift + self.offsets).products

    def at(self, columns: Sequence[str]) -> list[int]:
        return [self.columns.index(c) for c in columns]

    def correlation(self, i: int, j: int) -> float | None:
        """Pearson over the rows that have both; None with fewer than 2 or without spread."""
        n = self.both[i, j]
        if n < 2:
            return None
        sx, sy = self.mixed[i, j], self.mixed[j, i]
        sxx, syy, sxy = self.squares[i, j] - sx * sx / n, self.squares[j, i] - sy * sy / n, self.products[i, j] - sx * sy / n
        return float(sxy / np.sqrt(sxx * syy)) if sxx > 0 and syy > 0 else None


def _own_moments(x: np.ndarray, shift: np.ndarray) -> np.ndarray:
    x = x - shift
    m = np.isfinite(x)
    z, mf = np.where(m, x, 0.0), m.astype(float)
    return np.concatenate([[len(x)], (mf.T @ mf).ravel(), (z.T @ z).ravel(), (z.T @ mf).ravel(), ((z * z).T @ mf).ravel(), shift])


def moments(df: DataFrame, columns: Sequence[str], centre: bool = False) -> Moments:
    """Sums in one pass. With `centre` they are taken around rough means (those of a task's first rows), which keeps them
    exact where values are far from 0; sums of several tasks are moved to one centre before they are added.
    """
    p = len(columns)

    def unpacked(total: np.ndarray) -> Moments:
        both, products, mixed, squares = total[1 : 1 + 4 * p * p].reshape(4, p, p)
        return Moments(list(columns), int(total[0]), both, products, mixed, squares, total[1 + 4 * p * p :])

    def added(parts: Iterator[bytes]) -> np.ndarray:
        total = None
        for part in parts:
            one = np.frombuffer(part).copy()
            if total is None or not total[0]:
                total = one
            elif one[0]:
                m = unpacked(one).moved(total[1 + 4 * p * p :])
                total[: 1 + 4 * p * p] += np.concatenate([[m.n], m.both.ravel(), m.products.ravel(), m.mixed.ravel(), m.squares.ravel()])
        return np.zeros(1 + 4 * p * p + p) if total is None else total

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = _block(batch)
            if total is None or not total[0]:
                near = np.where(np.isfinite(x), x, 0.0).sum(axis=0) / np.maximum(np.isfinite(x).sum(axis=0), 1) if centre else np.zeros(p)
                total = _own_moments(x, near)
            else:
                total[: 1 + 4 * p * p] += _own_moments(x, total[1 + 4 * p * p :])[: 1 + 4 * p * p]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = added(part for batch in batches for part in batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    parts = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).mapInArrow(first, "sums binary")
    few = parts.repartition(BLOCKS).mapInArrow(second, "sums binary")
    return unpacked(added(bytes(r["sums"]) for r in few.collect()))


def cross_products(df: DataFrame, columns: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, present values of each column, and sums of products with missing values as 0: one matrix, where moments has four."""
    p = len(columns)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + p + p * p)
        for batch in batches:
            x = _block(batch)
            m = np.isfinite(x)
            z = np.where(m, x, 0.0)
            total += np.concatenate([[len(x)], m.sum(axis=0), (z.T @ z).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum((np.frombuffer(v) for batch in batches for v in batch.column(0).to_pylist()), np.zeros(1 + p + p * p))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    rows = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    few = rows.mapInArrow(first, "sums binary").repartition(BLOCKS).mapInArrow(second, "sums binary").collect()
    total = sum((np.frombuffer(bytes(r["sums"])) for r in few), np.zeros(1 + p + p * p))
    return int(total[0]), total[1 : 1 + p], total[1 + p :].reshape(p, p)


def gram_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """i, j, value for i <= j: sums of products, missing values as 0."""
    _, _, products = cross_products(df, columns)
    rows = [(a, b, float(products[i, j])) for i, a in enumerate(columns) for j, b in enumerate(columns) if i <= j]
    return df.sparkSession.createDataFrame(rows, "i string, j string, value double")


@dataclass
class Imputation:
    """Column means and the updates of missing values (column, weights of the others, constant), in the order they are made."""

    columns: list[str]
    means: np.ndarray
    updates: list[tuple[int, np.ndarray, float]]


def _by_pattern(x: np.ndarray, shift: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """pattern (bits of the missing columns) and [1, values less shift, missing ones as 0] of its rows."""
    gone = ~np.isfinite(x)
    e = np.column_stack([np.ones(len(x)), np.where(gone, 0.0, x - shift)])
    bits = gone @ (1 << np.arange(x.shape[1]))
    for pattern in np.unique(bits):
        yield int(pattern), e[bits == pattern]


def _pattern_products(rows: DataFrame, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Which columns each set of missing columns lacks, and the products of [1, values less shift] of its rows; None if there are more than MOST_PATTERNS sets."""
    import pandas as pd

    p, most = len(shift), MOST_PATTERNS
    if p > 62:
        return None

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for pattern, e in _by_pattern(_block(batch), shift):
                total[pattern] = total.get(pattern, 0.0) + (e.T @ e).ravel()
            if len(total) > most:  # this task alone says that there are too many
                total = dict(list(total.items())[: most + 1])
                break
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["pattern", "sums"])

    def add(pdf):
        return pd.DataFrame({"pattern": pdf["pattern"].iloc[:1], "sums": [np.sum([np.frombuffer(v) for v in pdf["sums"]], axis=0).tobytes()]})

    parts = rows.mapInArrow(sums, "pattern long, sums binary")
    found = parts.groupBy("pattern").applyInPandas(add, "pattern long, sums binary").limit(most + 1).collect()
    if len(found) > most:
        return None
    gone = np.array([[bool(r["pattern"] >> j & 1) for j in range(p)] for r in found]).reshape(-1, p)
    return gone, np.array([np.frombuffer(bytes(r["sums"])) for r in found]).reshape(-1, p + 1, p + 1)


def _replayed(batch: pa.RecordBatch, means: np.ndarray, updates: Sequence) -> tuple[np.ndarray, np.ndarray]:
    x = _block(batch)
    gone = ~np.isfinite(x)
    return kernels.refilled(np.where(gone, means, x), gone, updates), gone


def _observed_products(rows: DataFrame, means: np.ndarray, updates: list, j: int) -> np.ndarray:
    """Products of [1, values less means] of the rows that have column j, as the updates so far fill them."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(means) + 1, len(means) + 1))
        for batch in batches:
            filled, gone = _replayed(batch, means, updates)
            e = np.column_stack([np.ones(len(filled)), filled - means])[~gone[:, j]]
            total += e.T @ e
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(np.frombuffer(v) for batch in batches for v in batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()] if isinstance(total, np.ndarray) else [], pa.binary())], ["sums"])

    few = rows.mapInArrow(first, "sums binary").repartition(BLOCKS).mapInArrow(second, "sums binary").collect()
    return np.sum([np.frombuffer(bytes(r["sums"])) for r in few], axis=0).reshape(len(means) + 1, -1)


def _changes(rows: DataFrame, means: np.ndarray, before: list, rounds: list[list]) -> list[float]:
    """The largest change of any filled value by each round of updates, in one pass."""

    def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = np.zeros(len(rounds))
        for batch in batches:
            filled, gone = _replayed(batch, means, before)
            for i, own in enumerate(rounds):
                old = filled.copy()
                top[i] = max(top[i], np.abs(kernels.refilled(filled, gone, own) - old).max(initial=0.0))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(top)), pa.int32()), pa.array(top)], ["round", "change"])

    found = rows.mapInArrow(largest, "round int, change double").groupBy("round").agg(F.max("change").alias("change")).collect()
    return [c for _, c in sorted((r["round"], r["change"]) for r in found)]


def _weights(products: np.ndarray, means: np.ndarray, j: int, ridge: float | None) -> tuple[int, np.ndarray, float]:
    """The update of column j, from products of [1, values less means] of the rows that have it."""
    n = products[0, 0]
    m = products[0, 1:] / n
    w = kernels.imputation_weights(products[1:, 1:] - n * np.outer(m, m), n, j, ridge)
    own = means + m
    return int(j), w, float(own[j] - np.delete(own, j) @ w)


def fit_imputation(df: DataFrame, columns: Sequence[str], rounds: int = 100, tolerance: float = 1e-3, ridge: float | None = None) -> Imputation:
    """The updates that kernels.IterativeImputer makes on one block of all rows.

    A filled value is a linear function of its row's known values, the same in all rows that miss the same columns. So sums of
    products by sets of missing columns give every round's regressions. Beyond MOST_PATTERNS sets each regression has a pass of its
    own, in which rows are filled as far as the updates go; the updates are the same but for rounding.
    """
    p = len(columns)
    rows = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    own = moments(rows, rows.columns, centre=True)
    means, missing = own.means, own.n - own.counts
    top = rows.agg(*[F.max(F.abs(F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)))) for c in rows.columns]).first() if p else ()
    limit = tolerance * max((v for v in top if v is not None), default=0.0)
    order = [int(j) for j in np.argsort(missing, kind="stable") if missing[j] < own.n]
    some = bool(missing.any())
    found = _pattern_products(rows, means)
    if found is not None:
        gone, products = found
        # [1, known less means] @ maps[i] are the filled columns of set i, less means.
        maps = np.where(gone[:, None, :], 0.0, np.eye(p + 1)[None, :, 1:])
        one = np.eye(p + 1)[:, :1]

    def update(so_far: list, j: int) -> tuple[int, np.ndarray, float]:
        if found is None:
            return _weights(_observed_products(rows, means, so_far, j), means, j, ridge)
        whole = np.concatenate([np.broadcast_to(one, (len(maps), p + 1, 1)), maps], axis=2)[~gone[:, j]]
        made = _weights(np.einsum("iab,iac,icd->bd", whole, products[~gone[:, j]], whole), means, j, ridge)
        others = [k for k in range(p) if k != j]
        constant = made[2] - means[j] + means[others] @ made[1]
        maps[gone[:, j], :, j] = (maps[:, :, others] @ made[1])[gone[:, j]] + one[:, 0] * constant
        return made

    updates: list = []
    # With sums by sets, a pass measures several rounds; the ones beyond the last are not kept.
    at_once, done = (ROUNDS if found is not None else 1), 0
    while order and done < (rounds if some else 1):
        made: list[list] = []
        for _ in range(min(at_once, rounds - done) if some else 1):
            made.append([])
            for j in order:
                made[-1].append(update([*updates, *(u for r in made for u in r)], j))
        done += len(made)
        changes = _changes(rows, means, updates, made) if some else [0.0]
        last = next((i for i, c in enumerate(changes) if c < limit), None)
        for own_round in made if last is None else made[: last + 1]:
            updates += own_round
        if last is not None:
            break
    return Imputation(list(columns), means, updates)


def impute(df: DataFrame, model: Imputation) -> DataFrame:
    """df with the missing values of the model's columns filled, row by row where they lie; other columns stay."""
    others = [c for c in df.columns if c not in set(model.columns)]
    rows = df.select(*[F.col(f"`{c}`") for c in others], *[F.col(f"`{c}`").cast("double").alias(c) for c in model.columns])

    names = rows.columns

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            filled, _ = _replayed(batch.select(list(range(len(others), batch.num_columns))), model.means, model.updates)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], *[pa.array(c) for c in filled.T]], names=names)

    return rows.mapInArrow(fill, rows.schema).select(*[F.col(f"`{c}`") for c in df.columns])


def iterative_impute(df: DataFrame, columns: Sequence[str], key: str, rounds: int = 100, tolerance: float = 1e-3, ridge: float | None = None) -> DataFrame:
    """key and the columns, missing values filled by regressions of each column on all others (Bayesian; ridge: a fixed one)."""
    return impute(df.select(F.col(f"`{key}`"), *[F.col(f"`{c}`") for c in columns]), fit_imputation(df, columns, rounds, tolerance, ridge))


def _dot(columns: Sequence[str], weights: np.ndarray) -> Column:
    return sum((F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) * float(w) for c, w in zip(columns, weights, strict=True)), F.lit(0.0))


def deconfound_weights(df: DataFrame, columns: Sequence[str], confounds: Sequence[str]) -> np.ndarray:
    """Confounds by columns: least squares without intercept, missing values of a column as 0; one pass."""
    n, counts, products = cross_products(df, [*confounds, *columns])
    q = len(confounds)
    if (counts[:q] < n).any():
        raise ValueError("confounds must have no missing values")
    return np.linalg.pinv(products[:q, :q]) @ products[:q, q:]


def remove_confounds(df: DataFrame, columns: Sequence[str], confounds: Sequence[str], weights: np.ndarray) -> DataFrame:
    return df.withColumns({c: F.col(f"`{c}`") - _dot(confounds, weights[:, j]) for j, c in enumerate(columns)})


def deconfound(df: DataFrame, columns: Sequence[str], confounds: Sequence[str]) -> DataFrame:
    """Columns less what the confounds explain (no intercept; missing values of a column count as 0 in the fit and stay missing)."""
    return remove_confounds(df, columns, confounds, deconfound_weights(df, columns, confounds)) if confounds else df


def fit_pca(df: DataFrame, columns: Sequence[str], n_components: int | float | None = None) -> kernels.NanPca:
    """In one pass over the rows."""
    m = moments(df, columns, centre=True)
    return kernels.NanPca.from_moments(m.means, m.centred(), m.n, n_components)


def pca_scores(df: DataFrame, columns: Sequence[str], model: kernels.NanPca, prefix: str = "PC") -> DataFrame:
    """df with one column for each component; missing values don't count."""
    centred = [F.coalesce(F.col(f"`{c}`").cast("double") - float(m), F.lit(0.0)) for c, m in zip(columns, model.mean, strict=True)]
    new = {f"{prefix}{k + 1}": sum((c * float(w) for c, w in zip(centred, model.components[:, k], strict=True)), F.lit(0.0)) for k in range(model.components.shape[1])}
    return df.withColumns(new)


def fit_cca(df: DataFrame, x: Sequence[str], y: Sequence[str], n_components: int | None = None) -> kernels.Cca:
    """From one pass; rows with a missing value in either view are left out."""
    whole = df.na.drop("any", subset=[*x, *y])
    m = moments(whole, [*x, *y], centre=True)
    s = m.centred() / max(1, m.n - 1)
    p = len(x)
    return kernels.Cca.from_moments(m.means[:p], m.means[p:], s[:p, :p], s[p:, p:], s[:p, p:], n_components)


def cca_scores(df: DataFrame, x: Sequence[str], y: Sequence[str], model: kernels.Cca) -> DataFrame:
    out = {}
    for name, columns, mean, weights in zip("XY", (x, y), model.means, model.weights, strict=True):
        for k in range(weights.shape[1]):
            out[f"{name}{k + 1}"] = sum(((F.col(f"`{c}`").cast("double") - float(m)) * float(w) for c, m, w in zip(columns, mean, weights[:, k], strict=True)), F.lit(0.0))
    return df.withColumns(out)


def components_reaching(model: kernels.NanPca, fractions: Sequence[float]) -> list[int]:
    """How many components have each share of the variance."""
    return [int(np.searchsorted(np.cumsum(model.share), f, side="right")) + 1 for f in fractions]


def rotate_to(df: DataFrame, scores: Sequence[str], reference: Sequence[str], mode: str = "aligned") -> DataFrame:
    """df with the scores rotated to the reference columns; the rotation comes from sums of products of all rows, one pass."""
    _, _, products = cross_products(df, [*scores, *reference])
    q = kernels.rotation(products[: len(scores), len(scores) :], mode)
    turned = [sum((F.col(f"`{c}`") * float(w) for c, w in zip(scores, q[:, k], strict=True)), F.lit(0.0)) for k in range(len(scores))]
    return df.withColumns(dict(zip(scores, turned, strict=True)))


def cca_predict(df: DataFrame, x: Sequence[str], y: Sequence[str], model: kernels.Cca, suffix: str = "_predicted") -> DataFrame:
    """df with each column of the second view as the first view's canonical scores give it."""
    w = model.weights[0] * model.correlations @ np.linalg.pinv(model.weights[1])
    value = lambda j: sum(((F.col(f"`{c}`").cast("double") - float(m)) * float(w[i, j]) for i, (c, m) in enumerate(zip(x, model.means[0], strict=True))), F.lit(float(model.means[1][j])))
    return df.withColumns({f"{c}{suffix}": value(j) for j, c in enumerate(y)})


def pca_restore(df: DataFrame, columns: Sequence[str], model: kernels.NanPca, prefix: str = "PC", suffix: str = "_restored") -> DataFrame:
    """df with the columns as the components' scores give them."""
    value = lambda j: sum((F.col(f"{prefix}{k + 1}") * float(model.components[j, k]) for k in range(model.components.shape[1])), F.lit(float(model.mean[j])))
    return df.withColumns({f"{c}{suffix}": value(j) for j, c in enumerate(columns)})


def loadings(df: DataFrame, features: Sequence[str], scores: Sequence[str], normalise: bool = True) -> DataFrame:
    """feature, component (from 1), loading: pairwise-complete correlations, or products with missing values as 0; one pass."""
    m = moments(df, [*features, *scores], centre=normalise)
    rows = []
    for f in features:
        for k, s in enumerate(scores):
            i, j = m.columns.index(f), m.columns.index(s)
            rows.append((f, k + 1, m.correlation(i, j) if normalise else float(m.products[i, j])))
    return df.sparkSession.createDataFrame(rows, "feature string, component int, loading double")


def simple_regressions(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """keys, slope, intercept, r2 of y on x in each group, over the rows that have both."""
    return df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def regression_scores(df: DataFrame, components: Sequence[str], covariates: Sequence[str], y: str, fitted: Column, cumulative: bool = False, method: str = "r2", root: bool = False) -> DataFrame:
    """components, set_name (fit, test), score: of least squares with intercept, fitted on the rows of `fitted`, scored on those and on the others.

    A regression for each component, or for the first 1, 2, ... of them, with the covariates always in: r2 or mse, if
    wanted its root. One pass over each of the two sets; rows with a missing value don't count.
    """
    if method not in ("r2", "mse"):
        raise ValueError(f"unknown score {method}")
    names = [y, *components, *covariates]
    whole = df.withColumn("_fitted", F.coalesce(fitted, F.lit(False))).na.drop("any", subset=names)
    parts = {name: moments(whole.where("_fitted" if name == "fit" else "not _fitted"), names, centre=True) for name in ("fit", "test")}
    own = parts["fit"]
    z = own.centred()
    always = own.at(covariates)
    rows = []
    for k in range(len(components)):
        at = [*(range(1, k + 2) if cumulative else [k + 1]), *always]
        beta = np.linalg.lstsq(z[np.ix_(at, at)], z[at, 0], rcond=None)[0]
        for name, part in parts.items():
            q, mean = part.centred(), part.means
            shift = (mean[0] - own.means[0]) - (mean[at] - own.means[at]) @ beta
            residual = q[0, 0] - 2 * beta @ q[at, 0] + beta @ q[np.ix_(at, at)] @ beta + part.n * shift**2
            value = (residual / part.n if method == "mse" else 1 - residual / q[0, 0]) if part.n and q[0, 0] else None
            rows.append((k + 1, name, None if value is None else float(np.sqrt(value)) if root else float(value)))
    return df.sparkSession.createDataFrame(rows, "components int, set_name string, score double")


def fit_mcca(df: DataFrame, views: Sequence[Sequence[str]], n_components: int | None = None) -> kernels.MultiCca:
    """Canonical correlation of two or more views from one pass; rows with a missing value in any view are left out."""
    columns = [c for v in views for c in v]
    m = moments(df.na.drop("any", subset=columns), columns, centre=True)
    return kernels.MultiCca.from_moments(m.means, m.centred() / max(1, m.n - 1), [len(v) for v in views], n_components)


def mcca_scores(df: DataFrame, views: dict[str, Sequence[str]], model: kernels.MultiCca) -> DataFrame:
    """df with one column for each view and component, named by the view and the component's number."""
    out = {}
    for (name, columns), mean, weights in zip(views.items(), model.means, model.weights, strict=True):
        for k in range(weights.shape[1]):
            out[f"{name}{k + 1}"] = sum(((F.col(f"`{c}`").cast("double") - float(m)) * float(w) for c, m, w in zip(columns, mean, weights[:, k], strict=True)), F.lit(0.0))
    return df.withColumns(out)


def correlation_tensor(df: DataFrame, scores: dict[str, Sequence[str]]) -> DataFrame:
    """view_a, view_b, component (from 1), corr of each pair of views (each with itself too), over the rows that have both; one aggregation. All views have as many scores."""
    names = list(scores)
    if len({len(c) for c in scores.values()}) != 1:
        raise ValueError("the views have different numbers of scores")
    cells = [(a, b, k) for i, a in enumerate(names) for b in names[i:] for k in range(len(scores[a]))]
    value = lambda v, k: F.col(f"`{scores[v][k]}`").cast("double")

    def corr(x: Column, y: Column) -> Column:
        both = x.isNotNull() & y.isNotNull()
        return F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(F.when(both, x)) * F.var_pop(F.when(both, y))))  # NULL without spread

    row = df.agg(*[corr(value(a, k), value(b, k)).alias(f"c{i}") for i, (a, b, k) in enumerate(cells)])
    both = [(x, y, k, i) for i, (a, b, k) in enumerate(cells) for x, y in dict.fromkeys([(a, b), (b, a)])]
    told = [F.struct(F.lit(x).alias("view_a"), F.lit(y).alias("view_b"), F.lit(k + 1).alias("component"), F.when(F.isnan(f"c{i}"), None).otherwise(F.col(f"c{i}")).alias("corr")) for x, y, k, i in both]
    return row.select(F.inline(F.array(*told)))


def mean_pair_correlation(df: DataFrame, scores: dict[str, Sequence[str]]) -> DataFrame:
    """component, score: the mean correlation over the pairs of different views; NULL if one of them is."""
    pairs = correlation_tensor(df, scores).where("view_a < view_b")
    return pairs.groupBy("component").agg(F.when(F.count("corr") == F.count("*"), F.avg("corr")).alias("score"))


def pairwise_score(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """component (from 1) and score of two views, given as pairs of columns: their correlations."""
    return mean_pair_correlation(df, {"a": [a for a, _ in pairs], "b": [b for _, b in pairs]})
