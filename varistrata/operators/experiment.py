"""The experiment grid: canonical correlation for each sub-cohort, repetition and sample size.

A sample's rows lie in blocks (`blocks`): one that fits into a block is fitted as it is, a larger one by its columns and by sums of its blocks.
Where columns are only standardised, `folds.run_linear_grid` takes all folds in one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varistrata.functions import kernels
from varistrata.operators.columns import filtered_quantile_columns

#: What a fit says of values that are not finite.
NOT_FINITE = "array must not contain infs or NaNs"
#: Rows that all models of an ensemble look at in one step.
PIECE = 2048
RESULT = "subset string, null_model boolean, sample_size int, rep int, cca_type string, set_name string, metric string, dataset string, feature string, component int, pos long, value double"


@dataclass(frozen=True)
class Settings:
    n_pcs: tuple[int, int] = (20, 20)
    n_folds: int = 5
    cv_reps: int = 20
    missing: float = 0.5
    #: Columns whose most frequent value has this share or more are left out; None: 1 - 1 / n_folds.
    frequency: float | None = None
    ensemble: str = "nanmean"
    rotation: str = "aligned"
    #: Of without_cv, repeated_cv and cv (the models of one split into folds, each scored on its own rows and those left out; pos is the fold).
    cca_types: tuple[str, ...] = ("without_cv", "repeated_cv")
    scores: bool = False
    seed: int = 3791
    #: Fits that failed are tried again with other folds at most so often.
    retries: int = 5
    normalise_loadings: bool = True
    #: Changes a member's scores (a list, one array a view) before they are rotated to the reference.
    model_transform: Callable[[list], list] | None = None


@dataclass
class Views:
    """Two blocks of columns and the confounds of some rows.

    quantile: which columns of each are turned into normal scores; numeric: which confounds are, and are squared (None: all).
    """

    x: list[np.ndarray]
    names: list[list[str]]
    confounds: np.ndarray | None = None
    quantile: list[np.ndarray] = field(default_factory=list)
    numeric: np.ndarray | None = None

    def rows(self, at: np.ndarray | slice) -> Views:
        return replace(self, x=[x[at] for x in self.x], confounds=None if self.confounds is None else self.confounds[at])


def selected(x: np.ndarray, missing: float, frequency: float) -> np.ndarray:
    """Which columns have few missing values and no dominant one."""
    share = np.isnan(x).mean(axis=0)
    keep = share < missing
    for j in np.flatnonzero(keep):
        have = x[~np.isnan(x[:, j]), j]
        keep[j] = len(have) > 0 and np.unique(have, return_counts=True)[1].max() / len(have) < frequency
    return keep


class Scaler:
    """Quantile scores of some columns, then median and interquartile range of all."""

    def fit(self, x: np.ndarray, quantile: np.ndarray) -> Scaler:
        self.references = {j: kernels.quantile_references(x[:, j]) for j in np.flatnonzero(quantile)}
        self.middle, self.spread = kernels.robust_center_scale(self._scores(x))
        return self

    def _scores(self, x: np.ndarray) -> np.ndarray:
        out = x.copy()
        for j, q in self.references.items():
            out[:, j] = kernels.quantile_normal(x[:, j], q)
        return out

    def transform(self, x: np.ndarray) -> np.ndarray:
        return (self._scores(x) - self.middle) / self.spread


class Preprocessor:
    """Scaling, deconfounding and components of each view, with confounds imputed, scaled and squared; fitted on one set of rows."""

    def __init__(self, n_pcs: Sequence[int]):
        self.n_pcs = n_pcs

    def fit(self, v: Views) -> Preprocessor:
        if len(self.n_pcs) != len(v.x):
            raise ValueError("as many numbers of components as views are needed")
        self.imputer = None
        c = None
        if v.confounds is not None:
            self.imputer = kernels.IterativeImputer()
            filled = self.imputer.fit_transform(v.confounds)
            self.numeric = np.ones(filled.shape[1], dtype=bool) if v.numeric is None else v.numeric
            self.confound_scaler = Scaler().fit(filled, self.numeric)
            c = self._confounds(v)
        self.scalers = [Scaler().fit(x, q) for x, q in zip(v.x, v.quantile, strict=True)]
        self.weights, self.pcas = [], []
        for x, scaler, k in zip(v.x, self.scalers, self.n_pcs, strict=True):
            z = scaler.transform(x)
            w = None if c is None else kernels.deconfound_weights(c, z)
            self.weights.append(w)
            self.pcas.append(kernels.NanPca(k).fit(kernels.deconfound(c, z, w)))
        return self

    def _confounds(self, v: Views) -> np.ndarray | None:
        if self.imputer is None:
            return None
        c = self.confound_scaler.transform(self.imputer.transform(v.confounds))
        return np.concatenate([c, c[:, self.numeric] ** 2], axis=1)

    def deconfounded(self, v: Views, only: Sequence[int] | None = None) -> list[np.ndarray]:
        c = self._confounds(v)
        return [kernels.deconfound(c, self.scalers[i].transform(v.x[i]), self.weights[i]) for i in (range(len(v.x)) if only is None else only)]

    def transform(self, v: Views) -> list[np.ndarray]:
        return [p.transform(x) for p, x in zip(self.pcas, self.deconfounded(v), strict=True)]


class Model:
    """Preprocessing and canonical correlation of one set of rows; shuffled: rows of the views after the first are permuted, with their confounds."""

    def __init__(self, settings: Settings):
        self.settings = settings

    def fit(self, v: Views, shuffle: np.random.Generator | None = None) -> Model:
        own = v
        if shuffle is not None:
            order = shuffle.permutation(len(v.x[0]))
            own = replace(v, x=[v.x[0], *[x[order] for x in v.x[1:]]])
            # The confounds of the permuted views move with them, so each view is fitted by itself.
            moved = replace(own, confounds=None if v.confounds is None else v.confounds[order])
            self.parts = [Preprocessor(self.settings.n_pcs).fit(own), Preprocessor(self.settings.n_pcs).fit(moved)]
            scores = [self.parts[0].transform(own)[0], *self.parts[1].transform(moved)[1:]]
        else:
            self.parts = [Preprocessor(self.settings.n_pcs).fit(v)]
            scores = self.parts[0].transform(v)
        self.cca = kernels.Cca(min(self.settings.n_pcs)).fit(scores)
        self.learn_scores = self.cca.transform(scores)
        return self

    def transform(self, v: Views) -> list[np.ndarray]:
        return self.scores(self.deconfounded(v))

    def scores(self, columns: list[np.ndarray]) -> list[np.ndarray]:
        """Canonical scores from deconfounded columns."""
        return self.cca.transform([self.parts[min(i, len(self.parts) - 1)].pcas[i].transform(x) for i, x in enumerate(columns)])

    def deconfounded(self, v: Views) -> list[np.ndarray]:
        if len(self.parts) == 1 or self.parts[0] is self.parts[1]:
            return self.parts[0].deconfounded(v)
        return [*self.parts[0].deconfounded(v, [0]), *self.parts[1].deconfounded(v, range(1, len(v.x)))]


def folds(n: int, k: int, rng: np.random.Generator) -> list[np.ndarray]:
    """The training rows of each fold of a shuffled split."""
    parts = np.array_split(rng.permutation(n), k)
    return [np.sort(np.concatenate([p for j, p in enumerate(parts) if j != i])) for i in range(k)]


def cut(v: Views, keep: Sequence[np.ndarray]) -> Views:
    """The columns of each view that are kept."""
    return replace(v, x=[x[:, k] for x, k in zip(v.x, keep, strict=True)], names=[[n for n, ok in zip(names, k, strict=True) if ok] for names, k in zip(v.names, keep, strict=True)], quantile=[q[k] for q, k in zip(v.quantile, keep, strict=True)])


@dataclass
class State:
    """The models of a learning sample: which columns are kept, the one of all rows, and those of repeated folds with the turn of each view to it."""

    keep: list[np.ndarray]
    plain: Model
    members: list[tuple[Model, list[np.ndarray]]] = field(default_factory=list)


def members(learn: Views, reference: list[np.ndarray], settings: Settings, rng: np.random.Generator, null_model: bool = False) -> list[tuple[Model, list[np.ndarray]]]:
    """The models of all folds of all repetitions, with the turns of their scores to the reference."""
    models: list[Model] = []
    failures = 0
    while len(models) < settings.cv_reps * settings.n_folds:
        try:
            models += [Model(settings).fit(learn.rows(t), rng if null_model else None) for t in folds(len(learn.x[0]), settings.n_folds, rng)]
        except (np.linalg.LinAlgError, ValueError) as error:
            # Only what other folds can mend; any other error is one of the program or its input.
            failures += 1
            if failures > settings.retries or not (isinstance(error, np.linalg.LinAlgError) or str(error) == NOT_FINITE):
                raise
    changed = settings.model_transform or (lambda scores: scores)
    out = []
    for m in models:
        # The rotation comes from the learning rows and holds for every set.
        out.append((m, [np.linalg.lstsq(s, kernels.procrustes(s, r, settings.rotation), rcond=None)[0] for s, r in zip(changed(m.transform(learn)), reference, strict=True)]))
    return out


def looked(state: State, kind: str, v: Views, settings: Settings) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Scores and deconfounded columns of rows (without columns that are not kept): of the plain model, or the ensemble's over all folds of all repetitions."""
    if kind == "without_cv":
        columns = state.plain.deconfounded(v)
        return state.plain.scores(columns), columns
    changed = settings.model_transform or (lambda scores: scores)
    columns = [m.deconfounded(v) for m, _ in state.members]
    turned = [[s @ t for s, t in zip(changed(m.scores(x)), turns, strict=True)] for (m, turns), x in zip(state.members, columns, strict=True)]
    mean = lambda parts: kernels.ensemble(parts, None, settings.ensemble, rotate=False)
    return mean(turned), mean(columns)


def told(kind: str, set_name: str, scores: list[np.ndarray], columns: list[np.ndarray], names: list[list[str]], settings: Settings) -> list[tuple]:
    """Correlations, loadings and, if wanted, scores as rows."""
    rows = [(kind, set_name, "corr", None, None, k + 1, None, float(c)) for k, c in enumerate(kernels.component_scores(scores))]
    for i, (s, x) in enumerate(zip(scores, columns, strict=True)):
        table = kernels.loadings(x, s, settings.normalise_loadings)
        rows += [(kind, set_name, "loading", str(i), f, k + 1, None, float(table[j, k])) for j, f in enumerate(names[i]) for k in range(table.shape[1])]
        if settings.scores:
            rows += [(kind, set_name, "score", str(i), None, k + 1, r, float(s[r, k])) for r in range(len(s)) for k in range(s.shape[1])]
    return rows


def learned(learn: Views, settings: Settings, null_model: bool, seed: Sequence[int]) -> tuple[list[tuple], State, list[list[str]]]:
    """Rows (cca_type, set_name, metric, dataset, feature, component, pos, value) that a learning sample gives, its models, and the names of the columns kept."""
    rng = np.random.default_rng([settings.seed, *seed])
    frequency = 1 - 1 / settings.n_folds if settings.frequency is None else settings.frequency
    keep = [selected(x, settings.missing, frequency) for x in learn.x]
    learn = cut(learn, keep)
    state = State(keep, Model(settings).fit(learn, rng if null_model else None))
    rows = []
    if "without_cv" in settings.cca_types:
        rows += told("without_cv", "learn", state.plain.learn_scores, state.plain.deconfounded(learn), learn.names, settings)
    if "repeated_cv" in settings.cca_types:
        state.members = members(learn, state.plain.learn_scores, settings, rng, null_model)
        # A model_transform may look at all rows; otherwise a few at a time do, as each model gives a table of them.
        step = len(learn.x[0]) if settings.model_transform else PIECE
        parts = [looked(state, "repeated_cv", learn.rows(np.arange(k, min(k + step, len(learn.x[0])))), settings) for k in range(0, len(learn.x[0]), step)]
        rows += told("repeated_cv", "learn", *[[np.concatenate([p[what][v] for p in parts]) for v in range(len(learn.x))] for what in (0, 1)], learn.names, settings)
    if "cv" in settings.cca_types:
        for i, train in enumerate(folds(len(learn.x[0]), settings.n_folds, rng)):
            out = np.setdiff1d(np.arange(len(learn.x[0])), train)
            model = Model(settings).fit(learn.rows(train), rng if null_model else None)
            for set_name, scores in (("learn", model.learn_scores), ("val", model.transform(learn.rows(out)))):
                rows += [("cv", set_name, "corr", None, None, k + 1, i, float(c)) for k, c in enumerate(kernels.component_scores(scores))]
    return rows, state, learn.names


def unit(learn: Views, val: Views, settings: Settings, null_model: bool, seed: Sequence[int]) -> list[tuple]:
    """Rows (cca_type, set_name, metric, dataset, feature, component, pos, value) of one sample."""
    rows, state, names = learned(learn, settings, null_model, seed)
    for kind in ("without_cv", "repeated_cv"):
        if kind in settings.cca_types:
            rows += told(kind, "val", *looked(state, kind, cut(val, state.keep), settings), names, settings)
    return [(*r[:-1], None if not np.isfinite(r[-1]) else r[-1]) for r in rows]


def run_grid(frame: DataFrame, datasets: dict[str, list[str]], samples: DataFrame, settings: Settings, confounds: Sequence[str] = (), quantile: Sequence[str] = (), null_model: bool = False, key: str = "eid", value_type: dict[str, int] | None = None) -> DataFrame:
    """RESULT rows of all units. frame: key and the columns of the two datasets and the confounds; samples: as sampling.design gives them.

    value_type: codes by column; those of integers and continuous values (and row means and deviations) are turned into
    normal scores, and such confounds are squared. Without it `quantile` names the columns, and all confounds are numeric.
    Keys are of any type. A sampled key that the frame lacks is left out, one that it has twice gives both rows.
    A model_transform gets all scores of a set, so with one a unit is one group; so is a learning sample where confounds are missing, as they
    are imputed from each other round by round for each model.
    """
    import pandas as pd

    from varistrata.operators import blocks

    names = list(datasets)
    columns = [c for n in names for c in datasets[n]] + list(confounds)
    numeric = np.ones(len(confounds), dtype=bool)
    if value_type is not None:
        quantile = filtered_quantile_columns(columns, value_type)
        numeric = np.array([c in set(quantile) for c in confounds], dtype=bool)
    wanted = set(quantile)
    shape = blocks.Shape(tuple(tuple(datasets[n]) for n in names), len(confounds), np.array([c in wanted for n in names for c in datasets[n]], dtype=bool), numeric)
    if settings.model_transform is None:
        return blocks.run(frame, datasets, samples, settings, confounds, shape, null_model, key)
    views = shape.views

    def solved(group: tuple, learn: np.ndarray, val: np.ndarray) -> pd.DataFrame:
        subset, rep, size = group
        rows = unit(views(learn), views(val), settings, null_model, [int(rep), int(size), int(null_model)])
        full = [(subset, null_model, size, rep, *r[:3], names[int(r[3])] if r[3] is not None else None, *r[4:]) for r in rows]
        out = pd.DataFrame(full, columns=[c.strip().split()[0] for c in RESULT.split(",")])
        return out.astype({"pos": "Int64"})

    # Validation rows that serve all sizes are repeated for each.
    known = F.broadcast(samples.where("sample_size is not null").select(F.col("sample_size").alias("_size")).distinct())
    shared = samples.where("sample_size is null").crossJoin(known).withColumn("sample_size", F.col("_size")).drop("_size")
    units = samples.where("sample_size is not null").unionByName(shared).select("subset", "rep", "sample_size", "set_name", "draw", key)
    by = ["subset", "rep", "sample_size"]
    numbers = [F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)]
    packed = frame.select(key, F.array(*[F.coalesce(n, F.lit(float("nan"))) for n in numbers]).alias("_x"))

    def from_rows(group, pdf):
        # Rows of one draw (a key that the frame has twice) in the order of their values, so the order of arrival doesn't count.
        x = kernels.masked(np.stack(pdf["_x"].to_list()))
        order = np.lexsort((*x.T[::-1], pdf["draw"].to_numpy()))
        pdf, x = pdf.iloc[order], x[order]
        learn = pdf["set_name"].to_numpy() == "learn"
        return solved(group, x[learn], x[~learn])

    return units.join(packed, key).groupBy(*by).applyInPandas(from_rows, RESULT)
