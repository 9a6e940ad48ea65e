"""Transformers that are fitted on one DataFrame and applied to any: scalings, encodings, deconfounding, components, and chains of them.

Every one has `fit(df, columns, confounds)`, `transform(df)`, `columns_out` (what became of the columns), `get_params` and
`set_params`. Fitting takes a fixed number of passes over the rows and leaves small arrays; transforming is an
expression on each row, so a fitted chain is one projection.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varistrata.functions import kernels
from varistrata.operators import columns as C
from varistrata.operators import linear


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


@dataclass
class Estimator:
    """Parameters are the fields of the class; what fitting finds is kept beside them."""

    def get_params(self) -> dict:
        return {f.name: getattr(self, f.name) for f in fields(self) if f.init}

    def set_params(self, **params):
        known = self.get_params()
        for name, value in params.items():
            if name not in known:
                raise ValueError(f"{type(self).__name__} has no parameter {name}")
            setattr(self, name, value)
        return self

    def fit(self, df: DataFrame, columns: Sequence[str], confounds: Sequence[str] = ()) -> Estimator:
        self.columns = self.columns_out = list(columns)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df

    def fit_transform(self, df: DataFrame, columns: Sequence[str], confounds: Sequence[str] = ()) -> DataFrame:
        return self.fit(df, columns, confounds).transform(df)


@dataclass
class Affine(Estimator):
    """(x - centre) / scale with constants found by `_constants`; a scale of 0 or none counts as 1."""

    def _constants(self, df: DataFrame) -> dict[str, tuple[float, float]]:
        raise NotImplementedError

    def fit(self, df, columns, confounds=()):
        super().fit(df, columns, confounds)
        self.constants = self._constants(df)
        return self

    def transform(self, df):
        return df.withColumns({c: (_q(c) - F.lit(float(m))) / F.lit(float(s or 1.0)) for c, (m, s) in self.constants.items()})


@dataclass
class Standardise(Affine):
    """To mean 0 and deviation 1; ddof as for a sample (1) or a population (0)."""

    ddof: int = 0

    def _constants(self, df):
        sd = F.stddev_samp if self.ddof else F.stddev_pop
        row = df.agg(*[f(_q(c).cast("double")).alias(f"{n}{i}") for i, c in enumerate(self.columns) for n, f in (("m", F.avg), ("s", sd))]).first()
        return {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(self.columns) if row[f"m{i}"] is not None}


@dataclass
class RobustScale(Affine):
    """To median 0 and interquartile range 1."""

    def _constants(self, df):
        found = C.exact_quantiles(C.wide_to_long(df, [], self.columns), ["column"], "value", [0.25, 0.5, 0.75])
        return {r["column"]: (r["q1"], r["q2"] - r["q0"]) for r in found.collect()}


@dataclass
class QuantileNormal(Estimator):
    """Normal scores by quantiles, of the columns whose value type says so (all without value types)."""

    value_type: dict[str, int] | None = None
    most: int = 1000

    def fit(self, df, columns, confounds=()):
        super().fit(df, columns, confounds)
        chosen = list(columns) if self.value_type is None else C.filtered_quantile_columns(columns, self.value_type)
        self.references = C.fit_quantiles(df, chosen, self.most) if chosen else {}
        return self

    def transform(self, df):
        return C.quantile_transform(df, self.references)


@dataclass
class Square(Estimator):
    """Squares of the numeric columns (by value type; all without) after the columns themselves."""

    value_type: dict[str, int] | None = None

    def fit(self, df, columns, confounds=()):
        super().fit(df, columns, confounds)
        self.squared = list(columns) if self.value_type is None else C.filtered_quantile_columns(columns, self.value_type)
        self.columns_out = [*columns, *[f"{c}_squared" for c in self.squared]]
        return self

    def transform(self, df):
        return C.square_columns(df, self.squared)


@dataclass
class MeanImpute(Estimator):
    """Missing values become the column's mean."""

    def fit(self, df, columns, confounds=()):
        super().fit(df, columns, confounds)
        row = df.agg(*[F.avg(_q(c).cast("double")).alias(f"c{i}") for i, c in enumerate(columns)]).first()
        self.means = {c: row[f"c{i}"] for i, c in enumerate(columns)}
        return self

    def transform(self, df):
        return df.withColumns({c: F.coalesce(_q(c).cast("double"), F.lit(m)) for c, m in self.means.items()})


@dataclass
class RegressionImpute(Estimator):
    """Missing values by Bayesian regressions of each column on all others, round after round."""

    rounds: int = 100
    tolerance: float = 1e-3

    def fit(self, df, columns, confounds=()):
        super().fit(df, columns, confounds)
        self.model = linear.fit_imputation(df, columns, self.rounds, self.tolerance)
        return self

    def transform(self, df):
        return linear.impute(df, self.model)


@dataclass
class SelectColumns(Estimator):
    """Drops columns with too many missing values, then those with a dominant one; `dropped` tells which and why."""

    missing: float = 0.5
    mode: float = 0.8

    def fit(self, df, columns, confounds=()):
        super().fit(df, columns, confounds)
        found = C.find_bad_columns(df, list(columns), missing=self.missing, mode=self.mode)
        self.columns_out, self.dropped = found.kept, found.dropped
        return self

    def transform(self, df):
        return df.drop(*[c for c in self.columns if c not in set(self.columns_out)])


@dataclass
class Deconfound(Estimator):
    """Columns less what the confounds explain (no intercept); without confounds they stay."""

    def fit(self, df, columns, confounds=()):
        super().fit(df, columns, confounds)
        self.confounds = list(confounds)
        self.weights = linear.deconfound_weights(df, columns, confounds) if confounds else None
        return self

    def transform(self, df):
        return df if self.weights is None else linear.remove_confounds(df, self.columns, self.confounds, self.weights)


@dataclass
class Components(Estimator):
    """Principal components instead of the columns; missing values don't count."""

    n_components: int | float | None = None
    prefix: str = "PC"

    def fit(self, df, columns, confounds=()):
        super().fit(df, columns, confounds)
        self.model = linear.fit_pca(df, columns, self.n_components)
        self.columns_out = [f"{self.prefix}{k + 1}" for k in range(self.model.components.shape[1])]
        return self

    def transform(self, df):
        return linear.pca_scores(df, self.columns, self.model, self.prefix).drop(*self.columns)


@dataclass
class Chain(Estimator):
    """Named steps one after the other; each is fitted on what the ones before give. Parameters of a step are `step__parameter`."""

    steps: list[tuple[str, Estimator]] = field(default_factory=list)

    def get_params(self):
        return {"steps": self.steps} | {f"{name}__{p}": v for name, step in self.steps for p, v in step.get_params().items()}

    def set_params(self, **params):
        known = dict(self.steps)
        for name, value in params.items():
            step, _, rest = name.partition("__")
            if name == "steps":
                self.steps = value
            elif step in known and rest:
                known[step].set_params(**{rest: value})
            else:
                raise ValueError(f"there is no parameter {name}")
        return self

    def fit(self, df, columns, confounds=()):
        super().fit(df, columns, confounds)
        for i, (_, step) in enumerate(self.steps):
            step.fit(df, self.columns_out, confounds)
            self.columns_out = step.columns_out
            if i + 1 < len(self.steps):
                df = step.transform(df)
        return self

    def transform(self, df):
        for _, step in self.steps:
            df = step.transform(df)
        return df


@dataclass
class Views(Estimator):
    """The confounds through one chain, then each named dataset through its own, deconfounded by them.

    Parameters are `dataset__step__parameter` (the confounds' chain is `confounds`). Datasets named in `shuffled` have
    their rows, with those of their confounds, dealt to other keys by a hash, as a null model needs.
    """

    chains: dict[str, Chain] = field(default_factory=dict)
    confounds: Chain | None = None
    shuffled: tuple[str, ...] = ()
    seed: int = 3791
    key: str = "eid"

    def set_params(self, **params):
        for name, value in params.items():
            view, _, rest = name.partition("__")
            if rest and (view in self.chains or (view == "confounds" and self.confounds is not None)):
                (self.confounds if view == "confounds" else self.chains[view]).set_params(**{rest: value})
            else:
                super().set_params(**{name: value})
        return self

    def fit(self, df: DataFrame, datasets: dict[str, Sequence[str]], confounds: Sequence[str] = ()) -> Views:
        if set(datasets) != set(self.chains):
            raise ValueError(f"there are chains for {sorted(self.chains)}, not for {sorted(datasets)}")
        self.datasets = {n: list(c) for n, c in datasets.items()}
        self.confound_columns = list(confounds)
        if self.confounds is not None and confounds:
            df = self.confounds.fit_transform(df, confounds)
            self.confound_columns = self.confounds.columns_out
        for name, chain in self.chains.items():
            chain.fit(df, self.datasets[name], self.confound_columns)
        return self

    def transform(self, df: DataFrame) -> dict[str, DataFrame]:
        """For each dataset the key and its columns."""
        if self.confounds is not None and self.confound_columns:
            df = self.confounds.transform(df)
        out = {}
        for name, chain in self.chains.items():
            own = chain.transform(df.select(self.key, *[_q(c) for c in (*self.datasets[name], *self.confound_columns)])).select(self.key, *[_q(c) for c in chain.columns_out])
            out[name] = self._dealt(own, name) if name in self.shuffled else own
        return out

    def _dealt(self, own: DataFrame, name: str) -> DataFrame:
        """The rows under the keys in the order of a hash."""
        from varistrata.operators.sampling import ordered_places

        places = ordered_places(own.select(self.key), self.key, f"keys{self.seed}")
        rows = ordered_places(own, self.key, f"{name}{self.seed}")
        return places.select("pos", self.key).join(rows.drop(self.key), "pos").drop("pos")


def data_chain(n_components: int, value_type: dict[str, int] | None = None) -> Chain:
    return Chain([("quantile", QuantileNormal(value_type)), ("scale", RobustScale()), ("deconfound", Deconfound()), ("components", Components(n_components))])


def confound_chain(value_type: dict[str, int] | None = None) -> Chain:
    return Chain([("impute", RegressionImpute()), ("quantile", QuantileNormal(value_type)), ("scale", RobustScale()), ("square", Square(value_type))])


def fit_views_cca(views: Views, df: DataFrame, datasets: dict[str, Sequence[str]], confounds: Sequence[str] = (), n_components: int | None = None) -> kernels.Cca:
    """Canonical correlation of two datasets after their chains; as many components as the smaller view has, or n_components."""
    if len(datasets) != 2:
        raise ValueError("two datasets are needed")
    parts = views.fit(df, datasets, confounds).transform(df)
    names = {n: [f"{n}__{c}" for c in views.chains[n].columns_out] for n in datasets}
    (a, left), (b, right) = ((n, parts[n].select(views.key, *[_q(c).alias(m) for c, m in zip(views.chains[n].columns_out, names[n], strict=True)])) for n in datasets)
    return linear.fit_cca(left.join(right, views.key), names[a], names[b], n_components or min(len(names[a]), len(names[b])))
