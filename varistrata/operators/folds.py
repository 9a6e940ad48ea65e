"""The experiment grid on fold moments: no task or group ever holds the rows of a sample.

Values are standardised by the mean and deviation of the rows a model is fitted on, missing ones become 0 after that, and
confounds (with the squares of the numeric ones) are regressed out; then come components and canonical correlation.
All of this is linear in a row's basis: a constant, the values around rough means with missing ones as 0, which values are
there (of columns that lack some), and the squares of numeric confounds. So a model is a matrix of weights of the
basis, and everything asked of it (correlations, loadings, rotations, ensembles of models) follows from Gram matrices of the
basis. These are summed in blocks of BLOCK_ROWS rows of a sample, fold by fold; the rows a fold's model is fitted on are
the whole less the fold, so all folds of all repetitions take one pass. The Gram matrices of a sample, whose size
does not depend on its rows, are solved together: (repetitions x folds + 2) x basis x basis numbers.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varistrata.functions import kernels, permutation
from varistrata.operators.experiment import RESULT, Settings
from varistrata.sources.scratch import cut_lineage

#: Rows of a sample in one group, and sums of blocks that are added up in one step.
BLOCK_ROWS, FAN_IN = 16_384, 64
#: Most frequent values of (sample, column) that are broadcast for their count (about 40 bytes each); more are joined by a shuffle.
BROADCAST_CANDIDATES = 100_000
UNIT = ["subset", "rep", "sample_size"]


@dataclass(frozen=True)
class Basis:
    """Columns of the views and confounds, in this order, and what their basis is."""

    views: tuple[tuple[str, ...], ...]
    confounds: tuple[str, ...]
    shift: np.ndarray
    #: Columns with missing values; confounds that are squared (both as places among all columns).
    gaps: tuple[int, ...]
    squared: tuple[int, ...]

    @property
    def columns(self) -> list[str]:
        return [c for view in self.views for c in view] + list(self.confounds)

    @property
    def size(self) -> int:
        return 1 + len(self.columns) + len(self.gaps) + len(self.squared)

    def there(self, j: int) -> int:
        """The place of the column's presence in the basis; of one without gaps that of the constant."""
        return 1 + len(self.columns) + self.gaps.index(j) if j in self.gaps else 0

    def rows(self, x: np.ndarray) -> np.ndarray:
        have = np.isfinite(x)
        if not have[:, [j for j in range(x.shape[1]) if j not in self.gaps]].all():
            raise ValueError("a value is missing in a column that has none")
        z = np.where(have, x - self.shift, 0.0)
        return np.column_stack([np.ones(len(x)), z, have[:, self.gaps].astype(float), z[:, self.squared] ** 2])

    def span(self, view: int) -> range:
        start = sum(len(v) for v in self.views[:view])
        return range(start, start + len(self.views[view]))


@dataclass
class Sums:
    """Gram matrix of the basis over some rows; paired: products of each row with the one dealt to it (of a null model)."""

    gram: np.ndarray
    paired: np.ndarray | None = None

    @classmethod
    def less(cls, parts: Sequence[Sums], i: int) -> Sums:
        """All parts together less one of them."""
        rest = lambda name: sum(getattr(p, name) for p in parts) - getattr(parts[i], name)
        return cls(rest("gram"), None if parts[0].paired is None else rest("paired"))

    @property
    def n(self) -> float:
        return self.gram[0, 0]

    def between(self, a: np.ndarray, b: np.ndarray, paired: bool = False) -> np.ndarray:
        """Sums of the products of two matrices of weights, less their means. The dealt rows are the same rows, so the means stay."""
        g = self.paired if paired and self.paired is not None else self.gram
        return a.T @ g @ b - np.outer(a.T @ self.gram[0], b.T @ self.gram[0]) / self.n

    def correlation(self, a: np.ndarray, b: np.ndarray, paired: bool = False) -> np.ndarray:
        """Each column of a with each of b; NaN without spread."""
        va, vb = (np.einsum("ij,ij->j", w, self.gram @ w) - (w.T @ self.gram[0]) ** 2 / self.n for w in (a, b))
        with np.errstate(all="ignore"):
            out = self.between(a, b, paired) / np.sqrt(np.outer(va, vb))
        return np.where(np.isfinite(out), np.clip(out, -1, 1), np.nan)


class Fitted:
    """A model as weights of the basis: `deconfounded` columns and canonical `scores` of each view."""

    def __init__(self, basis: Basis, fit: Sums, kept: Sequence[Sequence[int]], n_pcs: Sequence[int]):
        n, own = fit.n, [j for view in kept for j in view]
        z, c = self._standard(basis, fit, own), None
        if basis.confounds:
            places = list(range(len(basis.columns) - len(basis.confounds), len(basis.columns)))
            c = np.concatenate([self._standard(basis, fit, places), self._squares(basis, fit)], axis=1)
            z = z - c @ (np.linalg.pinv(c.T @ fit.gram @ c) @ (c.T @ fit.gram @ z))
        ends = np.cumsum([0, *map(len, kept)])
        self.deconfounded = [z[:, a:b] for a, b in zip(ends, ends[1:], strict=False)]
        parts = []
        for d, k in zip(self.deconfounded, n_pcs, strict=True):
            centred = d.copy()
            centred[0] -= d.T @ fit.gram[0] / n
            pca = kernels.NanPca.from_moments(np.zeros(d.shape[1]), centred.T @ fit.gram @ centred, int(round(n)), k)
            parts.append(centred @ pca.components)
        x, y = parts
        s = [fit.between(a, b, a is not b) / max(1, n - 1) for a, b in ((x, x), (y, y), (x, y))]
        cca = kernels.Cca.from_moments(np.zeros(x.shape[1]), np.zeros(y.shape[1]), *s, min(n_pcs))
        self.scores = [p @ w for p, w in zip(parts, cca.weights, strict=True)]

    @staticmethod
    def _constants(basis: Basis, fit: Sums, j: int) -> tuple[float, float]:
        n = fit.gram[0, basis.there(j)]
        mean = fit.gram[0, 1 + j] / n if n else 0.0
        spread = np.sqrt(max(fit.gram[1 + j, 1 + j] / n - mean * mean, 0.0)) if n else 0.0
        return mean, spread if spread > 1e-12 * (abs(mean) + 1e-300) else 1.0

    def _standard(self, basis: Basis, fit: Sums, places: Sequence[int]) -> np.ndarray:
        out = np.zeros((basis.size, len(places)))
        for k, j in enumerate(places):
            mean, spread = self._constants(basis, fit, j)
            out[1 + j, k] = 1 / spread
            out[basis.there(j), k] -= mean / spread
        return out

    def _squares(self, basis: Basis, fit: Sums) -> np.ndarray:
        """((x - mean) / spread) ** 2 of the numeric confounds; 0 where they are missing."""
        out = np.zeros((basis.size, len(basis.squared)))
        for k, j in enumerate(basis.squared):
            mean, spread = self._constants(basis, fit, j)
            out[basis.size - len(basis.squared) + k, k] = 1 / spread**2
            out[1 + j, k] -= 2 * mean / spread**2
            out[basis.there(j), k] += (mean / spread) ** 2
        return out


def fold_of(place: np.ndarray, n: int, n_folds: int, *key: int) -> np.ndarray:
    """The fold of each of n places: a keyed permutation cut into parts that differ by one row at most."""
    return permutation.permuted(place, n, *key) * n_folds // n


def dealt(folds: np.ndarray, *key: int) -> np.ndarray:
    """Another row of the same fold for each row (itself, if it is alone): a cycle in random order."""
    rng = np.random.default_rng([int(k) & permutation.MASK for k in key])
    out = np.arange(len(folds))
    for fold in np.unique(folds):
        cycle = rng.permutation(np.flatnonzero(folds == fold))
        out[cycle] = np.roll(cycle, -1)
    return out


def unit_key(settings: Settings, subset: str, rep: int, size: int) -> tuple[int, ...]:
    return settings.seed, zlib.crc32(str(subset).encode()), int(rep), int(size)


def _packed(e: np.ndarray, groups: np.ndarray, n_groups: int, partner: np.ndarray | None) -> bytes:
    out = []
    for g in range(n_groups):
        own = groups == g
        out.append(e[own].T @ e[own])
        if partner is not None:
            out.append(e[own].T @ e[partner[own]])
    return np.array(out).tobytes()


def _unpacked(value: bytes, size: int, null_model: bool) -> list[Sums]:
    parts = np.frombuffer(value).reshape(-1, size, size)
    return [Sums(parts[i], parts[i + 1]) for i in range(0, len(parts), 2)] if null_model else [Sums(p) for p in parts]


def majorities(x: np.ndarray) -> np.ndarray:
    """For each column the value of more than half of its present rows; NaN if there is none."""
    out = np.full(x.shape[1], np.nan)
    for j in range(x.shape[1]):
        have = x[np.isfinite(x[:, j]), j]
        if len(have):
            middle = np.partition(have, len(have) // 2)[len(have) // 2]  # a majority value is the median
            out[j] = middle if 2 * (have == middle).sum() > len(have) else np.nan
    return out


def _adder(cells: list[str]):
    """A group function that adds the packed sums of records and keeps the cells of the first."""

    def add(pdf):
        import pandas as pd

        total = np.frombuffer(pdf["sums"].iloc[0]).copy()
        for value in pdf["sums"].iloc[1:]:
            total += np.frombuffer(value)
        return pd.DataFrame(pdf[cells].iloc[:1].assign(sums=[total.tobytes()]))

    return add


def _summed(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Records of equal keys added up, FAN_IN blocks at a time first, so a group grows with the rows of a sample by their part in FAN_IN x BLOCK_ROWS only."""
    schema = ", ".join(f"{k} {parts.schema[k].dataType.simpleString()}" for k in keys)
    few = parts.withColumn("block", F.expr(f"block div {FAN_IN}")).groupBy(*keys, "block").applyInPandas(_adder([*keys, "block"]), f"{schema}, block long, sums binary")
    return few.groupBy(*keys).applyInPandas(_adder(keys), f"{schema}, sums binary")


def basis_of(frame: DataFrame, datasets: dict[str, list[str]], confounds: Sequence[str] = (), numeric: Sequence[str] | None = None) -> Basis:
    """Rough means and gaps of all columns, in one pass. numeric: the confounds that are squared (None: all)."""
    columns = [c for names in datasets.values() for c in names] + list(confounds)
    good = lambda c: F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double"))
    row = frame.agg(F.count("*"), *[f(good(c)) for c in columns for f in (F.avg, F.count)]).first()
    squared = set(confounds if numeric is None else numeric)
    first = len(columns) - len(confounds)
    return Basis(
        tuple(map(tuple, datasets.values())), tuple(confounds), np.array([row[1 + 2 * j] or 0.0 for j in range(len(columns))]),
        tuple(j for j in range(len(columns)) if row[2 + 2 * j] < row[0]), tuple(first + k for k, c in enumerate(confounds) if c in squared),
    )


def sampled_rows(frame: DataFrame, basis: Basis, samples: DataFrame, key: str) -> DataFrame:
    """The samples with the values `_x` of their subjects (NaN if missing) and the block they fall in; subjects the frame lacks are left out, a key that it has twice gives both rows."""
    numbers = [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float("nan"))) for c in basis.columns]
    packed = frame.select(F.col(f"`{key}`").alias("_key"), F.array(*numbers).alias("_x"))
    wanted = samples.select(*UNIT, "set_name", "draw", F.col(f"`{key}`").alias("_key"))
    # Samples of many repetitions are small once compressed but large in memory, so neither side may be broadcast.
    return wanted.join(packed.hint("merge"), "_key").withColumn("block", F.expr(f"CAST((draw - 1) div {BLOCK_ROWS} AS BIGINT)"))


def fold_moments(rows: DataFrame, basis: Basis, settings: Settings, null_model: bool) -> DataFrame:
    """subset, rep, sample_size, set_name, turn, sums: packed Gram matrices over all rows (turn -1) and over each fold of the repetitions (turn 0, 1, ...).

    Folds are cut from the places of the draws, by a permutation of their own for each repetition.
    """
    import pandas as pd

    reps, n_folds = settings.cv_reps, settings.n_folds
    sizes = rows.where("set_name = 'learn'").groupBy(*UNIT).agg(F.max("draw").cast("long").alias("_n")).withColumn("set_name", F.lit("learn"))
    # Sizes are as many as samples; the join's other side has many rows of each, which adaptive execution splits.
    counted = rows.alias("r").join(sizes.alias("n"), [F.col(f"r.{c}").eqNullSafe(F.col(f"n.{c}")) for c in (*UNIT, "set_name")], "left").select("r.*", "_n")

    def sums(group, pdf):
        subset, rep, size, set_name, block = group
        pdf = pdf.sort_values("draw", kind="stable")
        e = basis.rows(kernels.masked(np.stack(pdf["_x"].to_list())))
        place = pdf["draw"].to_numpy(np.int64) - 1
        learn = set_name == "learn"
        out = []
        for turn in range(-1, reps if learn else 0):
            key = (*unit_key(settings, subset, rep, size if learn else 0), turn + 1)
            groups = np.zeros(len(e), dtype=int) if turn < 0 else fold_of(place, int(pdf["_n"].iloc[0]), n_folds, *key)
            partner = dealt(groups, *key, int(block)) if null_model and learn else np.arange(len(e)) if null_model else None
            out.append((turn, _packed(e, groups, 1 if turn < 0 else n_folds, partner)))
        return pd.DataFrame({"subset": subset, "rep": rep, "sample_size": size, "set_name": set_name, "block": block, "turn": [t for t, _ in out], "sums": [s for _, s in out]}).astype({"sample_size": "Int32"})

    parts = counted.groupBy(*UNIT, "set_name", "block").applyInPandas(sums, "subset string, rep int, sample_size int, set_name string, block long, turn int, sums binary")
    return _summed(parts, [*UNIT, "set_name", "turn"])


def mode_counts(rows: DataFrame, basis: Basis) -> DataFrame:
    """subset, rep, sample_size, place, n: the count of the most frequent value of each column of each learning sample, where it is of more than half of the present rows.

    A value of more than half of a sample is of more than half of one of its blocks. So blocks name their majority values, and those few are counted in a
    second pass; a sample whose blocks name none takes no second pass.
    """
    import pandas as pd

    learn = rows.where("set_name = 'learn'")
    p = sum(map(len, basis.views))

    def named(group, pdf):
        top = majorities(kernels.masked(np.stack(pdf["_x"].to_list()))[:, :p])
        at = np.flatnonzero(np.isfinite(top))
        return pd.DataFrame({"subset": group[0], "rep": group[1], "sample_size": group[2], "place": at.astype("int32"), "candidate": top[at]})

    found = learn.groupBy(*UNIT, "block").applyInPandas(named, "subset string, rep int, sample_size int, place int, candidate double").distinct()
    # A few numbers for each sample, kept: both their count and the second pass ask for them, and each would deal the samples again.
    listed = cut_lineage(found.groupBy(*UNIT).agg(F.collect_set(F.struct("place", "candidate")).alias("_wanted")))
    known = listed.agg(F.coalesce(F.sum(F.size("_wanted")), F.lit(0))).first()[0]
    side = F.broadcast(listed) if known <= BROADCAST_CANDIDATES else listed
    asked = learn.join(side, UNIT).select(*UNIT, "_x", F.explode("_wanted").alias("_c"))
    counts = asked.groupBy(*UNIT, F.col("_c.place").alias("place"), F.col("_c.candidate").alias("candidate")).agg(F.count_if(F.col("_x")[F.col("_c.place")] == F.col("_c.candidate")).alias("n"))
    return counts.groupBy(*UNIT, "place").agg(F.max("n").alias("n"))


def selected_columns(frame: DataFrame, datasets: dict[str, list[str]], samples: DataFrame, settings: Settings, key: str = "eid") -> DataFrame:
    """subset, rep, sample_size, dataset, feature, rows, present, most, kept: which columns each learning sample keeps, for all samples together.

    present: rows with a value; most: how many have the most frequent one, where that is over half of them (else 0). Kept are columns with few
    missing values and no dominant one (Settings.missing, Settings.frequency), as the learning rows alone tell.
    """
    frequency = 1 - 1 / settings.n_folds if settings.frequency is None else settings.frequency
    if frequency < 0.5:
        raise ValueError("a frequency of a half at least is needed")
    basis = basis_of(frame, datasets)
    learn = sampled_rows(frame, basis, samples, key).where("set_name = 'learn'")
    there = [F.count_if(~F.isnan(F.col("_x")[j])).alias(f"p{j}") for j in range(len(basis.columns))]
    counts = learn.groupBy(*UNIT).agg(F.count("*").alias("rows"), *there)
    names = [(d, c) for d, columns in datasets.items() for c in columns]
    cells = F.array(*[F.struct(F.lit(d).alias("dataset"), F.lit(c).alias("feature"), F.lit(j).alias("place"), F.col(f"p{j}").alias("present")) for j, (d, c) in enumerate(names)])
    told = counts.select(*UNIT, "rows", F.inline(cells)).join(mode_counts(learn, basis), [*UNIT, "place"], "left")
    n, present, most = F.col("rows"), F.col("present"), F.coalesce(F.col("n"), F.lit(0))
    dominant = F.when(2 * most > present, most).otherwise(0)
    kept = (present > 0) & (1 - present / n < settings.missing) & (F.try_divide(dominant, present) < frequency)
    return told.select(*UNIT, "dataset", "feature", "rows", "present", dominant.alias("most"), F.coalesce(kept, F.lit(False)).alias("kept"))


def kept_columns(basis: Basis, gram: np.ndarray, modes: dict[int, int], settings: Settings) -> list[list[int]]:
    """The columns of each view with few missing values and no dominant one, from a learning sample's counts."""
    frequency = 1 - 1 / settings.n_folds if settings.frequency is None else settings.frequency
    n = gram[0, 0]
    keep = lambda j: gram[0, basis.there(j)] > 0 and 1 - gram[0, basis.there(j)] / n < settings.missing and modes.get(j, 0) / gram[0, basis.there(j)] < frequency
    return [[j for j in basis.span(v) if keep(j)] for v in range(len(basis.views))]


def _told(kind: str, set_name: str, own: Sums, shuffled: bool, scores: list[np.ndarray], columns: list[np.ndarray], names: list[list[str]], normalise: bool) -> list[tuple]:
    """Correlations and loadings as rows; shuffled: the second view's scores are those of the dealt rows."""
    corr = np.diag(own.correlation(scores[0], scores[1], shuffled))
    rows = [(kind, set_name, "corr", None, None, k + 1, None, float(c)) for k, c in enumerate(corr)]
    for v, (d, s) in enumerate(zip(columns, scores, strict=True)):
        moved = shuffled and v > 0
        if normalise:
            table = own.correlation(d, s, moved)
        else:
            table = d.T @ (own.paired if moved else own.gram) @ s
        rows += [(kind, set_name, "loading", v, names[v][j], k + 1, None, float(table[j, k])) for j in range(table.shape[0]) for k in range(table.shape[1])]
    return rows


def solved(basis: Basis, settings: Settings, null_model: bool, learn: Sums, val: Sums | None, turns: list[list[Sums]], kept: list[list[int]]) -> list[tuple]:
    """Result rows of one sample from its Gram matrices."""
    columns = basis.columns
    names = [[columns[j] for j in view] for view in kept]
    fit = lambda s: Fitted(basis, s, kept, settings.n_pcs)
    plain = fit(learn)
    sets = {"learn": learn} | ({"val": val} if val is not None else {})
    rows = []
    if "without_cv" in settings.cca_types:
        for set_name, own in sets.items():
            rows += _told("without_cv", set_name, own, null_model and set_name == "learn", plain.scores, plain.deconfounded, names, settings.normalise_loadings)
    if "repeated_cv" in settings.cca_types:
        models = [fit(Sums.less(folds, i)) for folds in turns for i in range(len(folds))]
        turned = []
        for m in models:
            # The reference holds the scores of the rows the plain model saw, so of the dealt ones for the second view of a null model.
            cross = [s.T @ (learn.paired if null_model and v > 0 else learn.gram) @ r for v, (s, r) in enumerate(zip(m.scores, plain.scores, strict=True))]
            turned.append([s @ kernels.rotation(c, settings.rotation) for s, c in zip(m.scores, cross, strict=True)])
        scores = [np.mean([t[v] for t in turned], axis=0) for v in range(2)]
        deconfounded = [np.mean([m.deconfounded[v] for m in models], axis=0) for v in range(2)]
        for set_name, own in sets.items():
            rows += _told("repeated_cv", set_name, own, False, scores, deconfounded, names, settings.normalise_loadings)
    if "cv" in settings.cca_types:
        for i, fold in enumerate(turns[0]):
            rest = Sums.less(turns[0], i)
            model = fit(rest)
            for set_name, own, shuffled in (("learn", rest, null_model), ("val", fold, False)):
                corr = np.diag(own.correlation(model.scores[0], model.scores[1], shuffled))
                rows += [("cv", set_name, "corr", None, None, k + 1, i, float(c)) for k, c in enumerate(corr)]
    return [(*r[:-1], r[-1] if np.isfinite(r[-1]) else None) for r in rows]


def run_linear_grid(frame: DataFrame, datasets: dict[str, list[str]], samples: DataFrame, settings: Settings, confounds: Sequence[str] = (), numeric: Sequence[str] | None = None, null_model: bool = False, key: str = "eid") -> DataFrame:
    """RESULT rows of all samples (as sampling.design gives them): correlations and loadings, with standardised columns.

    Columns are chosen on each learning sample (Settings.missing, Settings.frequency). Ensembles are means, so other
    methods, a model_transform, the scores of single subjects, and a frequency under a half are errors: run_grid has them.
    The null model deals the second view's rows, with their confounds, to other rows of the same fold and block,
    anew for each repetition; ensembles are looked at on rows as they are. Subjects the frame lacks are left out;
    validation rows of all sizes are summed once.
    """
    import pandas as pd

    if len(datasets) != 2 or len(settings.n_pcs) != 2:
        raise ValueError("two datasets with a number of components each are needed")
    frequency = 1 - 1 / settings.n_folds if settings.frequency is None else settings.frequency
    if settings.ensemble not in ("mean", "nanmean") or settings.model_transform is not None or settings.scores or frequency < 0.5:
        raise ValueError("the grid on moments has means of models only, no scores of subjects, and a frequency of a half at least")
    basis = basis_of(frame, datasets, confounds, numeric)
    rows = sampled_rows(frame, basis, samples, key)
    moments = fold_moments(rows, basis, settings, null_model)
    units = samples.where("set_name = 'learn'").select(*UNIT).distinct()
    held = moments.where("set_name = 'val'")
    shared = units.join(held.where("sample_size is null").drop("sample_size"), ["subset", "rep"]).select(*UNIT, "set_name", "turn", "sums")
    records = moments.where("set_name = 'learn'").unionByName(held.where("sample_size is not null")).unionByName(shared)
    modes = mode_counts(rows, basis).groupBy(*UNIT).agg(F.collect_list(F.struct("place", "n")).alias("modes"))
    fields = [c.strip().split()[0] for c in RESULT.split(",")]
    names, size = list(datasets), basis.size

    def solve(group, pdf, counted):
        by = {(r.set_name, r.turn): _unpacked(r.sums, size, null_model) for r in pdf.itertuples()}
        learn = by["learn", -1][0]
        told = {int(c["place"]): int(c["n"]) for c in counted["modes"].iloc[0]} if len(counted) else {}
        val = by["val", -1][0] if ("val", -1) in by else None
        out = solved(basis, settings, null_model, learn, val, [by["learn", t] for t in range(settings.cv_reps)], kept_columns(basis, learn.gram, told, settings))
        subset, rep, n = group
        full = [(subset, null_model, n, rep, *r[:3], None if r[3] is None else names[r[3]], *r[4:]) for r in out]
        return pd.DataFrame(full, columns=fields).astype({"pos": "Int64"})

    return records.groupBy(*UNIT).cogroup(modes.groupBy(*UNIT)).applyInPandas(solve, RESULT)
