"""How `experiment.run_grid` fits and looks at samples without ever holding one in a task.

A sample's rows lie in blocks of BLOCK_ROWS draws. A learning sample of one block is fitted as it is. A larger one is fitted in three steps:
each column by itself gives the scaling of every model (quantiles, median and range are those of one column); blocks then give the
Gram matrices of scaled confounds and columns over each model's rows; and from these come the weights of confounds, components and
canonical correlation. The models are small, and go to the blocks of learning and validation rows, which give sums for correlations and loadings.
The folds and shuffles of a sample are made again, from its seed, wherever they are needed: 8 bytes a row of the sample.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from varistrata.functions import kernels
from varistrata.operators import experiment as E
from varistrata.operators.folds import UNIT, _summed
from varistrata.sources.scratch import cut_lineage

#: Draws of a sample in one group.
BLOCK_ROWS = 16_384
PART = [*UNIT, "set_name", "block"]
_KEYS = "subset string, rep int, sample_size int"
_PART = f"{_KEYS}, set_name string, block long"
#: What meets in a group: rows of a block (own), rows that a null model deals to it (dealt), scalings of a column (column), models (state), sums.
_RECORD = f"{_PART}, kind string, model int, a binary, b binary"
#: Below this share of its second moment a variance is one of rounding.
NO_SPREAD = 1e-14


@dataclass(frozen=True)
class Shape:
    """What the columns of a row are."""

    names: tuple[tuple[str, ...], ...]
    n_confounds: int
    quantile: np.ndarray
    numeric: np.ndarray

    @property
    def width(self) -> int:
        return sum(map(len, self.names)) + self.n_confounds

    @property
    def ends(self) -> np.ndarray:
        return np.cumsum([0, *map(len, self.names)])

    def views(self, x: np.ndarray) -> E.Views:
        ends = self.ends
        parts = [x[:, a:b] for a, b in zip(ends, ends[1:], strict=False)]
        flags = [self.quantile[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        return E.Views(parts, [list(n) for n in self.names], x[:, ends[-1] :] if self.n_confounds else None, flags, self.numeric)


def generator(settings: E.Settings, group: Sequence, null_model: bool) -> np.random.Generator:
    return np.random.default_rng([settings.seed, int(group[1]), int(group[2]), int(null_model)])


def drawn(n: int, settings: E.Settings, rng: np.random.Generator, null_model: bool) -> Iterator[tuple[str, np.ndarray, np.ndarray | None]]:
    """Each model of a learning sample: what it is for, its rows, and the order its second view is shuffled to; drawn as `experiment.learned` draws them."""
    order = lambda t: rng.permutation(len(t)) if null_model else None
    everyone = np.arange(n)
    yield "plain", everyone, order(everyone)
    for kind, reps in (("repeated_cv", settings.cv_reps), ("cv", 1)):
        for _ in range(reps if kind in settings.cca_types else 0):
            for train in E.folds(n, settings.n_folds, rng):
                yield kind, train, order(train)


def _rows(buffer, width: int) -> np.ndarray:
    return np.frombuffer(buffer).reshape(-1, width)


def _table(schema: str, **columns):
    """An Arrow table of record columns in the schema's order; what is not named is null."""
    import pyarrow as pa

    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(",")]
    n = max(len(v) for v in columns.values() if isinstance(v, list))
    filled = {k: v if isinstance(v, list) else [v] * n for k, v in columns.items()}
    return pa.table({k: pa.array(filled.get(k, [None] * n), type=kinds[t]) for k, t in fields})


def _own(table, kind: str) -> list[tuple[int | None, object, object]]:
    """(model, a, b) of a group's records of one kind."""
    at = [i for i, k in enumerate(table["kind"].to_pylist()) if k == kind]
    buffer = lambda v: v.as_buffer() if v.is_valid else None
    return [(table["model"][i].as_py(), buffer(table["a"][i]), buffer(table["b"][i])) for i in at]


def _told_numbers(*columns: str):
    """Whole numbers (columns, or arrays of them) as bytes of text: a row is never sent to Python for them alone."""
    return F.concat_ws(",", *[F.col(c).cast("string") if "_all" not in c else F.transform(c, lambda x: x.cast("string")) for c in columns]).cast("binary")


def _numbers(buffer) -> np.ndarray:
    return np.array(bytes(buffer).decode().split(","), dtype=np.int64)


def _plain(group: tuple) -> list:
    return [g.as_py() for g in group]


def packed_blocks(frame: DataFrame, samples: DataFrame, shape: Shape, columns: Sequence[str], key: str) -> DataFrame:
    """PART, n, gaps, a: the rows of each block in the order of their draws (and then values, for a key that the frame has twice) and how many confounds are missing."""
    numbers = [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float("nan"))) for c in columns]
    values = frame.select(F.col(f"`{key}`").alias("_key"), F.array(*numbers).alias("_x"))
    wanted = samples.select(*UNIT, "set_name", "draw", F.col(f"`{key}`").alias("_key"))
    rows = wanted.join(values.hint("merge"), "_key").withColumn("block", F.expr(f"CAST((draw - 1) div {BLOCK_ROWS} AS BIGINT)"))
    width, first = shape.width, shape.width - shape.n_confounds

    def pack(group, table):
        x = kernels.masked(table["_x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width))
        draw = table["draw"].to_numpy()
        x = x[np.argsort(draw, kind="stable") if len(np.unique(draw)) == len(draw) else np.lexsort((*x.T[::-1], draw))]
        return _table(f"{_PART}, n long, gaps long, a binary", **dict(zip(PART, _plain(group), strict=True)), n=[len(x)], gaps=int(np.isnan(x[:, first:]).sum()), a=x.tobytes())

    return cut_lineage(rows.select(*PART, "draw", "_x").groupBy(*PART).applyInArrow(pack, f"{_PART}, n long, gaps long, a binary"))


def placed(blocks: DataFrame) -> DataFrame:
    """PART, first (rows before the block), total and blocks of its sample: a row for each block."""
    sample = Window.partitionBy(*UNIT, "set_name")
    before = sample.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select(*PART, "n").select(*PART, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), F.sum("n").over(sample).alias("total"), F.count("*").over(sample).alias("blocks"))


def _records(df: DataFrame, kind: str, a: str = "a", b: str | None = None, model: str | None = None) -> DataFrame:
    none = lambda t: F.lit(None).cast(t)
    return df.select(*PART, F.lit(kind).alias("kind"), (F.col(model) if model else none("int")).alias("model"), F.col(a).alias("a"), (F.col(b) if b else none("binary")).alias("b"))


def column_scalings(large: DataFrame, shape: Shape, settings: E.Settings, null_model: bool) -> DataFrame:
    """UNIT, model (the column's place), a: whether the column is kept and has gaps, and its scaling in each model. A group holds one column of a sample."""
    frequency = 1 - 1 / settings.n_folds if settings.frequency is None else settings.frequency
    width, first = shape.width, shape.ends[-1]
    flags = np.concatenate([shape.quantile[:first], shape.numeric]).astype(bool)

    def turned(group, table):
        x = _rows(table["a"][0].as_buffer(), width)
        names = dict(zip([*UNIT, "set_name", "block"], [*_plain(group)[:3], "learn", _plain(group)[3]], strict=True))
        return _table(f"{_PART}, model int, a binary", **names, model=list(range(width)), a=[np.ascontiguousarray(x[:, j]).tobytes() for j in range(width)])

    def scaled(group, table):
        *unit, j = _plain(group)
        order = np.argsort(table["block"].to_numpy())
        x = np.concatenate([np.frombuffer(table["a"][int(i)].as_buffer()) for i in order])[:, None]
        kept = j >= first or bool(E.selected(x, settings.missing, frequency)[0])
        models = [E.Scaler().fit(x[train], flags[j : j + 1]) for _, train, _ in drawn(len(x), settings, generator(settings, unit, null_model), null_model)] if kept else []
        told = pickle.dumps((kept, bool(np.isnan(x).any()), [(s.references.get(0), float(s.middle[0]), float(s.spread[0])) for s in models]))
        return _table(f"{_KEYS}, model int, a binary", **dict(zip(UNIT, unit, strict=True)), model=[j], a=told)

    columns = large.select(*UNIT, "block", "a").groupBy(*UNIT, "block").applyInArrow(turned, f"{_PART}, model int, a binary")
    return columns.groupBy(*UNIT, "model").applyInArrow(scaled, f"{_KEYS}, model int, a binary")


class Scalings:
    """The scalings of all columns in each model of a unit, and the basis of its Gram matrices: a constant, confounds, columns with
    missing values as 0, and for each column that lacks some its presence and the confounds where it is there."""

    def __init__(self, shape: Shape, told: list[tuple[int | None, object, object]]):
        by = {j: pickle.loads(bytes(a)) for j, a, _ in told}
        ends, self.shape = shape.ends, shape
        self.keep = [np.array([by[j][0] for j in range(a, b)], dtype=bool) for a, b in zip(ends, ends[1:], strict=False)]
        self.places = [[j for j in range(a, b) if by[j][0]] for a, b in zip(ends, ends[1:], strict=False)]
        own = [j for view in self.places for j in view]
        self.gaps = [k for k, j in enumerate(own) if by[j][1]]
        self.by, self.confounds = by, list(range(ends[-1], shape.width))
        self.n_confounds = len(self.confounds) + int(shape.numeric.sum()) if self.confounds else 0
        self.start = 1 + self.n_confounds
        self.size = self.start + len(own) + len(self.gaps) * self.start

    def _scaler(self, places: Sequence[int], model: int) -> E.Scaler:
        out = E.Scaler()
        told = [self.by[j][2][model] for j in places]
        out.references = {k: t[0] for k, t in enumerate(told) if t[0] is not None}
        out.middle, out.spread = np.array([t[1] for t in told]), np.array([t[2] for t in told])
        return out

    def preprocessor(self, model: int, n_pcs: Sequence[int]) -> E.Preprocessor:
        """Scaling only; what follows it is filled in by `fitted`."""
        out = E.Preprocessor(n_pcs)
        out.imputer = None
        if self.confounds:
            out.imputer = kernels.IterativeImputer()  # no confound is missing here
            out.imputer.means, out.imputer.updates = np.zeros(len(self.confounds)), []
            out.numeric, out.confound_scaler = self.shape.numeric, self._scaler(self.confounds, model)
        out.scalers = [self._scaler(p, model) for p in self.places]
        return out

    def there(self, k: int) -> int:
        return self.start + sum(map(len, self.places)) + self.gaps.index(k) * self.start if k in self.gaps else 0

    def basis(self, p: E.Preprocessor, v: E.Views) -> np.ndarray:
        z = np.concatenate([s.transform(x) for s, x in zip(p.scalers, v.x, strict=True)], axis=1)
        c = p._confounds(v)
        base = np.ones((len(z), 1)) if c is None else np.concatenate([np.ones((len(z), 1)), c], axis=1)
        return np.concatenate([base, np.nan_to_num(z, nan=0.0), *[base * ~np.isnan(z[:, k : k + 1]) for k in self.gaps]], axis=1)

    def cut(self, v: E.Views) -> E.Views:
        return E.cut(v, self.keep)


def fitted(s: Scalings, model: int, gram: np.ndarray, paired: np.ndarray | None, settings: E.Settings) -> tuple[E.Model, list[np.ndarray]]:
    """A model from the Gram matrix of its rows (paired: with the rows dealt to them) and each view's canonical scores as weights of the basis."""
    p, n, c = s.preprocessor(model, settings.n_pcs), gram[0, 0], slice(1, s.start)
    own = sum(map(len, s.places))
    z = slice(s.start, s.start + own)
    w = np.linalg.pinv(gram[c, c], rcond=1e-12, hermitian=True) @ gram[c, z] if s.n_confounds else np.zeros((0, own))
    d = np.zeros((s.size, own))
    d[z] = np.eye(own)
    for k in range(own):
        d[s.there(k) + 1 : s.there(k) + s.start, k] = -w[:, k]
    there = [s.there(k) for k in range(own)]
    present = gram[0, there]
    means = np.where(present > 0, gram[0] @ d / np.where(present > 0, present, 1.0), 0.0)
    d[there, range(own)] -= means
    ends = np.cumsum([0, *map(len, s.places)])
    p.weights, p.pcas, parts = [], [], []
    for a, b, k in zip(ends, ends[1:], settings.n_pcs, strict=False):
        p.weights.append(w[:, a:b] if s.n_confounds else None)
        p.pcas.append(kernels.NanPca.from_moments(means[a:b], d[:, a:b].T @ gram @ d[:, a:b], int(round(n)), k))
        parts.append(d[:, a:b] @ p.pcas[-1].components)
    x, y = parts
    mx, my = gram[0] @ x / n, gram[0] @ y / n
    between = lambda f, g, m: (f.T @ m @ g - np.outer(gram[0] @ f, gram[0] @ g) / n) / max(1, n - 1)
    out = E.Model(settings)
    out.cca = kernels.Cca.from_moments(mx, my, between(x, x, gram), between(y, y, gram), between(x, y, gram if paired is None else paired), min(settings.n_pcs))
    out.parts = [p] if paired is None else [p, p]
    scores = []
    for part, m, weights in zip(parts, (mx, my), out.cca.weights, strict=True):
        scores.append(part @ weights)
        scores[-1][0] -= m @ weights
    return out, scores


def _corr(a: np.ndarray, b: np.ndarray, gram: np.ndarray, cross: np.ndarray | None = None) -> np.ndarray:
    """Correlations of the scores of two views, as weights of a basis, over the rows of its Gram matrix (cross: with those dealt to them)."""
    n = gram[0, 0]
    sums = np.array([[f.T @ gram[0], np.einsum("ij,ij->j", f, gram @ f)] for f in (a, b)])
    return _from_sums(n, sums[0, 0], sums[1, 0], sums[0, 1], sums[1, 1], np.einsum("ij,ij->j", a, (gram if cross is None else cross) @ b))


def _from_sums(n, sx, sy, sxx, syy, sxy) -> np.ndarray:
    with np.errstate(all="ignore"):
        vx, vy = sxx - sx * sx / n, syy - sy * sy / n
        out = (sxy - sx * sy / n) / np.sqrt(vx * vy)
        return np.where((n >= 2) & (vx > NO_SPREAD * sxx) & (vy > NO_SPREAD * syy), np.clip(out, -1, 1), np.nan)


def block_grams(s: Scalings, v: E.Views, models: list[tuple[E.Preprocessor, np.ndarray]], others: dict[int, np.ndarray] | None) -> np.ndarray:
    """What `gram_matrices` sums, of one block; models: each one's scaling and places of its rows in the block. A few rows at a time are scaled, as each model makes a table of them."""
    found = np.zeros((len(models), 3 if others is None else 5, s.size, s.size))
    for low in range(0, len(v.x[0]), E.PIECE):
        piece = v.rows(slice(low, low + E.PIECE))
        for i, (p, inside) in enumerate(models):
            e = s.basis(p, piece)
            begin, end = np.searchsorted(inside, [low, low + E.PIECE])
            own = e[inside[begin:end] - low]
            plain = e if i == 0 else plain
            grams = [own.T @ own, e.T @ e, e.T @ plain]
            if others is not None:
                other = s.basis(p, s.cut(s.shape.views(others[i][begin:end]))) if end > begin else e[:0]
                plain_dealt = other if i == 0 else plain_dealt
                grams += [own.T @ other, e.T @ plain_dealt]
            found[i] += grams
    return found


def gram_matrices(large: DataFrame, places: DataFrame, scalings: DataFrame, dealt: DataFrame | None, shape: Shape, settings: E.Settings, null_model: bool) -> DataFrame:
    """UNIT, model, sums: Gram matrices of the basis over a model's rows, over all learning rows, and between its basis and the plain model's over all (and, of a null model, the first with the rows dealt, and the last with the plain model's dealt rows)."""
    width = shape.width

    def sums(group, table):
        *unit, _, block = _plain(group)
        [(_, a, b)] = _own(table, "own")
        first, total = _numbers(b)
        v = shape.views(_rows(a, width))
        s = Scalings(shape, _own(table, "column"))
        others = _dealt_rows(table, shape)
        v, rows = s.cut(v), len(v.x[0])
        inside = lambda train: train[slice(*np.searchsorted(train, [first, first + rows]))] - first
        models = [(s.preprocessor(i, settings.n_pcs), inside(train)) for i, (_, train, _) in enumerate(drawn(int(total), settings, generator(settings, unit, null_model), null_model))]
        found = block_grams(s, v, models, others if null_model else None)
        return _table(f"{_KEYS}, block long, model int, sums binary", **dict(zip(UNIT, unit, strict=True)), block=block, model=list(range(len(found))), sums=[g.tobytes() for g in found])

    columns = scalings.join(F.broadcast(places.select(*PART)), UNIT)
    records = _records(large, "own", b="place").unionByName(_records(columns, "column", model="model"))
    if dealt is not None:
        records = records.unionByName(dealt)
    parts = records.groupBy(*PART).applyInArrow(sums, f"{_KEYS}, block long, model int, sums binary")
    return _summed(parts, [*UNIT, "model"])


def dealt_rows(large: DataFrame, shape: Shape, settings: E.Settings, places: DataFrame) -> DataFrame:
    """Records of the rows that a null model's shuffle deals to the rows of each block: the second view and the confounds, with their places among the model's rows."""
    width, begin = shape.width, int(shape.ends[1])

    def send(group, table):
        *unit, _, _ = _plain(group)
        first, total = _numbers(table["place"][0].as_buffer())
        starts, numbers = np.split(_numbers(table["starts"][0].as_buffer()), 2)
        x = _rows(table["a"][0].as_buffer(), width)[:, begin:]
        out = []
        for i, (_, train, order) in enumerate(drawn(int(total), settings, generator(settings, unit, True), True)):
            low, high = np.searchsorted(train, [first, first + len(x)])
            at = np.empty(len(order), dtype=np.int64)
            at[order] = np.arange(len(order))  # the row at t of a model's rows is dealt to the one at at[t]
            to = at[low:high]
            blocks = numbers[np.searchsorted(starts, train[to], side="right") - 1]
            for k in np.unique(blocks):
                mine = np.flatnonzero(blocks == k)
                out.append((int(k), i, np.ascontiguousarray(x[train[low:high][mine] - first]).tobytes(), to[mine].tobytes()))
        return _table(_RECORD, **dict(zip(UNIT, unit, strict=True)), set_name="learn", block=[o[0] for o in out], kind="dealt", model=[o[1] for o in out], a=[o[2] for o in out], b=[o[3] for o in out])

    listed = places.groupBy(*UNIT).agg(F.sort_array(F.collect_list(F.struct("first", "block"))).alias("_s")).select(*UNIT, F.col("_s.first").alias("_all_first"), F.col("_s.block").alias("_all_block"))
    starts = F.broadcast(listed.select(*UNIT, _told_numbers("_all_first", "_all_block").alias("starts")))
    return large.join(starts, UNIT).select(*PART, "a", "place", "starts").groupBy(*PART).applyInArrow(send, _RECORD)


def _dealt_rows(table, shape: Shape) -> dict[int, np.ndarray]:
    """By model the rows dealt to a block's, in the order of the rows they are dealt to; their first view is empty."""
    found: dict[int, list] = {}
    for model, a, b in _own(table, "dealt"):
        found.setdefault(model, []).append((np.frombuffer(b, dtype=np.int64), _rows(a, shape.width - int(shape.ends[1]))))
    out = {}
    for model, parts in found.items():
        rows = np.concatenate([r for _, r in parts])[np.argsort(np.concatenate([t for t, _ in parts]))]
        out[model] = np.concatenate([np.zeros((len(rows), int(shape.ends[1]))), rows], axis=1)
    return out


def solved(moments: DataFrame, scalings: DataFrame, shape: Shape, settings: E.Settings, null_model: bool) -> DataFrame:
    """UNIT, told (rows of single folds), state (the models) of each large learning sample."""

    def solve(group, table):
        unit = _plain(group)
        s = Scalings(shape, _own(table, "column"))
        count = 5 if null_model else 3
        grams = {i: np.frombuffer(a).reshape(count, s.size, s.size) for i, a, _ in _own(table, "sums")}
        kinds = ["plain"] + ["repeated_cv"] * (settings.cv_reps * settings.n_folds if "repeated_cv" in settings.cca_types else 0) + ["cv"] * (settings.n_folds if "cv" in settings.cca_types else 0)
        rows, members, fold = [], [], 0
        for i, kind in enumerate(kinds):
            train, everyone, cross, *dealt = grams[i]
            model, scores = fitted(s, i, train, dealt[0] if dealt else None, settings)
            if kind == "plain":
                plain, reference = model, scores
            elif kind == "repeated_cv":
                turns = []
                for v, (f, r) in enumerate(zip(scores, reference, strict=True)):
                    # The reference holds the scores of the rows the plain model saw.
                    turn = kernels.rotation(f.T @ (dealt[1] if dealt and v else cross) @ r, settings.rotation)
                    square = f.T @ everyone @ f
                    turns.append(np.linalg.pinv(square, rcond=1e-12, hermitian=True) @ square @ turn)
                members.append((model, turns))
            else:
                for set_name, corr in (("learn", _corr(*scores, train, dealt[0] if dealt else None)), ("val", _corr(*scores, everyone - train))):
                    rows += [("cv", set_name, "corr", None, None, k + 1, fold, float(c)) for k, c in enumerate(corr)]
                fold += 1
        names = [[n for n, ok in zip(view, keep, strict=True) if ok] for view, keep in zip(shape.names, s.keep, strict=True)]
        return _told(unit, rows, names, E.State(s.keep, plain, members), True)

    null = lambda df: df.select(*UNIT, F.lit("learn").alias("set_name"), F.lit(0).cast("long").alias("block"), "model", "a")
    records = _records(null(moments.withColumnRenamed("sums", "a")), "sums", model="model").unionByName(_records(null(scalings), "column", model="model"))
    return records.groupBy(*UNIT).applyInArrow(solve, _TOLD)


_TOLD = f"{_KEYS}, large boolean, told binary, state binary"


def _told(unit: list, rows: list, names: list, state: E.State, large: bool):
    """A record of a unit's rows, names and number of scores, and of its models without what the blocks don't need."""
    for m in [state.plain, *[m for m, _ in state.members]]:
        m.settings = m.learn_scores = None
    told = pickle.dumps((rows, names, state.plain.cca.weights[0].shape[1]))
    return _table(_TOLD, **dict(zip(UNIT, unit, strict=True)), large=[large], told=told, state=pickle.dumps(state))


def small_samples(learn: DataFrame, shape: Shape, settings: E.Settings, null_model: bool) -> DataFrame:
    """UNIT, told (all rows of the learning sample), state of samples of one block (or, where confounds are missing, of all)."""

    def fit(group, table):
        unit = _plain(group)
        order = np.argsort(table["block"].to_numpy())
        x = np.concatenate([_rows(table["a"][int(i)].as_buffer(), shape.width) for i in order])
        rows, state, names = E.learned(shape.views(x), settings, null_model, [int(unit[1]), int(unit[2]), int(null_model)])
        return _told(unit, rows, names, state, False)

    return learn.select(*UNIT, "block", "a").groupBy(*UNIT).applyInArrow(fit, _TOLD)


def _looked_at(scores: list[np.ndarray], columns: list[np.ndarray]) -> list[np.ndarray]:
    """Sums of which correlations and loadings are made."""
    x, y = scores
    out = [np.array([len(x)], dtype=float), x.sum(axis=0), y.sum(axis=0), (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)]
    for s, d in zip(scores, columns, strict=True):
        m = ~np.isnan(d)
        z, mf = np.nan_to_num(d, nan=0.0), m.astype(float)
        out += [mf.sum(axis=0), z.sum(axis=0), (z * z).sum(axis=0), mf.T @ s, mf.T @ (s * s), z.T @ s]
    return out


def _rows_of(kind: str, set_name: str, sums: list[np.ndarray], names: list[list[str]], normalise: bool) -> list[tuple]:
    n, sx, sy, sxx, syy, sxy = sums[:6]
    rows = [(kind, set_name, "corr", None, None, k + 1, None, float(c)) for k, c in enumerate(_from_sums(n[0], sx, sy, sxx, syy, sxy))]
    for v, own in enumerate(names):
        have, zs, zz, ys, yy, zy = sums[6 + 6 * v : 12 + 6 * v]
        table = kernels.loadings_from_sums(have[:, None], zs[:, None], zz[:, None], ys, yy, zy) if normalise else zy
        rows += [(kind, set_name, "loading", str(v), f, k + 1, None, float(table[j, k])) for j, f in enumerate(own) for k in range(table.shape[1])]
    return rows


def run(frame: DataFrame, datasets: dict[str, list[str]], samples: DataFrame, settings: E.Settings, confounds: Sequence[str], shape: Shape, null_model: bool, key: str) -> DataFrame:
    """RESULT rows of all samples."""
    columns = [c for names in datasets.values() for c in names] + list(confounds)
    blocks = packed_blocks(frame, samples, shape, columns, key)
    places = cut_lineage(placed(blocks))
    whole = bool(blocks.agg(F.coalesce(F.sum("gaps"), F.lit(0))).first()[0])
    same = [F.col(f"b.{c}").eqNullSafe(F.col(f"p.{c}")) for c in PART]
    # One small row for each block of a sample, so this side is broadcast.
    parted = blocks.alias("b").join(F.broadcast(places.alias("p")), same).select(*[f"b.{c}" for c in (*PART, "a")], "blocks", _told_numbers("first", "total").alias("place"))
    learn = parted.where("set_name = 'learn'")
    large = learn.where(F.lit(False) if whole else F.col("blocks") > 1)
    known = places.where("set_name = 'learn'")
    several = known.where("blocks > 1")
    some = not whole and not several.isEmpty()
    fits = small_samples(learn if whole else learn.where("blocks = 1"), shape, settings, null_model)
    dealt = None
    if some:
        scalings = cut_lineage(column_scalings(large, shape, settings, null_model))
        dealt = cut_lineage(dealt_rows(large, shape, settings, several)) if null_model else None
        fits = fits.unionByName(solved(gram_matrices(large, several, scalings, dealt, shape, settings, null_model), scalings, shape, settings, null_model))
    fits = cut_lineage(fits)
    names = list(datasets)
    kinds = [k for k in ("without_cv", "repeated_cv") if k in settings.cca_types]
    width = shape.width

    def seen(table, set_name):
        """(kind, first place, scores, columns) of pieces of a block's rows."""
        [(_, a, place)] = _own(table, "own")
        [(_, told, _)] = _own(table, "state")
        state = pickle.loads(told.to_pybytes())
        first, x = int(_numbers(place)[0]), _rows(a, width)
        others = _dealt_rows(table, shape).get(0) if set_name == "learn" else None
        cut = lambda rows: E.cut(shape.views(rows), state.keep)
        step = E.PIECE if "repeated_cv" in kinds else len(x)
        for low in range(0, len(x), step):
            v = cut(x[low : low + step])
            for kind in kinds:
                scores, own = E.looked(state, kind, v, settings)
                if kind == "without_cv" and others is not None:
                    dealt_to = state.plain.parts[-1].deconfounded(cut(others[low : low + step]), [1])
                    scores = [scores[0], state.plain.scores([own[0], *dealt_to])[1]]
                yield kind, first + low, scores, own

    def sums(group, table):
        unit = _plain(group)
        total: dict[str, list] = {}
        for kind, _, scores, own in seen(table, unit[3]):
            found = _looked_at(scores, own)
            total[kind] = found if kind not in total else [a + b for a, b in zip(total[kind], found, strict=True)]
        flat = np.concatenate([part.ravel() for kind in kinds for part in total[kind]])
        return _table(f"{_PART}, sums binary", **dict(zip(PART, unit, strict=True)), sums=[flat.tobytes()])

    # Validation rows that serve all sizes are looked at by each.
    units = fits.select(*UNIT, "large")
    held = parted.where("set_name = 'val'")
    shared = held.where("sample_size is null").drop("sample_size").join(F.broadcast(units), ["subset", "rep"])
    own = held.unionByName(large).join(F.broadcast(units), UNIT)
    asked = shared.select(*PART, "a", "place").unionByName(own.select(*PART, "a", "place"))
    at = F.broadcast(shared.select(*PART).unionByName(own.select(*PART)))
    records = _records(asked, "own", b="place").unionByName(_records(fits.join(at, UNIT), "state", a="state"))
    if dealt is not None:
        records = records.unionByName(dealt.where("model = 0"))
    fields = [c.strip().split()[0] for c in E.RESULT.split(",")]

    def frame_of(unit, rows):
        import pyarrow as pa

        subset, rep, size = unit
        full = [(subset, null_model, size, rep, *r[:3], names[int(r[3])] if r[3] is not None else None, *r[4:7], r[7] if np.isfinite(r[7]) else None) for r in rows]
        types = {"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
        schema = pa.schema([(f.split()[0], types[f.split()[1]]) for f in E.RESULT.split(",")])
        return pa.Table.from_pylist([dict(zip(fields, r, strict=True)) for r in full], schema=schema)

    def finish(group, table):
        unit = _plain(group)
        [(is_large, told, _)] = _own(table, "told")
        rows, kept, k = pickle.loads(told.to_pybytes())
        by = {table["set_name"][i].as_py(): np.frombuffer(table["a"][i].as_buffer()) for i, kind in enumerate(table["kind"].to_pylist()) if kind == "sums"}
        sizes = [(1,), *[(k,)] * 5, *[s for own in kept for s in [(len(own),)] * 3 + [(len(own), k)] * 3]]
        for set_name in ("learn", "val") if is_large else ("val",):
            flat = by.get(set_name, np.zeros(len(kinds) * sum(int(np.prod(s)) for s in sizes)))
            done = 0
            for kind in kinds:
                parts = []
                for s in sizes:
                    parts.append(flat[done : done + int(np.prod(s))].reshape(s))
                    done += int(np.prod(s))
                rows = rows + _rows_of(kind, set_name, parts, kept, settings.normalise_loadings)
        return frame_of(unit, rows)

    if not kinds:
        return _ended(fits, None).groupBy(*UNIT).applyInArrow(finish, E.RESULT)
    parts = records.groupBy(*PART).applyInArrow(sums, f"{_PART}, sums binary")
    out = _ended(fits, _summed(parts, [*UNIT, "set_name"])).groupBy(*UNIT).applyInArrow(finish, E.RESULT)
    if not settings.scores:
        return out

    def single(group, table):
        unit = _plain(group)
        rows = [(kind, unit[3], "score", str(v), None, c + 1, first + r, float(s[r, c])) for kind, first, scores, _ in seen(table, unit[3]) for v, s in enumerate(scores) for r in range(len(s)) for c in range(s.shape[1])]
        return frame_of(unit[:3], rows)

    return out.unionByName(records.groupBy(*PART).applyInArrow(single, E.RESULT))


def _ended(fits: DataFrame, sums: DataFrame | None) -> DataFrame:
    """Records of what each unit's fit told and (set_name not null) of the sums of its sets."""
    block = F.lit(0).cast("long").alias("block")
    told = fits.select(*UNIT, F.lit(None).cast("string").alias("set_name"), block, F.col("large").cast("int").alias("model"), F.col("told").alias("a"))
    out = _records(told, "told", model="model")
    return out if sums is None else out.unionByName(_records(sums.select(*UNIT, "set_name", block, F.col("sums").alias("a")), "sums"))
