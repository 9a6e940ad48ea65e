"""The grid on fold moments against models fitted on the rows themselves."""

import numpy as np
import pytest

from varistrata.functions import kernels, permutation
from varistrata.operators import folds, sampling
from varistrata.operators.experiment import Settings


def made(n=300, seed=5):
    rng = np.random.default_rng(seed)
    c = np.c_[rng.standard_normal(n), rng.integers(0, 2, n)]
    s = rng.standard_normal((n, 2))
    x, y = (s @ rng.standard_normal((2, k)) + rng.standard_normal((n, k)) + c[:, :1] + 40 for k in (6, 5))
    x[rng.random(x.shape) < 0.05] = np.nan
    x[:, 4] = np.where(rng.random(n) < 0.93, 7.0, x[:, 4])  # one dominant value
    y[rng.random(n) < 0.7, 3] = np.nan  # few values
    c[rng.random(n) < 0.03, 0] = np.nan
    return x, y, c


def frame_of(spark, x, y, c):
    names = {"a": [f"x{i}" for i in range(x.shape[1])], "b": [f"y{i}" for i in range(y.shape[1])]}
    columns = [*names["a"], *names["b"], "c0", "c1"]
    rows = [(f"s{i}", *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(np.c_[x, y, c])]
    return spark.createDataFrame(rows, "eid string, " + ", ".join(f"{k} double" for k in columns)), names


class Rows:
    """One model, fitted on rows; partner: the rows that the second view's scores are taken from."""

    def __init__(self, views, c, at, partner, n_pcs):
        self.own = [self.constants(v[at]) for v in views]
        self.cc = self.constants(c[at])
        conf = self.confounds(c[at])
        z = [self.standard(v[at], k) for v, k in zip(views, self.own, strict=True)]
        self.w = [np.linalg.lstsq(conf, v, rcond=None)[0] for v in z]
        d = [v - conf @ w for v, w in zip(z, self.w, strict=True)]
        self.pca = [kernels.NanPca(k).fit(v) for v, k in zip(d, n_pcs, strict=True)]
        self.partner = np.arange(len(at)) if partner is None else partner
        p = [m.transform(v) for m, v in zip(self.pca, d, strict=True)]
        p[1] = p[1][self.partner]
        self.cca = kernels.Cca(min(n_pcs)).fit(p)
        self.learn_scores = self.cca.transform(p)

    def constants(self, v):
        sd = np.nanstd(v, axis=0)
        return np.nanmean(v, axis=0), np.where(sd > 0, sd, 1.0)

    def standard(self, v, k):
        return np.nan_to_num((v - k[0]) / k[1], nan=0.0)

    def confounds(self, c):
        z = self.standard(c, self.cc)
        return np.c_[z, z[:, :1] ** 2]

    def deconfounded(self, views, c):
        return [self.standard(v, k) - self.confounds(c) @ w for v, k, w in zip(views, self.own, self.w, strict=True)]

    def scores(self, views, c):
        return self.cca.transform([m.transform(d) for m, d in zip(self.pca, self.deconfounded(views, c), strict=True)])


def corr(a, b):
    return float(np.corrcoef(a, b)[0, 1])


def twin(views, names, c, learn, val, settings, key, null_model, block_rows):
    """(cca_type, set_name, metric, dataset, feature, component, pos): value, all from rows."""
    keep = [[j for j in range(v.shape[1]) if np.isnan(v[learn, j]).mean() < settings.missing and np.unique(v[learn, j][~np.isnan(v[learn, j])], return_counts=True)[1].max() / (~np.isnan(v[learn, j])).sum() < 1 - 1 / settings.n_folds] for v in views]
    views = [v[:, k] for v, k in zip(views, keep, strict=True)]
    names = [[names[d][j] for j in k] for d, k in zip("ab", keep, strict=True)]
    n = len(learn)
    out = {}

    def pairs(groups, turn):
        """Blocks are runs of draws; each fold's rows of a block are dealt among themselves."""
        if not null_model:
            return None
        partner = np.arange(n)
        for b in range(0, n, block_rows):
            part = slice(b, min(n, b + block_rows))
            partner[part] = b + folds.dealt(groups[part], *key, turn + 1, b // block_rows)
        return partner

    def at(v, rows):
        return [x[rows] for x in v]

    def tell(kind, set_name, scores, columns):
        for k in range(scores[0].shape[1]):
            out[kind, set_name, "corr", None, None, k + 1, None] = corr(scores[0][:, k], scores[1][:, k])
            for d, s, x, features in zip("ab", scores, columns, names, strict=True):
                for j, f in enumerate(features):
                    out[kind, set_name, "loading", d, f, k + 1, None] = corr(x[:, j], s[:, k])

    whole = pairs(np.zeros(n, int), -1)
    plain = Rows(views, c, learn, whole, settings.n_pcs)
    sets = {"learn": learn, "val": val}
    tell("without_cv", "learn", plain.learn_scores, plain.deconfounded(at(views, learn), c[learn]))
    tell("without_cv", "val", plain.scores(at(views, val), c[val]), plain.deconfounded(at(views, val), c[val]))
    models = []
    for turn in range(settings.cv_reps):
        groups = folds.fold_of(np.arange(n), n, settings.n_folds, *key, turn + 1)
        partner = pairs(groups, turn)
        for f in range(settings.n_folds):
            rest = np.flatnonzero(groups != f)
            place = {r: i for i, r in enumerate(rest)}
            model = Rows(views, c, learn[rest], None if partner is None else np.array([place[p] for p in partner[rest]]), settings.n_pcs)
            models.append(model)
            if turn == 0:
                test = learn[groups == f]
                scores = model.scores(at(views, test), c[test])
                for k in range(scores[0].shape[1]):
                    out["cv", "learn", "corr", None, None, k + 1, f] = corr(model.learn_scores[0][:, k], model.learn_scores[1][:, k])
                    out["cv", "val", "corr", None, None, k + 1, f] = corr(scores[0][:, k], scores[1][:, k])
    turns = [[kernels.rotation(s.T @ r, settings.rotation) for s, r in zip(m.scores(at(views, learn), c[learn]), plain.learn_scores, strict=True)] for m in models]
    for set_name, rows in sets.items():
        scores = [[s @ q for s, q in zip(m.scores(at(views, rows), c[rows]), t, strict=True)] for m, t in zip(models, turns, strict=True)]
        columns = [m.deconfounded(at(views, rows), c[rows]) for m in models]
        tell("repeated_cv", set_name, *[[np.mean([p[v] for p in parts], axis=0) for v in range(2)] for parts in (scores, columns)])
    return out


FIELDS = ["cca_type", "set_name", "metric", "dataset", "feature", "component", "pos"]


@pytest.mark.parametrize("null_model", [False, True])
def test_equals_models_of_the_rows(spark, monkeypatch, null_model):
    """All kinds of results of two sizes and repetitions, for samples of one and of several blocks, and for 1 and 8 partitions."""
    monkeypatch.setattr(folds, "BLOCK_ROWS", 48)
    monkeypatch.setattr(folds, "FAN_IN", 2)
    x, y, c = made()
    frame, names = frame_of(spark, x, y, c)
    design = sampling.keyed_design(frame.select("eid"), [45, 150], 2)
    settings = Settings(n_pcs=(3, 3), cv_reps=2, cca_types=("without_cv", "repeated_cv", "cv"))
    got = {}
    for parts in (1, 8):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        rows = folds.run_linear_grid(frame, names, design, settings, ["c0", "c1"], ["c0"], null_model).collect()
        got[parts] = {(r.rep, r.sample_size, *[r[f] for f in FIELDS]): r.value for r in rows}
        assert len(rows) == len(got[parts])
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    drawn = design.toPandas()
    want = {}
    for rep in range(2):
        for size in (45, 150):
            own = drawn[drawn.rep == rep]
            ids = lambda d: d.sort_values("draw").eid.str[1:].astype(int).to_numpy()
            learn, val = ids(own[(own.set_name == "learn") & (own.sample_size == size)]), ids(own[own.set_name == "val"])
            told = twin([x, y], names, c, learn, val, settings, folds.unit_key(settings, "all", rep, size), null_model, 48)
            want |= {(rep, size, *k): v for k, v in told.items()}
    for parts in (1, 8):
        assert set(got[parts]) == set(want)
        assert max(abs(got[parts][k] - want[k]) for k in want) < 1e-6
    assert {k[6] for k in want if k[5] == "a"} == {"x0", "x1", "x2", "x3", "x5"} and "y3" not in {k[6] for k in want}


def test_odd_samples(spark):
    """A subject the frame lacks is left out; a size without validation rows has learning rows only; null and repeated keys don't matter."""
    x, y, c = made(120)
    frame, names = frame_of(spark, x, y, c)
    settings = Settings(n_pcs=(2, 2), cv_reps=1)
    base = [("all", 0, 60, "learn", i + 1, f"s{i}") for i in range(60)]
    schema = "subset string, rep int, sample_size int, set_name string, draw int, eid string"
    run = lambda rows: sorted([tuple(r) for r in folds.run_linear_grid(frame, names, spark.createDataFrame(rows, schema), settings).collect()], key=str)
    plain = run(base)
    assert {r[5] for r in plain} == {"learn"}
    assert [r[:-1] for r in run([*base, ("all", 0, 60, "val", 1, "not there"), ("all", 0, 60, "val", 2, None)])] == [r[:-1] for r in plain]
    assert run(base[:0]) == []
    for bad in (Settings(ensemble="nanmedian"), Settings(scores=True), Settings(frequency=0.4), Settings(model_transform=lambda s: s)):
        with pytest.raises(ValueError):
            folds.run_linear_grid(frame, names, spark.createDataFrame(base, schema), bad)


def test_majorities_and_deals():
    x = np.array([[1, 1, np.nan], [1, 2, np.nan], [1, np.nan, np.nan], [3, 2, np.nan]], float)
    assert np.array_equal(folds.majorities(x), [1, 2, np.nan], equal_nan=True)
    groups = np.array([0, 1] * 20 + [2])
    other = folds.dealt(groups, 1, 2)
    assert sorted(other) == list(range(41)) and (groups[other] == groups).all() and (other != np.arange(41)).sum() == 40


def test_keyed_permutations():
    for n in (1, 2, 3, 7, 64, 65, 1000):
        assert sorted(permutation.permuted(np.arange(n), n, 5, n)) == list(range(n))
    n, turns = 16, 3000
    seen = np.zeros((n, n))
    for k in range(turns):
        seen[np.arange(n), permutation.permuted(np.arange(n), n, 11, k)] += 1
    chi = ((seen - turns / n) ** 2 / (turns / n)).sum()
    assert 150 < chi < 320  # 225 degrees of freedom
    pairs = np.zeros((n, n))  # two places under one key don't depend on each other
    for k in range(turns):
        a, b = permutation.permuted(np.array([0, 1]), n, 13, k)
        pairs[a, b] += 1
    off = pairs[~np.eye(n, dtype=bool)]
    assert np.trace(pairs) == 0 and 160 < ((off - turns / 240) ** 2 / (turns / 240)).sum() < 330
    with pytest.raises(ValueError):
        permutation.permuted(np.array([3]), 3, 1)


def test_keyed_design(spark):
    people = spark.createDataFrame([(i,) for i in range(97)], "eid long")
    d = sampling.keyed_design(people, [10, 48], 3).toPandas()
    for rep in range(3):
        own = d[d.rep == rep]
        learn, val = own[own.set_name == "learn"], own[own.set_name == "val"]
        assert sorted(val.draw) == list(range(1, 50)) and val.sample_size.isna().all() and len(set(val.eid)) == 49
        assert not set(learn.eid) & set(val.eid)
        for size in (10, 48):
            s = learn[learn.sample_size == size]
            assert sorted(s.draw) == list(range(1, size + 1)) and len(set(s.eid)) == size
    assert len({tuple(d[(d.rep == r) & (d.sample_size == 10)].sort_values("draw").eid) for r in range(3)}) == 3
    m = sampling.keyed_design(people, [20, 40], 2, replace=True, match_validation=True, n_in=50).toPandas()
    assert (m.groupby(["rep", "set_name", "sample_size"]).size() == [20, 40] * 4).all() and m[m.sample_size == 40].groupby(["rep", "set_name"]).eid.nunique().max() < 40
    plan = sampling.keyed_design(people, [10], 50)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    with pytest.raises(ValueError):
        sampling.keyed_design(people, [98], 1)


def test_samples_are_not_broadcast(spark):
    """Draws of many repetitions are few bytes once compressed and many in memory: their joins are by shuffles, whatever adaptive execution measures."""
    x, y, c = made(120)
    df, names = frame_of(spark, x, y, c)
    design = sampling.keyed_design(df.select("eid"), [20, 60], 4)
    rows = folds.sampled_rows(df, folds.basis_of(df, names, ["c0", "c1"]), design, "eid")
    for found, n in ((design, 4 * (20 + 60 + 60)), (rows, 4 * (20 + 60 + 60))):
        assert len(found.collect()) == n
        plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert "SortMergeJoin [_index" in plan or "_index" not in plan
        assert not [line for line in plan.splitlines() if "BroadcastHashJoin" in line and ("[_index" in line or "[_key" in line)], plan


def test_blocks_name_their_candidates_once(spark):
    """The counts of dominant values ask twice for what the blocks named: it is kept, so samples aren't dealt and grouped again."""
    full = spark.createDataFrame([(i, float(i % 3 == 0), float(i)) for i in range(200)], "eid long, a double, b double")
    basis = folds.basis_of(full, {"a": ["a"], "b": ["b"]})
    found = folds.mode_counts(folds.sampled_rows(full, basis, sampling.keyed_design(full.select("eid"), [60], 2), "eid"), basis)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan, plan
    assert {r["place"] for r in found.collect()} == {0}
