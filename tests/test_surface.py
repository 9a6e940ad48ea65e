"""Files, keyed results, estimators and samples: errors and odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from varistrata.functions import kernels, normal
from varistrata.operators import catalog, cohort, columns, estimators, experiment, linear, results, sampling, stages
from varistrata.sources import scratch, tables


def test_saved_objects(tmp_path):
    rng = np.random.default_rng(1)
    model = kernels.Cca(2).fit([rng.standard_normal((50, 3)), rng.standard_normal((50, 2))])
    tables.save_object(f"{tmp_path}/m.json", model)
    again = tables.load_object(f"{tmp_path}/m.json", kernels.Cca)
    assert np.allclose(again.weights[0], model.weights[0]) and np.allclose(again.correlations, model.correlations)
    with pytest.raises(TypeError):
        tables.load_object(f"{tmp_path}/m.json", kernels.NanPca)
    (tmp_path / "bad.json").write_text("no")
    for name in ("bad.json", "none.json"):
        with pytest.raises(RuntimeError):
            tables.load_object(f"{tmp_path}/{name}", kernels.Cca)


def test_paths_and_names(monkeypatch):
    monkeypatch.setenv("STUDY_RESULTS", "/r")
    p = tables.Paths.from_environment()
    assert p.of("results") == "/r" and p.of("data") == "./data"
    with pytest.raises(ValueError):
        p.of("else")
    assert tables.sample_path("all", 3, [5, 9], replace=True) == "samples-all-3reps-2sizes_5-9-replace.parquet"


def test_folder_that_is_not_shared():
    class Context:
        master = "yarn"

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="share"):
        scratch.scratch_folder(Session())


def test_nested(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 1, 4.0), ("b", None, 1.0)], "k string, n int, value double")
    n = results.Nested(df, ("k", "n"))
    assert n.get("a", 1) == [2.0, 4.0] and n.get("b", None) == [1.0]
    assert n.put(("a", 1), 9.0).get("a", 1) == [9.0] and sorted(n.append(("a", 1), 9.0).get("a", 1)) == [2.0, 4.0, 9.0]
    assert n.under("a").frame.columns == ["n", "value"] and n.under().frame.count() == 3
    for key in (("a",), ("a", 1, 2)):
        with pytest.raises(KeyError):
            n.get(*key)
    with pytest.raises(KeyError):
        n.get("z", 1)
    lists = spark.createDataFrame([([1.0, None, 3.0],), ([],), (None,), ([None],)], "x array<double>").select(results.list_mean("x"), results.list_std("x")).collect()
    assert [tuple(r) for r in lists] == [(2.0, 1.0), (None, None), (None, None), (None, None)]
    assert results.told({"a": 1, "bcd": "x"}) == "a    1\nbcd  x" and "n_folds" in results.told(experiment.Settings())
    c = spark.createDataFrame([(1, 0.5), (2, 0.25)], "component int, corr double")
    assert sorted(r[1] for r in results.multiply_correlations(c, [2, -1]).collect()) == [-0.25, 1.0]
    with pytest.raises(ValueError):
        results.multiply_correlations(c, [1.0])
    e = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 3.0)], "k string, value double")
    assert {r.k: r.value for r in results.ensemble_scores(e, ["k"], method="mean").collect()} == {"a": None, "b": 3.0}
    with pytest.raises(ValueError):
        results.ensemble_scores(e, ["k"], method="odd")


def test_bootstrap_of_small_and_repeated_groups(spark):
    rows = [("same", i % 2 * 1.0) for i in range(100)] + [("one", 5.0), ("none", None)] + [("wide", float(i)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: (r.low, r.high) for r in results.bootstrap_intervals(df, ["k"], "v", draws=400).collect()}
    assert set(got) == {"same", "one", "wide"} and got["one"] == (5.0, 5.0)
    assert got["same"][0] == pytest.approx(0.4, abs=0.06) and got["same"][1] == pytest.approx(0.6, abs=0.06)
    x = np.arange(400.0)
    low, high = kernels.bootstrap_interval(x)
    assert got["wide"][0] == pytest.approx(low, abs=4) and got["wide"][1] == pytest.approx(high, abs=4)
    assert results.poisson_thresholds()[:2] == [f"{round(np.exp(-1) * 65536):04x}", f"{round(2 * np.exp(-1) * 65536):04x}"]


def test_closure_of_a_deep_chain(spark):
    tree = spark.createDataFrame([(i, i + 1) for i in range(45)], "parent_id int, child_id int").coalesce(1)
    assert catalog.category_closure(tree, [0]).count() == 46


def test_catalogue_errors(spark):
    wide = spark.createDataFrame([(1, 2.0)], "eid long, `100-2.0` double")
    empty = spark.createDataFrame([], "category_id long, field_id int")
    with pytest.raises(ValueError, match="unknown domain"):
        catalog.select_domain("odd", wide, "/nowhere", None, None, empty)
    fields = spark.createDataFrame([(1, "a", 11, 5)], "field_id int, title string, value_type int, main_category int")
    with pytest.raises(KeyError):
        catalog.field_info(fields, [2])
    with pytest.raises(KeyError):
        catalog.category_title(spark.createDataFrame([(1, "x")], "category_id int, title string"), 2)
    merged = fields.withColumns({"udi": F.lit("1-0.0"), "title_category": F.lit("c")})
    with pytest.raises(KeyError):
        catalog.udis_of_category(merged, [5], udis=spark.createDataFrame([("9-0.0",)], "udi string"))
    with pytest.raises(ValueError):
        cohort.join_extracts([fields, fields], "field_id")


def test_outliers_of_ranks_are_of_the_same_values_in_every_pass(spark, monkeypatch):
    """Means and deviations of scores are not worked out again for each pass: their last bits would depend on how rows are dealt."""
    seen, real = [], columns.exact_quantiles
    monkeypatch.setattr(columns, "exact_quantiles", lambda long, *rest: (seen.append(long), real(long, *rest))[1])
    df = spark.range(0, 30000, 1, 8).select((F.hash("id") % 997).cast("double").alias("x"), ((F.hash("id") % 50) / 7).alias("y"))
    columns.outlier_ratio(df, ["x", "y"], "ranks").collect()
    shuffles = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    try:
        for parts in ("1", "3", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            found.append({(r.column, r.value) for r in seen[0].select("column", "value").distinct().collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
    assert found[0] == found[1] == found[2]


def test_outliers_and_quantiles(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.standard_normal(500), 1)
    x[3] = np.nan
    df = spark.createDataFrame([(float(a) if a == a else None, 1.0) for a in x], "x double, flat double")
    y = x[~np.isnan(x)]
    want = {None: y, "standard": y, "ranks": kernels.inverse_normal(y)}
    z = (y - y.mean()) / y.std()
    want["quantiles"] = kernels.quantile_normal(z, kernels.quantile_references(z))
    for prepare, v in want.items():
        got = {r.column: r.outlier for r in columns.outlier_ratio(df, ["x", "flat"], prepare).collect()}
        d = (v - np.median(v)) ** 2
        assert got["x"] == pytest.approx(d.max() / d.mean()) and got["flat"] is None
    with pytest.raises(ValueError):
        columns.outlier_ratio(df, ["x"], "odd")
    found = columns.exact_quantiles(columns.wide_to_long(df, [], ["x"]), ["column"], "value", [0.0, 0.1, 0.975, 1.0]).first()
    assert [found[f"q{i}"] for i in range(4)] == pytest.approx(np.quantile(y, [0.0, 0.1, 0.975, 1.0]).tolist())
    assert columns.exact_quantiles(columns.wide_to_long(df.limit(0), [], ["x"]), ["column"], "value", [0.5]).count() == 0
    assert columns.outlier_ratio(df.limit(0), ["x"]).first().outlier is None


def test_normal_quantile():
    from statistics import NormalDist

    p = np.r_[np.random.default_rng(1).random(500), 10.0 ** -np.arange(1, 300, 7), 1 - 10.0 ** -np.arange(1, 15)]
    assert np.allclose(normal.quantile(p), [NormalDist().inv_cdf(x) for x in p], rtol=1e-14, atol=1e-15)
    assert normal.quantile(np.array([0, 1])).tolist() == [-np.inf, np.inf] and np.isnan(normal.quantile(np.array([np.nan, -1, 2]))).all()


def test_nearest_definite_matrix():
    for seed in range(40):
        rng = np.random.default_rng(seed)
        a = rng.standard_normal((6, 6)) * 10.0 ** rng.integers(-6, 7)
        s = (a + a.T) / 2
        b = kernels.nearest_spd(a)
        np.linalg.cholesky(b)
        values, vectors = np.linalg.eigh(s)
        positive = (vectors * np.maximum(values, 0)) @ vectors.T
        assert np.abs(b - positive).max() <= 1e-12 * np.abs(s).max()
        rank = rng.standard_normal((6, 2))
        np.linalg.cholesky(kernels.nearest_spd(rank @ rank.T))
        whole = rank @ rank.T + np.eye(6)
        assert np.array_equal(kernels.nearest_spd(whole), (whole + whole.T) / 2)


def test_moments_are_exact_far_from_zero(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 3)) @ rng.standard_normal((3, 3)) + [1e7, -3e6, 0]
    x[rng.random(x.shape) < 0.2] = np.nan
    df = spark.createDataFrame([tuple(None if v != v else float(v) for v in r) for r in x], "a double, b double, c double").repartition(7)
    m = linear.moments(df, ["a", "b", "c"], centre=True)
    z = np.nan_to_num(x - np.nanmean(x, axis=0), nan=0.0)
    assert m.n == 3000 and np.allclose(m.means, np.nanmean(x, axis=0), rtol=1e-12) and np.allclose(m.centred(), z.T @ z, rtol=1e-7)
    for i in range(3):
        for j in range(3):
            assert m.correlation(i, j) == pytest.approx(kernels.pairwise_corr(x[:, i], x[:, j]), abs=1e-9)
    got = {(r.feature, r.component): r.loading for r in linear.loadings(df, ["a", "b"], ["c"]).collect()}
    assert got["a", 1] == pytest.approx(kernels.pairwise_corr(x[:, 0], x[:, 2]), abs=1e-9)
    none = linear.moments(df.limit(0), ["a", "b"], centre=True)
    assert none.n == 0 and not none.products.any() and none.correlation(0, 1) is None


def test_chains(spark):
    rng = np.random.default_rng(5)
    c = rng.standard_normal((300, 1))
    x = rng.standard_normal((300, 4)) + c
    df = spark.createDataFrame([(i, *map(float, r), float(k[0])) for i, (r, k) in enumerate(zip(x, c, strict=True))], "eid long, a double, b double, d double, e double, c double")
    chain = estimators.data_chain(2)
    out = chain.set_params(components__prefix="Z", components__n_components=3).fit_transform(df, ["a", "b", "d", "e"], ["c"])
    assert chain.columns_out == ["Z1", "Z2", "Z3"] and chain.get_params()["components__n_components"] == 3
    got = out.orderBy("eid").select("Z1", "Z2", "Z3").toPandas().to_numpy()
    scaled = experiment.Scaler().fit(x, np.ones(4, bool)).transform(x)
    w = kernels.deconfound_weights(c, scaled)
    want = kernels.NanPca(3).fit(kernels.deconfound(c, scaled, w)).transform(kernels.deconfound(c, scaled, w))
    assert np.allclose(got, want, atol=1e-8)
    for bad in ({"odd": 1}, {"scale__odd": 1}, {"none__x": 1}):
        with pytest.raises(ValueError):
            chain.set_params(**bad)
    views = estimators.Views({"x": estimators.data_chain(2), "y": estimators.data_chain(1)}, estimators.confound_chain({"c": 31}))
    with pytest.raises(ValueError):
        views.fit(df, {"x": ["a"], "z": ["b"]}, ["c"])
    model = estimators.fit_views_cca(views.set_params(x__components__n_components=1), df, {"x": ["a", "b"], "y": ["d", "e"]}, ["c"])
    assert len(model.correlations) == 1 and views.confound_columns == ["c", "c_squared"]
    moved = estimators.Views({"x": estimators.Chain([])}, shuffled=("x",)).fit(df, {"x": ["a"]}).transform(df)["x"].orderBy("eid").toPandas()
    assert sorted(moved.a) == pytest.approx(sorted(x[:, 0])) and (moved.a.to_numpy() != x[:, 0]).mean() > 0.9


def test_confounds_by_value_type():
    rng = np.random.default_rng(7)
    c = np.c_[rng.standard_normal(80), rng.integers(0, 3, 80)].astype(float)
    v = experiment.Views([rng.standard_normal((80, 3))], [["a", "b", "d"]], c, [np.zeros(3, bool)], np.array([True, False]))
    p = experiment.Preprocessor([2]).fit(v)
    made = p._confounds(v)
    assert made.shape == (80, 3) and np.allclose(made[:, 2], made[:, 0] ** 2)


def test_cross_validation_and_model_transform():
    rng = np.random.default_rng(8)
    s = rng.standard_normal((60, 1))
    x, y = rng.standard_normal((60, 3)) + s, rng.standard_normal((60, 3)) + s
    v = experiment.Views([x, y], [list("abc"), list("def")], None, [np.zeros(3, bool)] * 2)
    rows = experiment.unit(v, v, experiment.Settings(n_pcs=(2, 2), cca_types=("cv",), missing=0.9, frequency=1.0), False, [1])
    assert {r[0] for r in rows} == {"cv"} and {r[6] for r in rows} == set(range(5)) and len(rows) == 5 * 2 * 2
    settings = dict(n_pcs=(2, 2), cv_reps=1, cca_types=("repeated_cv",), frequency=1.0)
    plain = experiment.unit(v, v, experiment.Settings(**settings), False, [1])
    changed = experiment.unit(v, v, experiment.Settings(**settings, model_transform=lambda scores: [2 * a for a in scores]), False, [1])
    corr = lambda rows: [r[-1] for r in rows if r[2] == "corr"]
    assert corr(plain) == pytest.approx(corr(changed))
    doubled = kernels.ensemble([[x], [x]], None, rotate=False, model_transform=lambda scores: [2 * a for a in scores])
    assert np.allclose(doubled[0], 2 * x)


@pytest.mark.parametrize("replace", [False, True])
def test_stratified_draws(spark, replace):
    people = spark.createDataFrame([(i, "ab"[i % 3 > 0] if i % 10 else None) for i in range(300)], "eid long, g string")
    out = sampling.design(people, [20, 60], 2, strata="g", replace=replace, match_validation=True).join(people, "eid").toPandas()
    for (_, size, _), own in out.groupby(["rep", "sample_size", "set_name"]):
        assert sorted(own.draw) == list(range(1, size + 1))
        shares = own.g.fillna("none").value_counts(normalize=True)
        assert shares["none"] == pytest.approx(0.1, abs=1.01 / size) and shares["a"] == pytest.approx(0.3, abs=1.01 / size)
    learn, val = (set(zip(o.rep, o.eid, strict=True)) for _, o in out.groupby("set_name"))
    assert not learn & val


def test_draws_do_not_depend_on_the_cut(spark):
    people = spark.range(4000).withColumnRenamed("id", "eid")
    a, b = (sorted(map(tuple, sampling.design(people, [30, 200], 2, cut=c).where("set_name = 'learn'").collect())) for c in (True, False))
    assert a == b and len(a) == 460


def test_encoded_files(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"{i}.csv").write_text(f'eid,1-2.0,2-0.0\n,1-2.0_a,2-0.0\n{i},"x, ""y""",\n{i + 10},,3\n')
    got, pairs = tables.load_encoded(spark, str(tmp_path))
    assert pairs == [("1-2.0", "1-2.0_a"), ("2-0.0", "2-0.0")]
    assert sorted(map(tuple, got.collect())) == [(0, 'x, "y"', None), (1, 'x, "y"', None), (10, None, "3"), (11, None, "3")]


def scattered(n, p, seed):
    """Correlated columns with gaps everywhere, so nearly every row misses another set of columns."""
    rng = np.random.default_rng(seed)
    full = rng.standard_normal((n, 3)) @ rng.standard_normal((3, p)) + 0.3 * rng.standard_normal((n, p)) + 100 * np.arange(p)
    x = full.copy()
    x[rng.random(x.shape) < 0.3] = np.nan
    return full, x


def as_frame(spark, x):
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "eid long, " + ", ".join(f"v{i} double" for i in range(x.shape[1])))


def values_of(df, p):
    return df.orderBy("eid").toPandas()[[f"v{i}" for i in range(p)]].to_numpy()


def test_imputation_with_many_sets_of_missing_columns(spark, monkeypatch):
    """20 columns and more sets than the driver takes: the rows are passed over, and all values equal those of one block of all rows."""
    full, x = scattered(5000, 20, 3)
    df = as_frame(spark, x).repartition(6).cache()
    assert len({tuple(r) for r in np.isnan(x)}) > linear.MOST_PATTERNS
    own = linear.moments(df, [f"v{i}" for i in range(20)], centre=True)
    assert linear._pattern_products(df.drop("eid"), own.means) is None
    want = kernels.IterativeImputer(rounds=1)
    filled = want.fit_transform(x)
    got = values_of(linear.iterative_impute(df, [f"v{i}" for i in range(20)], "eid", rounds=1), 20)
    assert np.abs(got - filled).max() < 1e-6 and (got == np.where(np.isnan(x), got, x)).all()
    assert np.abs(got - full)[np.isnan(x)].mean() < 0.6 * np.abs(np.nanmean(x, axis=0) - full)[np.isnan(x)].mean()


def test_both_ways_of_imputing_agree(spark, monkeypatch):
    full, x = scattered(300, 4, 4)
    df = as_frame(spark, x).repartition(3)
    names = [f"v{i}" for i in range(4)]
    want = kernels.IterativeImputer().fit_transform(x)
    sets = values_of(linear.iterative_impute(df, names, "eid"), 4)
    monkeypatch.setattr(linear, "MOST_PATTERNS", 3)
    passes = values_of(linear.iterative_impute(df, names, "eid"), 4)
    assert np.abs(sets - want).max() < 1e-7 and np.abs(passes - want).max() < 1e-7


def test_confounds_are_imputed_by_regression(spark):
    """Other rows go through the updates of the rows the chain was fitted on; a column without gaps in the fit has a model too."""
    full, x = scattered(200, 3, 5)
    x[:100, 0] = full[:100, 0]
    first, second = as_frame(spark, x[:100]), as_frame(spark, x[100:])
    names = ["v0", "v1", "v2"]
    chain = estimators.confound_chain()
    assert [n for n, _ in chain.steps] == ["impute", "quantile", "scale", "square"] and isinstance(dict(chain.steps)["impute"], estimators.RegressionImpute)
    step = estimators.RegressionImpute().fit(first, names)
    kernel = kernels.IterativeImputer()
    kernel.fit_transform(x[:100])
    assert np.abs(values_of(step.transform(second), 3) - kernel.transform(x[100:])).max() < 1e-7
    out = chain.fit(first, names).transform(second)
    assert out.where(" or ".join(f"{c} is null" for c in chain.columns_out)).count() == 0
    none = first.limit(0)
    assert step.transform(none).count() == 0 and linear.fit_imputation(none, names).updates == []
    whole = as_frame(spark, full[:50])
    assert np.array_equal(values_of(linear.iterative_impute(whole, names, "eid"), 3), full[:50])


def test_exact_quantiles_by_windows(spark):
    """Ties, gaps, NULL keys, tiny and large groups: the quantiles are those of numpy."""
    rng = np.random.default_rng(6)
    groups = {"normal": rng.standard_normal(30_000), "ties": rng.integers(0, 5, 20_000).astype(float), "one": np.array([3.5]), "two": np.array([1.0, 2.0]), None: rng.exponential(size=777), "flat": np.full(5000, 7.0), "far": np.r_[np.full(9000, 1.0), 1e300, -1e300]}
    steps = [0, 0.025, 0.25, 0.5, 0.75, 0.999, 1]
    rows = [(k, float(v)) for k, x in groups.items() for v in x] + [("normal", None), ("gone", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    got = {r["k"]: [r[f"q{i}"] for i in range(len(steps))] for r in columns.exact_quantiles(df, ["k"], "v", steps).collect()}
    assert set(got) == set(groups)
    for k, x in groups.items():
        assert np.allclose(got[k], np.quantile(x, steps), rtol=1e-12), k
    all_of = columns.exact_quantiles(df.where("k = 'normal'"), [], "v", [0.5]).collect()
    assert len(all_of) == 1 and all_of[0].q0 == pytest.approx(np.median(groups["normal"]), abs=1e-12)
    assert columns.exact_quantiles(df.limit(0), ["k"], "v", [0.5]).collect() == []


def test_masks_without_keys_and_thresholds_with_null_keys(spark):
    means = spark.createDataFrame([("a", 0.5), ("b", 0.2), ("c", 0.0)], "feature string, value double")
    null = spark.createDataFrame([("a", -0.1, 0.1), ("b", -0.3, 0.3)], "feature string, low double, high double")
    got = results.significance_mask(means, null)
    assert got.columns == ["feature", "value", "low", "high", "masked"]
    assert {r.feature: (round(r.low, 9), r.masked) for r in got.collect()} == {"a": (-0.1, False), "b": (-0.3, True), "c": (-0.2, True)}
    sizes = spark.createDataFrame([(None, 10, 1.0), (None, 20, 3.0), ("x", 10, 5.0)], "k string, sample_size int, r_val double")
    assert {r.k: r.threshold for r in results.null_threshold(sizes, ["k"], q=0.5).collect()} == {None: 3.0, "x": 5.0}


def test_rows_are_counted_by_the_job_that_writes_them(spark, tmp_path):
    df = spark.range(1000).withColumnRenamed("id", "eid").withColumn("x", F.col("eid") * 2)
    tracker, group = spark.sparkContext.statusTracker(), "write-subset"
    spark.sparkContext.setJobGroup(group, "")
    told = tables.write_subset(df, f"{tmp_path}/a/b.parquet", ["x"], lambda d: d.where("x >= 10"))
    jobs = len(tracker.getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("other", "")
    assert told == (995, 1) and jobs == 1
    assert tables.write_subset(df.limit(0), f"{tmp_path}/none.parquet", ["x"]) == (0, 1)


def test_several_views_from_moments(spark):
    rng = np.random.default_rng(12)
    s = rng.standard_normal((200, 2))
    x = np.c_[s @ rng.standard_normal((2, 8)) + rng.standard_normal((200, 8))]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "eid long, " + ", ".join(f"v{i} double" for i in range(8))).repartition(4)
    views = {"p": ["v0", "v1", "v2"], "q": ["v3", "v4"], "r": ["v5", "v6", "v7"]}
    model = linear.fit_mcca(df, list(views.values()))
    want = kernels.MultiCca().fit([x[:, :3], x[:, 3:5], x[:, 5:]])
    assert np.allclose(model.values, want.values)
    scored = linear.mcca_scores(df, views, model)
    names = {v: [f"{v}1", f"{v}2"] for v in views}
    got = {r.component: r.score for r in linear.mean_pair_correlation(scored, names).collect()}
    assert np.allclose([got[1], got[2]], kernels.component_scores(want.transform([x[:, :3], x[:, 3:5], x[:, 5:]])))
    tensor = {(r.view_a, r.view_b, r.component): r.corr for r in linear.correlation_tensor(scored, names).collect()}
    assert len(tensor) == 18 and tensor["p", "q", 1] == tensor["q", "p", 1] and tensor["r", "r", 2] == pytest.approx(1)
    flat = linear.mean_pair_correlation(df.withColumn("z", F.lit(1.0)), {"a": ["v0"], "b": ["z"]}).collect()
    assert [r.score for r in flat] == [None]
    with pytest.raises(ValueError):
        linear.correlation_tensor(df, {"a": ["v0"], "b": ["v1", "v2"]})


def test_functions_of_python_under_keys(spark):
    """Numpy where it works, pandas where it doesn't; lists of arrays; NULL keys; what is missing stays so."""
    df = spark.createDataFrame([("a", 1, 3.0, 2), ("a", 1, 1.0, 1), ("a", 1, 7.0, 3), (None, 2, 5.0, 1), ("b", 1, None, 1)], "k string, n int, v double, o int").repartition(3)
    held = results.Nested(df, ("k", "n"), "v")
    got = held.apply_any({"first": lambda v: v[0], "median": lambda v: v.median(), "sum": np.nansum, "none": lambda v: None}, order=["o"])
    assert got.levels == ("k", "n", "func")
    assert {(r.k, r.func): r.v for r in got.frame.collect()} == {("a", "first"): 1.0, ("a", "median"): 3.0, ("a", "sum"): 11.0, ("a", "none"): None, (None, "first"): 5.0, (None, "median"): 5.0, (None, "sum"): 5.0, (None, "none"): None, ("b", "first"): None, ("b", "median"): None, ("b", "sum"): 0.0, ("b", "none"): None}
    vectors = results.Nested(spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, 6.0]), ("b", [0.0, 1.0])], "k string, v array<double>"), ("k",), "v")
    means = vectors.apply_any({"mean": lambda m: m.mean(axis=0)}, kind="array<double>")
    assert {r.k: r.v for r in means.frame.collect()} == {"a": [2.0, 4.0], "b": [0.0, 1.0]}
    with pytest.raises(Exception, match="no such"):
        held.apply_any({"bad": lambda v: (_ for _ in ()).throw(ValueError("no such"))}).frame.collect()


def test_places_without_one_task_for_all(spark):
    rng = np.random.default_rng(15)
    values = [None if v < 0.02 else round(float(v), 2) for v in rng.random(3000)]
    df = spark.createDataFrame([(i, v, "place") for i, v in enumerate(values)], "i long, v double, kind string").repartition(6)
    got = columns.numbered(df, [F.desc_nulls_last("v"), F.col("i")], "at").collect()
    want = sorted(range(3000), key=lambda i: (values[i] is None, -(values[i] or 0), i))
    assert [r.i for r in sorted(got, key=lambda r: r["at"])] == want and sorted(r["at"] for r in got) == list(range(3000))
    assert columns.numbered(df, [F.col("v")]).columns == ["i", "v", "kind", "place"]
    assert columns.numbered(df.limit(0), [F.col("v")]).count() == 0
    one = columns.numbered(df.withColumn("v", F.lit(1.0)), [F.col("v")])  # all rows are equal in the order
    assert sorted(r.place for r in one.collect()) == list(range(3000))


def test_levels_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(columns, "MOST_LEVELS", 3)
    df = spark.createDataFrame([(i, i % 4) for i in range(20)], "i long, k long")
    with pytest.raises(ValueError, match="more than 3 levels"):
        columns.one_hot(df, "k")
    assert len(columns.one_hot(df.where("k < 3"), "k").columns) == 4


def test_sizes_of_subsets(spark):
    sizes = [50, 61, 100]
    got = sampling.sizes_of_subsets(spark.createDataFrame([("a", 130), ("b", 99), ("c", 1000)], "k string, n long"), sizes).collect()
    assert {k: [r.sample_size for r in got if r.k == k] for k in "abc"} == {"a": sampling.subset_sizes(sizes, 130), "b": [], "c": sizes}


def test_stages_of_a_pipeline_are_stored(spark, tmp_path):
    """Every transformer, fitted in a Pipeline of Spark's, written, read in another session and applied to other rows: the same values."""
    from pyspark.ml import Pipeline, PipelineModel

    full, x = scattered(300, 4, 11)
    df = as_frame(spark, np.c_[x, np.sin(np.arange(300))])
    names, first, second = ["v0", "v1", "v2", "v3"], df.where("eid < 200"), df.where("eid >= 200")
    made = Pipeline(
        stages=[
            stages.FrameStage(estimators.RegressionImpute(rounds=3), names), stages.FrameStage(estimators.QuantileNormal(most=50), names[:2]), stages.FrameStage(estimators.RobustScale(), names), stages.FrameStage(estimators.Standardise(ddof=1), names),
            stages.FrameStage(estimators.Square(), ["v3"]), stages.FrameStage(estimators.Deconfound(), names, ["v4"]), stages.FrameStage(estimators.Components(2), [*names, "v3_squared"]),
        ]
    )
    made.write().save(f"{tmp_path}/plain")
    again = Pipeline.load(f"{tmp_path}/plain")
    fitted = made.fit(first)
    fitted.write().save(f"{tmp_path}/fitted")
    want = fitted.transform(second).orderBy("eid").collect()
    assert want and {"PC1", "PC2"} <= set(want[0].asDict()) and len(want) == 100
    assert again.fit(first).transform(second).orderBy("eid").collect() == want
    session = spark.newSession()
    rows = session.createDataFrame(second.collect(), second.schema)
    assert PipelineModel.load(f"{tmp_path}/fitted").transform(rows).orderBy("eid").collect() == want
    chain = stages.FrameStage(estimators.Chain([("fill", estimators.MeanImpute()), ("pick", estimators.SelectColumns(mode=0.9))]), names).fit(first)
    chain.save(f"{tmp_path}/chain")
    read = stages.FrameModel.load(f"{tmp_path}/chain")
    assert read.fitted.columns_out == chain.fitted.columns_out and read.uid == chain.uid and read.transform(second).collect() == chain.transform(second).collect()
    with pytest.raises(TypeError):
        stages.encoded(object())
    with pytest.raises(TypeError):
        stages.decoded({"kind": "Other", "held": {"pairs": []}})


def test_folders_of_a_column_of_roots(spark):
    """The same folders as those of one study after the other."""
    own = tables.Paths("/a/", results="/r")
    got = spark.createDataFrame([("/a/",)], "root string").select(F.inline(tables.study_folders(F.col("root"), own))).collect()
    assert {r.what: r.path for r in got} == {w: own.of(w) for w in ("data", "schema", "samples", "results", "figures")}


def test_names_as_columns(spark):
    paths = ["a/b.csv", "b", "a.b/c", ".rc", "a/.rc", "a.tar.gz", "x..y", "/a/b-c.d_e"]
    df = spark.createDataFrame([(p,) for p in [*paths, None]], "p string")
    got = df.select(tables.with_suffix(F.col("p"), "-new")).collect()
    assert [r[0] for r in got] == [*[tables.add_suffix(p, "-new") for p in paths], None]
    units = [("all", 3, 50, True, False, [9, 5]), ("sub", 0, 61, False, True, [7]), (None, 1, 2, True, True, [1])]
    df = spark.createDataFrame(units, "s string, rep int, size int, a boolean, b boolean, sizes array<int>")
    s, rep, a, b = F.col("s"), F.col("rep"), F.col("a"), F.col("b")
    got = df.select(tables.data_name(s, a), tables.design_name(s, rep, F.col("sizes"), a, b), tables.result_name((2, 3), s, F.col("size"), rep, b)).collect()
    for r, (name, n, size, x, y, sizes) in zip(got, units, strict=True):
        assert tuple(r) == ((None,) * 3 if name is None else (tables.data_path(name, x), tables.sample_path(name, n, sizes, x, y), tables.result_path((2, 3), name, size, n, y)))


def test_nested_maps_as_rows(spark):
    schema = "id int, `a.b` int, m map<string, map<int, double>>"
    items = {"x": {1: 0.5, 2: None}, "y": {1: 0.25, 2: 1.0}}
    got = results.nested_frame(spark.createDataFrame([(7, 8, items), (9, 9, None)], schema), "m", ["kind", "n"])
    assert got.columns == ["id", "a.b", "kind", "n", "value"]
    assert sorted((r.kind, r.n, r.value) for r in got.collect()) == sorted(results.nested_rows(items, ["kind", "n"]))
    assert results.nested_frame(spark.createDataFrame([(7, 8, items)], schema), "m", ["kind"]).count() == 2
    for bad in ([(1, 1, {"x": {1: 1.0}, "y": {2: 1.0}})], [(1, 1, {"x": {1: 1.0}}), (2, 2, {"y": {1: 1.0}})], [(1, 1, {})], [(1, 1, {"x": {}})], [(1, 1, None)], []):
        with pytest.raises(RuntimeError):
            results.nested_frame(spark.createDataFrame(bad, schema), "m", ["kind", "n"])
    with pytest.raises(RuntimeError):
        results.nested_frame(spark.createDataFrame([(7, 8, items)], schema), "m", ["kind", "n", "deeper"])


def test_objects_on_the_file_system_of_the_cluster(spark, tmp_path):
    rng = np.random.default_rng(2)
    model = kernels.Cca(2).fit([rng.standard_normal((40, 3)), rng.standard_normal((40, 2))])
    path = f"file://{tmp_path}/saved/deep/m.json"
    for _ in range(2):  # the second replaces the first
        tables.save_object(path, model, spark)
    again = tables.load_object(path, kernels.Cca, spark)
    assert np.array_equal(again.correlations, model.correlations)
    with pytest.raises(TypeError):
        tables.load_object(path, kernels.NanPca, spark)
    tables.save_json(f"file://{tmp_path}/s.json", {"name": "é", "sizes": [1, 2]}, spark)
    assert tables.load_json(f"file://{tmp_path}/s.json", dict, spark) == tables.load_json(f"{tmp_path}/s.json", dict) == {"name": "é", "sizes": [1, 2]}
    (tmp_path / "bad.json").write_text("no")
    for name in ("bad.json", "none.json"):
        with pytest.raises(RuntimeError):
            tables.load_object(f"file://{tmp_path}/{name}", kernels.Cca, spark)
    with pytest.raises(OSError):
        tables.load_json(f"file://{tmp_path}/none.json", spark=spark)
