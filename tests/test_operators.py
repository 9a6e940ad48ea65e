"""Operators on small hand-made tables."""

import pickle
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from varistrata.functions import kernels
from varistrata.operators import blocks, catalog, cohort, columns, experiment, linear, results, sampling
from varistrata.sources import tables

from tests.twins import twin_regression


def test_udis_and_paths(spark, tmp_path):
    assert [tuple(r) for r in tables.parse_udis(spark, ["31-2.10"]).collect()] == [("31-2.10", 31, 2, 10)]
    with pytest.raises(ValueError):
        tables.parse_udis(spark, ["eid"])
    assert tables.add_suffix("a/b.csv", "-x") == "a/b-x.csv" and tables.data_path("brain", clean=True) == "brain-clean.csv"
    path = f"{tmp_path}/c.json"
    tables.save_json(path, {"a": 1})
    assert tables.load_json(path, dict) == {"a": 1}
    with pytest.raises(TypeError):
        tables.load_json(path, list)
    df = spark.createDataFrame([(1, 2.0, float("nan")), (2, float("inf"), 1.0)], "eid long, x double, y double")
    assert [tuple(r) for r in tables.missing_to_null(df).collect()] == [(1, 2.0, None), (2, None, 1.0)]
    assert tables.write_subset(df, f"{tmp_path}/out", ["y"], lambda d: d.where("eid > 1")) == (1, 1)
    with open(f"{tmp_path}/t.csv", "w") as f:
        f.write("eid,1-2.0,1-2.0\neid,1-2.0_a,1-2.0_b\n7,,3\n")
    got, pairs = tables.load_encoded(spark, f"{tmp_path}/t.csv")
    assert [tuple(r) for r in got.collect()] == [(7, None, "3")] and pairs == [("1-2.0", "1-2.0_a"), ("1-2.0", "1-2.0_b")]
    results_df = spark.createDataFrame([(tables.result_path((20, 20), "all", s, r),) for s in (50, 61) for r in (2, 10)], "path string")
    assert [tuple(r)[1:] for r in tables.find_results(results_df).collect()] == [(61, 2), (61, 10), (50, 2), (50, 10)]


def test_catalogue(spark):
    tree = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (4, 1)], "parent_id int, child_id int")
    assert sorted(r[0] for r in catalog.category_closure(tree, [2]).collect()) == [1, 2, 3, 4]
    fields = spark.createDataFrame([(10, "Score (FI) test", 11, 4), (11, "Name", 41, 4), (12, "Other", 31, 9)], "field_id int, title string, value_type int, main_category int")
    assert catalog.filter_by_title(fields, "(FI) test", keep=False).count() == 3
    with pytest.raises(ValueError):
        catalog.value_types("odd")
    udis = tables.parse_udis(spark, ["10-0.0", "10-2.0", "10-1.1", "12-3.0"])
    assert sorted(r.udi for r in catalog.filter_by_instance(udis, [0, 1, 2], "max").collect()) == ["10-1.1", "10-2.0"]
    categories = spark.createDataFrame([(4, "Tests")], "category_id int, title string")
    merged = catalog.merged_catalog(udis, fields, categories)
    assert merged.count() == 3
    with pytest.raises(KeyError):
        catalog.require(merged, udis)


def test_cohorts(spark):
    rows = [(1, None, None), (2, "I10", None), (3, "I101", None), (4, None, "Z864"), (5, "F109", "I10"), (6, "F20", None)]
    d = spark.createDataFrame(rows, "eid long, a string, b string")
    ids = lambda name: sorted(r.eid for r in cohort.subset(d, name, ["a", "b"]).collect())
    assert ids("healthy") == [1] and ids("hypertension") == [2, 5] and ids("psychoactive") == [4, 5] and ids("hyperpsycho") == [5]
    assert ids("psychoactive_no_overlap") == [4] and ids("hypertension_no_overlap") == [2] and len(ids("all")) == 6
    with pytest.raises(ValueError):
        cohort.subset(d, "odd", ["a"])
    with pytest.raises(KeyError):
        cohort.without_subjects(d, spark.createDataFrame([(9,)], "eid long"), strict=True)
    data = cohort.StudyData.of(d).add_dataset("x", d)
    with pytest.raises(RuntimeError):
        data.add_dataset("x", d)
    with pytest.raises(ValueError):
        data.add_dataset("y", d.where("eid < 3"))
    assert data.filter(lambda f: F.col("x__a").isNotNull()).frame.count() == 4
    with pytest.raises(RuntimeError):
        data.set_group(d).set_group(d)


def test_cleaning(spark):
    a = spark.createDataFrame([(1, None, None), (2, 1.0, None), (3, 2.0, 4.0)], "eid long, `1-2.2` double, `1-2.10` double")
    b = spark.createDataFrame([(1, 5), (2, None), (3, 5)], "eid long, `2-2.0` int")
    plans = {"a": columns.CleaningPlan(average={"1": ["1-2.2", "1-2.10"]}), "b": columns.CleaningPlan(encode={"2-2.0": None})}
    kept, _, gone = columns.clean({"a": a, "b": b}, plans)
    assert [r.eid for r in gone.collect()] == [1] and kept["a"].columns == ["eid", "1-2.10_mean2", "1-2.10_std2"]
    assert sorted(map(tuple, kept["a"].collect())) == [(2, 1.0, None), (3, 3.0, pytest.approx(2**0.5))]
    assert {tuple(r) for r in kept["b"].collect()} == {(2, 0), (3, 1)}
    with pytest.raises(NotImplementedError):
        columns.row_mean_std(a, ["1-2.2", "1-3.0"], "1")
    with pytest.raises(KeyError):
        columns.one_hot(b, "2-2.0", keep=7)
    with pytest.raises(RuntimeError):
        columns.square_columns(a, ["q"])
    x = spark.createDataFrame([(float(i % 2), 1.0, None if i < 5 else float(i)) for i in range(10)], "p double, q double, r double")
    found = columns.find_bad_columns(x, ["p", "q", "r"], missing=0.5, mode=0.9)
    assert found.kept == ["p"] and found.dropped == {"missing": ["r"], "mode": ["q"]}
    both = {r["column"]: r["mode"] for r in columns.mode_fraction(x, ["r"], null_as_value=True).collect()}
    assert both["r"] == 1.0
    assert columns.filtered_quantile_columns(["1-0.0", "2-0.0", "3-0.0_mean3"], {"1-0.0": 31, "2-0.0": 21}) == ["1-0.0", "3-0.0_mean3"]


def test_scores_match_kernels(spark):
    rng = np.random.default_rng(0)
    x = np.round(rng.exponential(size=300), 1)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id long, v double")
    long = df.select("id", F.lit("v").alias("column"), F.col("v").alias("value"))
    got = np.array([r.score for r in columns.inverse_normal(long).orderBy("id").collect()])
    assert np.allclose(got, kernels.inverse_normal(x))
    fitted = columns.fit_quantiles(df, ["v"])
    got = np.array([r.v for r in columns.quantile_transform(df, fitted).orderBy("id").collect()])
    assert np.allclose(got, kernels.quantile_normal(x, kernels.quantile_references(x)))


@pytest.mark.parametrize("digits", [1, 2, 9])
def test_quantiles_of_many_values(spark, digits):
    x = np.round(np.random.default_rng(digits).exponential(size=7001), digits)
    df = spark.createDataFrame([(float(v), 1.0) for v in x], "v double, one double")
    got = columns.fit_quantiles(df, ["v", "one"])
    assert got["v"] == kernels.quantile_references(x).tolist() and set(got["one"]) == {1.0} and len(got["one"]) == 1000


def test_linear_models(spark):
    rng = np.random.default_rng(1)
    c, s = rng.standard_normal((400, 2)), rng.standard_normal((400, 1))
    x, y = rng.standard_normal((400, 3)) + s + 50, rng.standard_normal((400, 2)) + s
    x[::9, 0] = np.nan
    names = ["c0", "c1", "x0", "x1", "x2", "y0", "y1"]
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(np.c_[c, x, y])]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{n} double" for n in names)).repartition(5)
    model = linear.fit_pca(df, ["x0", "x1", "x2"])
    twin = kernels.NanPca().fit(x)
    assert np.allclose(model.variance, twin.variance) and np.allclose(model.components, twin.components, atol=1e-8)
    got = np.array([r.PC1 for r in linear.pca_scores(df, ["x0", "x1", "x2"], model).orderBy("id").collect()])
    assert np.allclose(got, twin.transform(x)[:, 0])
    clean = linear.deconfound(df, ["x0", "x1"], ["c0", "c1"]).orderBy("id").toPandas()
    want = kernels.deconfound(c, x[:, :2], kernels.deconfound_weights(c, x[:, :2]))
    assert np.allclose(clean[["x0", "x1"]].to_numpy(float), want, equal_nan=True)
    with pytest.raises(ValueError):
        linear.deconfound(df, ["x1"], ["x0"])
    have = ~np.isnan(x[:, 0])
    cca = linear.fit_cca(df, ["x0", "x1", "x2"], ["y0", "y1"])
    assert np.allclose(cca.correlations, kernels.Cca().fit([x[have], y[have]]).correlations)
    scores = linear.cca_scores(df, ["x0", "x1", "x2"], ["y0", "y1"], cca).na.drop("any", subset=["x0"])
    assert scores.select(F.corr("X1", "Y1")).first()[0] == pytest.approx(cca.correlations[0])
    load = {(r.feature, r.component): r.loading for r in linear.loadings(df, ["x0", "x1"], ["y0"]).collect()}
    assert load["x0", 1] == pytest.approx(kernels.pairwise_corr(x[:, 0], y[:, 0])) and load["x1", 1] == pytest.approx(np.corrcoef(x[:, 1], y[:, 0])[0, 1])


def test_design(spark):
    assert sampling.size_bounds(40_514, 40) == (50, 20257)
    for bad in ({"most": 99}, {"least": 60, "most": 50}):
        with pytest.raises(ValueError):
            sampling.size_bounds(60, 5, **bad)
    assert sampling.subset_sizes([50, 61, 100], 130) == [50, 61]
    subjects = spark.createDataFrame([(i, i % 4) for i in range(200)], "eid long, g int")
    d = sampling.design(subjects, [20, 50], 3, strata="g").cache()
    learn, val = d.where("set_name = 'learn'"), d.where("set_name = 'val'")
    assert {(r.rep, r.sample_size): r["count"] for r in learn.groupBy("rep", "sample_size").count().collect()} == {(r, s): s for r in range(3) for s in (20, 50)}
    assert learn.join(val, ["rep", "eid"]).count() == 0 and learn.groupBy("rep", "sample_size", "eid").count().where("count > 1").count() == 0
    assert val.groupBy("rep").count().where("count != 100").count() == 0
    drawn = sampling.design(subjects, [100], 2, replace=True, match_validation=True)
    assert drawn.groupBy("rep", "set_name").count().where("count != 100").count() == 0 and drawn.distinct().count() == drawn.count() > drawn.select("rep", "set_name", "eid").distinct().count()
    assert sampling.stratified_quota({"a": 5, "b": 3}, 4) == {"a": 3, "b": 1}


def grid_inputs(spark):
    rng = np.random.default_rng(2)
    n = 240
    c, s = rng.standard_normal((n, 2)), rng.standard_normal((n, 1))
    x, y = 2 * s + rng.standard_normal((n, 6)) + c[:, :1], 2 * s + rng.standard_normal((n, 5)) + c[:, 1:]
    x[rng.random(x.shape) < 0.03] = np.nan
    names = [f"c{i}" for i in range(2)] + [f"x{i}" for i in range(6)] + [f"y{i}" for i in range(5)]
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(np.c_[c, x, y])]
    frame = spark.createDataFrame(rows, "eid long, " + ", ".join(f"{k} double" for k in names))
    data = {"behavioural": names[2:8], "brain": names[8:]}
    return frame, data, sampling.design(frame.select("eid"), [60, 120], 2)


def test_grid(spark):
    frame, data, design = grid_inputs(spark)
    settings = experiment.Settings(n_pcs=(3, 3), cv_reps=2)
    got = experiment.run_grid(frame, data, design, settings, ["c0", "c1"], ["x0", "y0"]).cache()
    corr = got.where("metric = 'corr' and component = 1").toPandas()
    assert len(corr) == 2 * 2 * 2 * 2 and (corr.value > 0.6).all()
    wide = corr.pivot_table(index=["sample_size", "rep", "cca_type"], columns="set_name", values="value")
    assert (wide.learn - wide.val).mean() > -0.05
    assert got.where("metric = 'loading'").count() == 2 * 2 * 2 * 2 * 11 * 3
    null = experiment.run_grid(frame, data, design, experiment.Settings(n_pcs=(3, 3), cca_types=("without_cv",)), ["c0", "c1"], null_model=True)
    val = null.where("metric = 'corr' and component = 1 and set_name = 'val'").toPandas().value
    assert val.abs().mean() < corr.value.mean() - 0.2  # fitted on shuffled rows, looked at on rows as they are
    aligned, _ = results.align_signs(got.where("metric = 'loading'").withColumnRenamed("value", "loading"), got.where("metric = 'loading' and sample_size = 120 and rep = 0").withColumnRenamed("value", "loading"))
    first = aligned.where("dataset = 'brain' and set_name = 'learn' and component = 1").groupBy("sample_size", "rep", "cca_type").agg(F.avg("loading").alias("m")).toPandas()
    assert (np.sign(first.m) == np.sign(first.m.iloc[0])).all()


def test_grid_with_keys_of_any_kind(spark):
    """Text keys give what numbers give; a sampled key the frame lacks is left out; one it has twice gives both rows, in whatever order they come."""
    frame, data, design = grid_inputs(spark)
    settings = experiment.Settings(n_pcs=(3, 3), cca_types=("without_cv",))
    by = ["sample_size", "rep", "set_name", "metric", "dataset", "feature", "component"]
    run = lambda f, d: f"{experiment.run_grid(f, data, d, settings, ['c0', 'c1']).toPandas().sort_values(by).value.round(9).tolist()}"
    design = design.where("sample_size is null or sample_size = 60").where("rep = 0")
    text = lambda d: d.withColumn("eid", F.concat(F.lit("s"), F.col("eid").cast("string")))
    plain = run(frame, design)
    assert run(text(frame), text(design)) == plain
    absent = design.unionByName(design.where("set_name = 'learn'").limit(1).withColumn("eid", F.lit(10**6).cast("long")).withColumn("draw", F.lit(10**6)))
    assert run(frame, absent) == plain
    twice = frame.unionByName(frame.where("eid < 40").withColumn("x0", F.lit(0.5)))
    assert run(twice.repartition(1), design) == run(twice.repartition(5), design) != plain


@pytest.mark.parametrize("null_model", [False, True])
def test_grid_of_blocks(spark, monkeypatch, null_model):
    """A sample of several blocks gives what one group of all its rows gives, in every kind of fit, with missing values, a dominant column and scores."""
    frame, data, design = grid_inputs(spark)
    frame = frame.withColumn("x5", F.when(F.col("eid") % 50 == 0, F.col("x5")).otherwise(0.0)).withColumn("c1", F.floor("c1"))
    settings = experiment.Settings(n_pcs=(3, 3), cv_reps=2, cca_types=("without_cv", "repeated_cv", "cv"), ensemble="nanmedian", scores=True)
    types = {"x0": 31, "y0": 31, "y1": 31, "c0": 11, "c1": 21}
    by = ["sample_size", "rep", "cca_type", "set_name", "metric", "dataset", "feature", "component", "pos"]
    run = lambda s, confounds: experiment.run_grid(frame, data, design, s, confounds, null_model=null_model, value_type=types).toPandas().sort_values(by).reset_index(drop=True)

    for confounds in (["c0", "c1"], []):
        # With a model_transform all rows of a sample are one group.
        want = run(replace(settings, model_transform=lambda scores: scores), confounds)
        monkeypatch.setattr(blocks, "BLOCK_ROWS", 32)
        got = run(settings, confounds)
        monkeypatch.undo()
        assert len(got) == len(want) > 1000 and got[by].astype(str).equals(want[by].astype(str))
        np.testing.assert_allclose(got.value, want.value, rtol=1e-6, atol=1e-8)


def test_blocks_are_scaled_a_few_rows_at_a_time(monkeypatch):
    """A task's tables of scaled rows don't grow with the block, and their sums are those of all its rows."""
    rng = np.random.default_rng(2)
    shape = blocks.Shape((("a", "b"), ("c", "d")), 1, np.zeros(4, bool), np.ones(1, bool))
    x, dealt = (rng.standard_normal((2 * experiment.PIECE + 100, 5)) for _ in range(2))
    s = blocks.Scalings(shape, [(j, pickle.dumps((True, False, [(None, 0.1 * j, 1.0 + j), (None, 0.2, 2.0)])), None) for j in range(5)])
    scalings = [s.preprocessor(i, (1, 1)) for i in range(2)]
    inside = [np.arange(len(x)), np.arange(50, len(x), 3)]
    whole, other = ([s.basis(p, shape.views(t)) for p in scalings] for t in (x, dealt))
    basis, rows = blocks.Scalings.basis, []
    monkeypatch.setattr(blocks.Scalings, "basis", lambda self, p, v: rows.append(len(v.x[0])) or basis(self, p, v))
    got = blocks.block_grams(s, shape.views(x), list(zip(scalings, inside, strict=True)), dict(enumerate([dealt, dealt[inside[1]]])))
    assert max(rows) <= experiment.PIECE
    for i, at in enumerate(inside):
        e = whole[i]
        np.testing.assert_allclose(got[i], [e[at].T @ e[at], e.T @ e, e.T @ whole[0], e[at].T @ other[i][at], e.T @ other[0]], atol=1e-8)
    np.testing.assert_allclose(blocks.block_grams(s, shape.views(x), list(zip(scalings, inside, strict=True)), None), got[:, :3])


def test_only_singular_fits_are_tried_again(monkeypatch):
    rng = np.random.default_rng(1)
    x, y = rng.standard_normal((60, 3)), rng.standard_normal((60, 3))
    v = experiment.Views([x, y], [list("abc"), list("def")], None, [np.zeros(3, bool)] * 2)
    settings = experiment.Settings(n_pcs=(2, 2), cv_reps=1, n_folds=2, missing=0.9, frequency=1.0, cca_types=("repeated_cv",))
    fit, calls = experiment.Model.fit, []

    def failing(error, times):
        def once(self, views, shuffle=None):
            calls.append(1)
            if 1 < len(calls) <= 1 + times:  # the first is the plain model
                raise error
            return fit(self, views, shuffle)

        return once

    for error, times, again in ((np.linalg.LinAlgError("singular"), 2, True), (ValueError(experiment.NOT_FINITE), 2, True), (ValueError("shapes differ"), 1, False), (np.linalg.LinAlgError("singular"), 99, False)):
        calls.clear()
        monkeypatch.setattr(experiment.Model, "fit", failing(error, times))
        if again:
            assert experiment.unit(v, v, settings, False, [1])
        else:
            with pytest.raises(type(error)):
                experiment.unit(v, v, settings, False, [1])


def test_majority_vote(spark):
    """Shares over a half are exact, whatever the types, the order of the rows and how they are parted; without one the share is 0."""
    import datetime
    import decimal

    rng = np.random.default_rng(4)
    n = 1500
    mostly = lambda value, other, share: [value if u < share else other(i) for i, u in enumerate(rng.random(n))]
    data = {
        "text string": mostly("a", lambda i: f"b{i % 300}", 0.55), "even string": ["x", "y"] * (n // 2), "number double": mostly(-0.0, lambda i: 0.0 if i % 2 else i / 7, 0.4), "nan double": mostly(float("nan"), lambda i: 1.5, 0.7),
        "whole long": mostly(2**60 + 1, lambda i: 2**60 + i % 2, 0.3), "flag boolean": mostly(True, lambda i: None, 0.2), "day date": mostly(datetime.date(2020, 2, 29), lambda i: datetime.date(2021, 1, 1 + i % 28), 0.8),
        "money decimal(9,2)": mostly(decimal.Decimal("1.50"), lambda i: decimal.Decimal(i) / 100, 0.6), "few string": mostly(None, lambda i: f"{i}", 0.9), "none double": [None] * n, "float float": mostly(0.1, lambda i: float(i), 0.65),
    }
    names = [k.split()[0] for k in data]
    df = spark.createDataFrame(list(zip(*data.values(), strict=True)), ", ".join(data))
    sorted_first = df.orderBy("text", "whole")  # all of one kind in some tasks
    want = {r["column"]: r["mode"] for r in columns.mode_fraction(df, names).collect()}
    for rows in (df.repartition(7), df.coalesce(1), sorted_first.repartitionByRange(5, "text")):
        got = {r["column"]: r["mode"] for r in columns.majority_fraction(rows, names).collect()}
        assert got.pop("none") is None
        assert got == {c: want[c] if want[c] > 0.5 else 0.0 for c in got}
    assert {c for c in names if (want[c] or 0) > 0.5} == {"text", "number", "nan", "whole", "flag", "day", "money", "float"}
    assert {r["column"]: r["kinds"] for r in columns.distinct_values(df, names).collect()}["whole"] == 2
    found = columns.find_bad_columns(df, names, missing=0.95, mode=0.6, outlier=1e9, largest=1e9, prepare=None)
    assert set(found.dropped["mode"]) == {c for c in names if c != "none" and want[c] >= 0.6} and found.dropped["missing"] == ["none"]
    empty = columns.majority_fraction(df.limit(0), names)
    assert {r["mode"] for r in empty.collect()} == {None}
    plan = columns.majority_candidates(df, names)._jdf.queryExecution().toString()
    assert "Generate" not in plan and "Expand" not in plan


def test_result_tables(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 3.0), ("b", 5.0)], "k string, v double")
    assert {r.k: (r.mean, r.std) for r in results.mean_std(df, ["k"], "v", loadings=False).collect()} == {"a": (2.0, 1.0), "b": (5.0, 0.0)}
    q = {r.k: r.q0 for r in results.null_quantiles(df, ["k"], "v", [0.5], skip_missing=False).collect()}
    assert q == {"a": None, "b": 5.0}
    flipped = results.flip_bounds(spark.createDataFrame([(1.0, -2.0, 3.0)], "value double, low double, high double"), F.lit(-1))
    assert tuple(flipped.first()) == (-1.0, -3.0, 2.0)
    masks = spark.createDataFrame([("s", "x", 50, True), ("s", "x", 60, False), ("s", "y", 70, False)], "subset string, dataset string, sample_size int, masked boolean")
    assert results.first_significant(masks, ["subset"]).first()["sample_size"] == 70
    normal = spark.createDataFrame([(float(v),) for v in np.random.default_rng(7).standard_normal(400)], "v double").withColumn("k", F.lit(1))
    band = results.bootstrap_intervals(normal, ["k"], "v").first()
    assert band.low < normal.agg(F.avg("v")).first()[0] < band.high and band.high - band.low == pytest.approx(0.196, rel=0.25)


def test_nested_and_unique(spark):
    rows = results.nested_rows({50: {"learn": 0.5, "val": 0.1}, 61: {"learn": 0.4, "val": 0.2}}, ["sample_size", "set_name"])
    df = spark.createDataFrame(rows, "sample_size int, set_name string, value double")
    assert results.require_unique(df, ["sample_size", "set_name"]).count() == 4
    for bad in (lambda: results.require_unique(df, ["set_name"]), lambda: results.nested_rows({1: {"a": 1}, 2: {"b": 1}}, ["x", "y"]), lambda: results.nested_rows({}, ["x"]), lambda: results.nested_rows({1: 2}, ["x", "y"])):
        with pytest.raises(RuntimeError):
            bad()
    tables_ = results.heatmap_tables(
        spark.createDataFrame([("f", 50, -0.5), ("g", 50, 0.1), ("f", 61, 0.2), ("g", 61, None)], "feature string, sample_size int, value double"), spark.createDataFrame([("f", 50, 0.1)], "feature string, sample_size int, value double"),
        spark.createDataFrame([("f", -0.3, 0.3), ("g", 0.2, 0.2)], "feature string, low double, high double"), [50, 61],
    )
    got = {n: {r.feature: (r["50"], r["61"]) for r in t.collect()} for n, t in tables_.items()}
    assert got["mag"] == {"f": (0.5, 0.2), "g": (0.1, None)} and got["rank"] == {"f": (1, 0), "g": (0, None)} and got["mask"]["f"] == (False, True) and got["mask"]["g"][0] is True
    low = spark.createDataFrame([("f", -1.0)], "feature string, value double")
    bounds = results.loadings_with_bounds(spark.createDataFrame([("g", 2.0)], "feature string, value double"), low, low, ["feature"])
    assert sorted(map(tuple, bounds.collect())) == [("f", None, -1.0, -1.0), ("g", 2.0, None, None)]


def test_build_study(spark):
    a = spark.createDataFrame([(1, 2.0), (2, 3.0)], "eid long, x double")
    study = cohort.build_study({"behavioural": a, "conf": a}, {"disease": a}, "conf", a, a)
    assert study.datasets == {"behavioural": ["behavioural__x"], "conf": ["conf__x"]} and study.subset(a.where("eid = 1")).extra["disease"].count() == 1
    with pytest.raises(ValueError):
        cohort.build_study({})
    assert cohort.select_rows([np.arange(5)], [1, 3])[0].tolist() == [1, 3]


def test_component_regression_equals_rows(spark):
    from varistrata.plans import adapters, tables as plan_tables

    sf = "/root/testdata/sf0.01"
    got = {(r.components, r.set_name): r.r2 for r in plan_tables.component_regression(spark, sf).collect()}
    v = adapters.halves(spark, sf).select("*", (F.xxhash64("eid") % 2 == 0).alias("_fit")).toPandas()
    x = v[[*[f"x{i}" for i in range(32)], *[f"y{i}" for i in range(1, 32)]]].to_numpy()
    want = twin_regression(kernels.NanPca(5).fit(x).transform(x), v.y0.to_numpy(), v._fit.to_numpy())
    for k, (fit, test) in enumerate(want, 1):
        assert got[k, "fit"] == pytest.approx(fit) and got[k, "test"] == pytest.approx(test)


def test_imputation_uses_all_rows(spark, monkeypatch):
    from varistrata.plans import adapters, models

    rng = np.random.default_rng(8)
    x = rng.standard_normal((20_500, 1)) @ np.ones((1, 6)) + 0.3 * rng.standard_normal((20_500, 6)) + 40
    x[rng.random(x.shape) < 0.2] = np.nan
    x[5], x[6, 2] = np.nan, np.inf
    wide = spark.createDataFrame([(i, *r) for i, r in enumerate(x.tolist())], ["eid", *adapters.COLUMNS[:6]]).repartition(5)
    monkeypatch.setattr(adapters, "wide", lambda spark, sf_dir: wide)
    got = models.iterative_impute(spark, "").toPandas().sort_values("eid")
    want = kernels.iterative_impute(x)
    assert got["eid"].tolist() == list(range(len(x))) and np.allclose(got.drop(columns="eid").to_numpy(), want, rtol=0, atol=1e-8)
    few = spark.createDataFrame([(1, 1.0, None), (2, 3.0, None)], "eid long, a double, b double")
    assert sorted(tuple(r) for r in linear.iterative_impute(few, ["a", "b"], "eid").collect()) == [(1, 1.0, 0.0), (2, 3.0, 0.0)]


def test_closure_of_a_deep_tree(spark):
    tree = spark.createDataFrame([(i, i + 1) for i in range(36)] + [(36, 0)], "parent_id int, child_id int").coalesce(1)
    assert sorted(r[0] for r in catalog.category_closure(tree, [0]).collect()) == list(range(37))
