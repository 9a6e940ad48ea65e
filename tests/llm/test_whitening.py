import math

import numpy as np
import pytest

from varistrata.llm import whitening

SF = "/root/testdata/sf0.01"


def whole(v):
    """The vector in whole numbers; None if it goes."""
    if v is None or any(c is None or not math.isfinite(c) for c in v):
        return None
    return tuple(math.floor(64 * c) + 1_000_000 for c in v)


def brute(rows, most=16):
    """(key, component): n, deviation, whitened up to sign, explained; by numpy over the fit list, and the whitened covariance's error."""
    good = [(k, x) for k, v in rows if (x := whole(v)) is not None]
    dims = max((len(x) for _, x in good), default=0)
    good = [(k, x) for k, x in good if len(x) == dims]
    fit = sorted({x for _, x in good})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    z = np.array([[(n * c - s) / n for c, s in zip(x, sums, strict=True)] for x in fit])
    cov = z.T @ z / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    out = []
    for k, x in good:
        far = [n * c - s for c, s in zip(x, sums, strict=True)]
        own = np.array(far, float) / n
        for j in range(min(most, dims)):
            flat = values[j] <= dims * 2.3e-16 * max(values[0], 1e-300)
            out.append((k, j + 1, n, sum(f * f for f in far), None if flat else abs(own @ axes[:, j]) / math.sqrt(values[j]), values[j] / cov.trace() if cov.trace() else 0.0))
    return sorted(out, key=lambda r: (str(r[0]), r[1], r[3]))


def compare(df, rows):
    got = sorted([tuple(r) for r in df.collect()], key=lambda r: (str(r[0]), r[1], r[3]))
    want = brute(rows)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    for g, w in zip(got, want, strict=True):
        assert (g[4] is None) == (w[4] is None) and (w[4] is None or abs(abs(g[4]) - w[4]) < 1e-7), (g, w)
        assert g[5] == pytest.approx(w[5], rel=1e-6, abs=1e-12)
    errors = {r[6] for r in got}
    assert len(errors) <= 1 and all(e is None or e < 1e-8 for e in errors)
    return got


def test_whole_table_equals_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    df = whitening.query(spark, SF)
    assert df.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    got = compare(df, rows)
    # The sign is the same for all rows: whitened columns of the fit list are uncorrelated, with variance 1.
    w = np.array([r[4] for r in sorted(got, key=lambda r: (r[0], r[1]))]).reshape(-1, 16)
    first = {whole(v): k for k, v in sorted(rows, reverse=True)}
    order = {k: i for i, k in enumerate(sorted(k for k, _ in rows))}
    own = w[[order[k] for k in first.values()]]
    assert np.abs(own.T @ own / len(own) - np.eye(16)).max() < 1e-8


def made(seed, n, dims):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, dims)) @ rng.normal(size=(dims, dims)) / 4


def test_odd_vectors_rows_and_columns(spark):
    """Null, broken, short and repeated vectors, null and repeated keys, names that the operator uses itself."""
    base = [[float(np.float32(c)) for c in v] for v in made(1, 40, 5)]
    rows = [(i, v) for i, v in enumerate(base)] + [(None, base[0]), (3, base[0]), (3, base[0]), *[(100 + i, base[1]) for i in range(60)]]
    rows += [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0]), (902, [float("nan")] * 5), (903, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (904, []), (905, [1.0, 2.0]), (906, [-float("inf")] * 5)]
    full = [(k, v, 1, "x", 2, True, 4.0) for k, v in rows]
    df = spark.createDataFrame(full, "vec_id long, embedding array<float>, k int, x string, component int, n boolean, whitened double").repartition(5)
    got = compare(whitening.whitened(df), rows)
    assert {r[2] for r in got} == {40} and max(r[1] for r in got) == 5


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [float("nan")])]])
def test_no_good_row_gives_none(spark, rows):
    df = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert df.collect() == [] and df.columns[:3] == ["vec_id", "component", "n"]


def test_components_without_variance(spark):
    """One vector has none; three vectors have two components with variance."""
    one = [(1, [0.5, -0.25, 3.0]), (2, [0.5, -0.25, 3.0])]
    schema = "vec_id long, embedding array<float>"
    got = compare(whitening.whitened(spark.createDataFrame(one, schema)), one)
    assert all(r[3] == 0 and r[4] is None and r[6] is None for r in got)
    three = [(i, [float(c) for c in np.float32(v)]) for i, v in enumerate(made(2, 3, 6))]
    got = compare(whitening.whitened(spark.createDataFrame(three, schema)), three)
    assert {r[1] for r in got if r[4] is not None} == {1, 2}


def test_far_from_zero(spark):
    """A shift of all coordinates changes no whitened value: centring is exact."""
    near = [(i, [float(c) for c in np.float32(v)]) for i, v in enumerate(np.round(made(3, 50, 4) * 8) / 8)]
    far = [(i, [c + 4096.0 for c in v]) for i, v in near]
    schema = "vec_id long, embedding array<double>"
    a, b = (whitening.whitened(spark.createDataFrame(r, schema)).orderBy("vec_id", "component").collect() for r in (near, far))
    assert [r.deviation for r in a] == [r.deviation for r in b]
    assert max(abs(x.whitened - y.whitened) for x, y in zip(a, b, strict=True)) < 1e-10


def test_covariance_comes_from_one_aggregation_of_all_pairs(spark):
    n, sums = whitening.pair_sums(spark.createDataFrame([(1.0, 2.0, 3.0), (4.0, 5.0, 6.0)], "a double, b double, c double"), ["a", "b", "c"])
    x = np.array([[1.0, 2, 3], [4, 5, 6]])
    assert n == 2 and (sums == x.T @ x).all() and len(whitening.triangle(64)) == 2080
