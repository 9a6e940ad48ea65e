"""Queries of linear models: Gram matrices, deconfounding, components, canonical correlation and the experiment grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from varistrata.operators import columns, experiment, linear, results, sampling
from varistrata.plans import adapters as A
from varistrata.plans.registry import query


@query("SELECT o.l_orderkey, o.l_linenumber, round(o.l_extendedprice - o.l_tax * w, 4) AS x FROM lineitem o, (SELECT sum(l_tax * l_extendedprice) / sum(l_tax * l_tax) AS w FROM lineitem)")
def deconfound_one(spark, sf_dir):
    l = A.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_tax")  # noqa: E741
    out = linear.deconfound(l, ["l_extendedprice"], ["l_tax"])
    return out.select("l_orderkey", "l_linenumber", F.round("l_extendedprice", 4).alias("x"))


EMBEDDED = A.EMBEDDED


@query("WITH e AS (SELECT CASE WHEN d <= 32 THEN concat('x', d - 1) ELSE concat('y', d - 33) END AS name, d, vec_id, CAST(embedding[d] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS d)) SELECT a.name AS i, b.name AS j, round(sum(a.v * b.v), 6) AS value FROM e a JOIN e b USING (vec_id) WHERE a.d <= b.d GROUP BY 1, 2")
def gram_matrix(spark, sf_dir):
    return linear.gram_matrix(A.halves(spark, sf_dir), EMBEDDED).select("i", "j", A.r6(F.col("value")).alias("value"))


@query("""WITH s AS (SELECT regr_sxx(v, q) AS qq, regr_syy(v, q) AS vv, regr_sxy(v, q) AS qv, count(*) AS n FROM (SELECT l_quantity AS q, l_discount * 100 AS v FROM lineitem)),
e AS (SELECT (qq + vv) / 2 + sqrt((qq + vv) * (qq + vv) / 4 - (qq * vv - qv * qv)) AS hi, (qq + vv) / 2 - sqrt((qq + vv) * (qq + vv) / 4 - (qq * vv - qv * qv)) AS lo, n FROM s)
SELECT 1 AS component, round(hi / (n - 1), 4) AS variance FROM e UNION ALL SELECT 2, round(lo / (n - 1), 4) FROM e""")
def pca_2x2_eigen(spark, sf_dir):
    l = A.table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("q"), (F.col("l_discount") * 100).alias("v"))  # noqa: E741
    model = linear.fit_pca(l, ["q", "v"])
    return spark.createDataFrame([(k + 1, round(float(v), 4)) for k, v in enumerate(model.variance)], "component int, variance double")


@query(f"WITH {A.VIEWS} SELECT 1 AS component, round(abs(corr(a1, b2)), 6) AS corr FROM views")
def cca_1x1(spark, sf_dir):
    model = linear.fit_cca(A.customer_views(spark, sf_dir, "a1", "b2"), ["a1"], ["b2"])
    return spark.createDataFrame([(1, round(float(model.correlations[0]), 6))], "component int, corr double")


@query(f"WITH {A.VIEWS} SELECT 1 AS component, round(corr(a1, b2), 6) AS score FROM views UNION ALL SELECT 2, round(corr(a0, b0), 6) FROM views")
def pairwise_corr_score(spark, sf_dir):
    return linear.pairwise_score(A.customer_views(spark, sf_dir, "a0", "a1", "b0", "b2"), [("a1", "b2"), ("a0", "b0")]).select("component", A.r6(F.col("score")).alias("score"))


@query(f"WITH {A.VIEWS} " + " UNION ALL ".join(f"SELECT '{f}' AS feature, {k} AS component, round(corr({f}, {s}), 6) AS loading FROM views" for f in ("a0", "a1", "a2") for k, s in ((1, "b0"), (2, "b2"))))
def loadings_pairwise(spark, sf_dir):
    out = linear.loadings(A.customer_views(spark, sf_dir, "a0", "a1", "a2", "b0", "b2"), ["a0", "a1", "a2"], ["b0", "b2"])
    return out.select("feature", "component", A.r6(F.col("loading")).alias("loading"))


@query(f"WITH {A.VIEWS} " + " UNION ALL ".join(f"SELECT '{f}' AS feature, 1 AS component, round(sum(coalesce({f}, 0) * b0), 2) AS loading FROM views" for f in ("a0", "a2")))
def loadings_unnormalised(spark, sf_dir):
    out = linear.loadings(A.customer_views(spark, sf_dir, "a0", "a2", "b0"), ["a0", "a2"], ["b0"], normalise=False)
    return out.select("feature", "component", F.round("loading", 2).alias("loading"))


@query("SELECT l_returnflag, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope FROM lineitem GROUP BY 1")
def lr_r2(spark, sf_dir):
    return linear.simple_regressions(A.table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice").select("l_returnflag", A.r6(F.col("r2")).alias("r2"), F.round("slope", 4).alias("slope"))


VIEW_A, VIEW_B, CONFOUNDS = ["a0", "a1", "a2"], ["b0", "b1", "b2"], ["c0", "c1"]


@query()
def cca_full(spark, sf_dir):
    """Canonical correlations of the two customer views: standardised, then one pass of products."""
    v = columns.zscore(A.customer_views(spark, sf_dir, *VIEW_A, *VIEW_B), [*VIEW_A, *VIEW_B])
    model = linear.fit_cca(v, VIEW_A, VIEW_B)
    return spark.createDataFrame([(k + 1, float(c)) for k, c in enumerate(model.correlations)], "component int, corr double")


@query()
def nan_pca(spark, sf_dir):
    w = A.wide(spark, sf_dir).withColumnsRenamed({c: "v" + c.replace("-", "_").replace(".", "_") for c in A.COLUMNS})
    names = [c for c in w.columns if c != "eid"]
    model = linear.fit_pca(w, names, 5)
    return linear.pca_scores(w, names, model).select("eid", *[f"PC{k + 1}" for k in range(5)])


@query()
def iterative_impute(spark, sf_dir):
    """Regressions over all rows, from sums of products."""
    w = A.wide(spark, sf_dir).select("eid", *[F.col(f"`{c}`").alias(f"v{i}") for i, c in enumerate(A.COLUMNS[:6])])
    return linear.iterative_impute(w, [f"v{i}" for i in range(6)], "eid")


def _grid(spark, sf_dir, null_model: bool = False, reps: int = 3, **settings):
    v = A.halves(spark, sf_dir)
    labels = [F.when(F.col("label") == k, 1.0).otherwise(0.0).alias(f"c{k}") for k in range(3)]
    frame = v.select("*", *labels)
    n = frame.count()
    sizes = sampling.planned_sizes(n, 3, 5)
    design = sampling.design(frame.select("eid"), sizes, reps)
    names = {"behavioural": [f"x{i}" for i in range(32)], "brain": [f"y{i}" for i in range(32)]}
    chosen = experiment.Settings(**({"n_pcs": (5, 5), "cv_reps": 2} | settings))
    types = {c: 31 for c in EMBEDDED} | {f"c{k}": 21 for k in range(3)}
    return experiment.run_grid(frame, names, design, chosen, ["c0", "c1", "c2"], null_model=null_model, value_type=types)


@query()
def repeated_cv_ensemble(spark, sf_dir):
    return _grid(spark, sf_dir)


@query()
def cross_validation(spark, sf_dir):
    """The models of one split into folds, each scored on its own rows and on those left out."""
    return _grid(spark, sf_dir, cca_types=("cv",)).where("cca_type = 'cv'").select("sample_size", "rep", "set_name", "component", F.col("pos").alias("fold"), F.col("value").alias("corr"))


@query()
def null_model_band(spark, sf_dir):
    """Quantiles of the validation correlations of shuffled data."""
    out = _grid(spark, sf_dir, null_model=True, reps=8, cca_types=("without_cv",))
    return results.null_quantiles(out.where("metric = 'corr' and set_name = 'val'"), ["subset", "sample_size", "cca_type", "component"], "value", skip_missing=False)


PAIR = {A.COLUMNS[0]: "u", A.COLUMNS[1]: "v"}
#: Two columns with missing values: their products after centring (missing ones as 0) and the axes of the ellipse.
PAIR_AXES = f"""WITH {A.WIDE}, m AS (SELECT avg("{A.COLUMNS[0]}") AS mu, avg("{A.COLUMNS[1]}") AS mv FROM wide),
z AS (SELECT eid, coalesce("{A.COLUMNS[0]}" - mu, 0) AS u, coalesce("{A.COLUMNS[1]}" - mv, 0) AS v FROM wide, m),
s AS (SELECT sum(u * u) AS a, sum(v * v) AS d, sum(u * v) AS b, count(*) AS n FROM z),
t AS (SELECT *, atan2(2 * b, a - d) / 2 AS angle, sqrt((a - d) * (a - d) / 4 + b * b) AS half FROM s),
axes AS (SELECT 1 AS component, ((a + d) / 2 + half) / (n - 1) AS variance, cos(angle) AS wu, sin(angle) AS wv FROM t
         UNION ALL SELECT 2, ((a + d) / 2 - half) / (n - 1), -sin(angle), cos(angle) FROM t),
turned AS (SELECT component, variance, variance / sum(variance) OVER () AS share, wu * turn AS wu, wv * turn AS wv
           FROM (SELECT *, sign(CASE WHEN abs(wu) >= abs(wv) THEN wu ELSE wv END) AS turn FROM axes))"""


def _pair(spark, sf_dir):
    w = A.wide(spark, sf_dir).select("eid", *[F.col(f"`{c}`").alias(n) for c, n in PAIR.items()])
    return w, linear.fit_pca(w, list(PAIR.values()))


@query(PAIR_AXES + """ SELECT eid, round(max(CASE WHEN component = 1 THEN u * wu + v * wv END), 4) + 0.0 AS pc1,
 round(max(CASE WHEN component = 2 THEN u * wu + v * wv END), 4) + 0.0 AS pc2 FROM z, turned GROUP BY eid""")
def nan_pca_scores(spark, sf_dir):
    """Scores on both components of two columns with missing values."""
    w, model = _pair(spark, sf_dir)
    return linear.pca_scores(w, list(PAIR.values()), model).select("eid", F.round("PC1", 4).alias("pc1"), F.round("PC2", 4).alias("pc2"))


@query(PAIR_AXES + " SELECT component, round(variance, 6) AS variance, round(share, 6) AS share FROM turned")
def nan_pca_spectrum(spark, sf_dir):
    _, model = _pair(spark, sf_dir)
    rows = [(k + 1, round(float(v), 6), round(float(s), 6)) for k, (v, s) in enumerate(zip(model.variance, model.share, strict=True))]
    return spark.createDataFrame(rows, "component int, variance double, share double")


FRACTIONS = [k / 20 for k in range(20)]


@query(PAIR_AXES + f""", c AS (SELECT sum(share) OVER (ORDER BY component) AS reached FROM turned)
SELECT fraction, CAST(1 + count(*) FILTER (reached <= fraction) AS INTEGER) AS components FROM c, (SELECT unnest({FRACTIONS}::DOUBLE[]) AS fraction) GROUP BY 1""")
def components_by_fraction(spark, sf_dir):
    """How many components hold each fraction of the variance."""
    _, model = _pair(spark, sf_dir)
    return spark.createDataFrame(list(zip(FRACTIONS, linear.components_reaching(model, FRACTIONS), strict=True)), "fraction double, components int")


def _regression_sql(x: str, k: int) -> str:
    """Least squares of b0 on x and the covariate c0, from the rows with even eid, scored on those and on the others."""
    return f"""SELECT {k} AS components, CASE WHEN even THEN 'fit' ELSE 'test' END AS set_name,
 round(1 - sum(power(b0 - y - bx * ({x} - mx) - bc * (c0 - mc), 2)) / (var_pop(b0) * count(*)), 6) AS r2,
 round(sqrt(avg(power(b0 - y - bx * ({x} - mx) - bc * (c0 - mc), 2))), 6) AS rmse
 FROM whole, (SELECT *, (sxy * scc - scy * sxc) / (sxx * scc - sxc * sxc) AS bx, (scy * sxx - sxy * sxc) / (sxx * scc - sxc * sxc) AS bc FROM
 (SELECT avg(b0) AS y, avg({x}) AS mx, avg(c0) AS mc, var_pop({x}) AS sxx, var_pop(c0) AS scc, covar_pop({x}, c0) AS sxc, covar_pop({x}, b0) AS sxy, covar_pop(c0, b0) AS scy FROM whole WHERE even)) GROUP BY even"""


@query(f"WITH {A.VIEWS}, whole AS (SELECT *, eid % 2 = 0 AS even FROM views WHERE a0 IS NOT NULL AND a1 IS NOT NULL AND b0 IS NOT NULL AND c0 IS NOT NULL) " + " UNION ALL ".join(_regression_sql(x, k) for k, x in ((1, "a0"), (2, "a1"))))
def regressions_with_covariate(spark, sf_dir):
    """A regression for each of two columns with a covariate that is always in, fitted on half of the customers: r2 and the root of the mean squared error."""
    v = A.customer_views(spark, sf_dir, "a0", "a1", "b0", "c0")
    scores = [linear.regression_scores(v, ["a0", "a1"], ["c0"], "b0", F.col("eid") % 2 == 0, method=m, root=m == "mse").withColumnRenamed("score", n) for m, n in (("r2", "r2"), ("mse", "rmse"))]
    return scores[0].join(scores[1], ["components", "set_name"]).select("components", "set_name", A.r6(F.col("r2")).alias("r2"), A.r6(F.col("rmse")).alias("rmse"))


TRIPLE = {"orders": ["a0", "a1"], "lines": ["b0", "b2"], "person": ["c0", "c1"]}
TRIPLE_COLUMNS = [c for view in TRIPLE.values() for c in view]


@query(f"WITH {A.VIEWS} " + " UNION ALL ".join(f"SELECT '{v}' AS view_a, '{w}' AS view_b, {k + 1} AS component, round(corr({TRIPLE[v][k]}, {TRIPLE[w][k]}), 6) AS corr FROM views" for v in TRIPLE for w in TRIPLE for k in range(2)))
def correlation_tensor(spark, sf_dir):
    """Three views' columns, each with its counterpart in every view."""
    return linear.correlation_tensor(A.customer_views(spark, sf_dir, *TRIPLE_COLUMNS), TRIPLE).withColumn("corr", A.r6(F.col("corr")))


@query(f"WITH {A.VIEWS} " + " UNION ALL ".join("SELECT " + f"{k + 1} AS component, round((" + " + ".join(f"corr({TRIPLE[v][k]}, {TRIPLE[w][k]})" for v, w in (("orders", "lines"), ("orders", "person"), ("lines", "person"))) + ") / 3, 6) AS score FROM views" for k in range(2)))
def three_view_score(spark, sf_dir):
    return linear.mean_pair_correlation(A.customer_views(spark, sf_dir, *TRIPLE_COLUMNS), TRIPLE).withColumn("score", A.r6(F.col("score")))


#: The largest root of the characteristic cubic of three columns' correlations (p, q, r), by the cosine of a third of an angle.
CUBIC = f"""{A.VIEWS}, c AS (SELECT corr(a1, b2) AS p, corr(a1, c0) AS q, corr(b2, c0) AS r FROM views),
root AS (SELECT *, 2 * sqrt(u / 3) * cos(acos(greatest(-1, least(1, 3 * p * q * r / u * sqrt(3 / u)))) / 3) AS t FROM (SELECT *, p * p + q * q + r * r AS u FROM c))"""


@query(f"WITH {CUBIC} SELECT round(1 + t, 6) AS value FROM root")
def three_view_cca(spark, sf_dir):
    """Three views of one column each: the largest eigenvalue of their correlations."""
    model = linear.fit_mcca(A.customer_views(spark, sf_dir, "a1", "b2", "c0"), [["a1"], ["b2"], ["c0"]])
    return spark.createDataFrame([(round(float(model.values[0]), 6),)], "value double")
