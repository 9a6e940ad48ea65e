"""Queries behind figures and further tables: bounds, heatmaps, explained variance, cleaning, regression on components."""

from __future__ import annotations

from pyspark.sql import functions as F

from varistrata.operators import cohort, columns, linear, results
from varistrata.plans import adapters as A
from varistrata.plans.registry import query


@query(f"""WITH {A.RESULTS}, m AS (SELECT feature, avg(loading) AS value FROM results WHERE sample_size = 400 AND event_type IN ('view', 'click') GROUP BY 1),
lo AS (SELECT feature, quantile_cont(loading, 0.025) AS low FROM results WHERE sample_size = 400 AND event_type IN ('click', 'signup') GROUP BY 1), hi AS (SELECT feature, quantile_cont(loading, 0.975) AS high FROM results WHERE sample_size = 400 AND event_type IN ('click', 'signup') GROUP BY 1)
SELECT feature, round(value, 6) AS value, round(low, 6) AS low, round(high, 6) AS high FROM m FULL OUTER JOIN lo USING (feature) FULL OUTER JOIN hi USING (feature)""")
def loading_bounds(spark, sf_dir):
    r = A.results(spark, sf_dir).where("sample_size = 400")
    means = r.where("event_type in ('view', 'click')").groupBy("feature").agg(A.r6(F.avg("loading")).alias("value"))
    null = r.where("event_type in ('click', 'signup')")
    at = lambda q: null.groupBy("feature").agg(A.r6(F.percentile("loading", F.lit(q))).alias("value"))
    return results.loadings_with_bounds(means, at(0.025), at(0.975), ["feature"])


@query(f"""WITH {A.RESULTS}, q AS (SELECT feature, avg(loading) AS v, quantile_cont(loading, 0.1) AS lo, quantile_cont(loading, 0.8) AS hi FROM results GROUP BY 1)
SELECT feature, round(CASE WHEN v < 0 THEN -v ELSE v END, 6) AS value, round(CASE WHEN v < 0 THEN -hi ELSE lo END, 6) AS low, round(CASE WHEN v < 0 THEN -lo ELSE hi END, 6) AS high FROM q""")
def flipped_bounds(spark, sf_dir):
    q = A.results(spark, sf_dir).groupBy("feature").agg(F.avg("loading").alias("value"), F.percentile("loading", F.lit(0.1)).alias("low"), F.percentile("loading", F.lit(0.8)).alias("high"))
    out = results.flip_bounds(q.withColumn("_s", F.col("value")), F.col("_s"))
    return out.select("feature", *[A.r6(F.col(c)).alias(c) for c in ("value", "low", "high")])


@query(f"""WITH {A.RESULTS}, m AS (SELECT feature, sample_size, avg(loading) AS v FROM results WHERE event_type <> 'error' GROUP BY 1, 2), r AS (SELECT feature, sample_size, row_number() OVER (PARTITION BY sample_size ORDER BY abs(v), feature) - 1 AS k FROM m)
SELECT feature, """ + ", ".join(f"CAST(max(CASE WHEN sample_size = {s} THEN k END) AS BIGINT) AS s{s}" for s in (100, 200, 300, 400)) + " FROM r GROUP BY 1")
def heatmap_ranks(spark, sf_dir):
    r = A.results(spark, sf_dir)
    stats = r.where("event_type != 'error'").groupBy("feature", "sample_size")
    null = r.where("event_type = 'error' and sample_size = 400").groupBy("feature").agg(F.percentile("loading", F.lit(0.025)).alias("low"), F.percentile("loading", F.lit(0.975)).alias("high"))
    sizes = [100, 200, 300, 400]
    tables = results.heatmap_tables(stats.agg(F.avg("loading").alias("value")), stats.agg(F.stddev_samp("loading").alias("value")), null, sizes)
    return tables["rank"].select("feature", *[F.col(str(s)).cast("long").alias(f"s{s}") for s in sizes])


FIRST = {f: [c for c in A.COLUMNS if c.startswith(f"{f}-0.")] for f in A.FIELDS.values()}


@query(f"""WITH {A.LONG}, rest AS (SELECT eid, CAST(count(value) AS BIGINT) AS others FROM long WHERE split_part(col, '-', 2) NOT LIKE '0.%' GROUP BY 1), v AS (SELECT eid, split_part(col, '-', 1) AS field, avg(value) AS m, stddev_samp(value) AS s FROM long WHERE split_part(col, '-', 2) LIKE '0.%' GROUP BY 1, 2),
k AS (SELECT eid FROM long WHERE value IS NOT NULL GROUP BY 1) SELECT v.eid, field, round(m, 6) AS mean3, round(m * m, 4) AS mean3_squared, round(s, 6) AS std3, others FROM v JOIN rest USING (eid) JOIN k USING (eid)""")
def clean_domain(spark, sf_dir):
    """All columns of a domain: instance 0 of each field averaged and squared, the others as they are."""
    mean = lambda f: f"{f}-0.0_mean3"
    plan = columns.CleaningPlan(average={str(f): own for f, own in FIRST.items()}, square=[mean(f) for f in FIRST])
    kept, _, _ = columns.clean({"behavioural": A.wide(spark, sf_dir)}, {"behavioural": plan})
    rest = sum((F.col(f"`{c}`").isNotNull().cast("long") for c in A.COLUMNS if not any(c in own for own in FIRST.values())), F.lit(0).cast("long"))
    told = [F.struct(F.lit(str(f)).alias("field"), A.r6(F.col(f"`{mean(f)}`")).alias("mean3"), F.round(F.col(f"`{mean(f)}_squared`"), 4).alias("mean3_squared"), A.r6(F.col(f"`{f}-0.0_std3`")).alias("std3")) for f in FIRST]
    return kept["behavioural"].select("eid", rest.alias("others"), F.inline(F.array(*told)))


@query(f"WITH {A.DISEASES} SELECT eid, c_acctbal AS demo__balance FROM diseases JOIN customer ON eid = c_custkey WHERE d0 IS NULL AND d1 IS NULL AND d2 IS NULL AND d3 IS NULL")
def study_subset(spark, sf_dir):
    d = A.diseases(spark, sf_dir)
    demo = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("eid"), F.col("c_acctbal").alias("balance"))
    study = cohort.build_study({"demo": demo}, {"disease": d})
    return study.subset(cohort.subset(study.extra["disease"], "healthy", ["d0", "d1", "d2", "d3"]).select("eid")).frame


@query(f"WITH {A.LONG}, f AS (SELECT eid, CAST(sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS DOUBLE) / {len(A.COLUMNS)} AS missing FROM long GROUP BY 1) SELECT eid, round(missing, 6) AS missing FROM f")
def row_missing(spark, sf_dir):
    return columns.row_missing(A.wide(spark, sf_dir), "eid", A.COLUMNS).withColumn("missing", A.r6(F.col("missing")))


@query(f"WITH {A.LONG} SELECT eid, col, round(value - avg(value) OVER (PARTITION BY col), 6) AS value FROM long WHERE col IN ('101-0.0', '101-0.1') AND value IS NOT NULL")
def demean_columns(spark, sf_dir):
    names = ["101-0.0", "101-0.1"]
    w = columns.demean(A.wide(spark, sf_dir).select("eid", *[F.col(f"`{c}`") for c in names]), names)
    return columns.wide_to_long(w, ["eid"], names, "col").where("value is not null").withColumn("value", A.r6(F.col("value")))


@query()
def explained_variance(spark, sf_dir):
    """How many components reach each share of the variance of the embeddings."""
    shares = [0.25, 0.5, 0.75, 0.9]
    found = linear.components_reaching(linear.fit_pca(A.halves(spark, sf_dir), [f"{v}{i}" for v in "xy" for i in range(32)]), shares)
    return spark.createDataFrame(list(zip(shares, found, strict=True)), "fraction double, components int")


@query()
def component_regression(spark, sf_dir):
    """R2 of a held-out column on the first 1, 2, ... components of all others, fitted on half of the subjects."""
    v = A.halves(spark, sf_dir)
    names = [*[f"x{i}" for i in range(32)], *[f"y{i}" for i in range(1, 32)]]
    scored = linear.pca_scores(v, names, linear.fit_pca(v, names, 5))
    out = linear.regression_scores(scored, [f"PC{k + 1}" for k in range(5)], [], "y0", F.xxhash64("eid") % 2 == 0, cumulative=True)
    return out.select("components", "set_name", F.col("score").alias("r2"))
