"""Queries of column statistics, scalings, aggregates over repetitions and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from varistrata.functions import normal
from varistrata.operators import columns, estimators, results, sampling
from varistrata.plans import adapters as A
from varistrata.plans.registry import query

MEASURES = ["l_quantity", "l_discount", "l_tax"]
LINES = " UNION ALL ".join(f"SELECT '{c}' AS col, {c} AS v FROM lineitem" for c in MEASURES)


@query(f"WITH {A.LONG} SELECT col, round(avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing FROM long GROUP BY 1")
def missing_fraction(spark, sf_dir):
    return columns.missing_fraction(A.wide(spark, sf_dir), A.COLUMNS).select(F.col("column").alias("col"), A.r6(F.col("missing")).alias("missing"))


@query(f"SELECT col, round(max(n) / sum(n), 6) AS mode FROM (SELECT col, v, count(*) AS n FROM ({LINES}) GROUP BY 1, 2) GROUP BY 1")
def mode_fraction(spark, sf_dir):
    return columns.mode_fraction(A.table(spark, sf_dir, "lineitem"), MEASURES).select(F.col("column").alias("col"), A.r6(F.col("mode")).alias("mode"))


TEXTS = {"o_orderstatus": "o_orderstatus", "o_orderpriority": "o_orderpriority", "rare": "CASE WHEN o_orderkey % 10 > 0 THEN 'usual' ELSE o_orderpriority END", "half": "CASE WHEN o_orderkey % 2 = 0 THEN 'x' ELSE concat('y', o_custkey) END", "day": "CASE WHEN o_orderkey % 7 < 5 THEN DATE '1995-01-01' ELSE CAST(o_orderdate AS DATE) END", "wide": "CASE WHEN o_orderkey % 3 > 0 THEN 9007199254740993 ELSE 9007199254740992 + o_custkey % 2 END", "none": "CAST(NULL AS VARCHAR)"}


@query(" UNION ALL ".join(f"SELECT '{c}' AS col, round(max(CASE WHEN v IS NOT NULL THEN CASE WHEN 2 * n > total THEN n / total ELSE 0 END END), 6) AS mode FROM (SELECT v, count(*) AS n, sum(CASE WHEN v IS NOT NULL THEN count(*) END) OVER () AS total FROM (SELECT {x} AS v FROM orders) GROUP BY v)" for c, x in TEXTS.items()))
def majority_fraction(spark, sf_dir):
    """The share of a value that more than half of a column has, of columns of text, dates and large whole numbers."""
    o = A.table(spark, sf_dir, "orders").select(*[F.expr(x.replace("VARCHAR", "string")).alias(c) for c, x in TEXTS.items()])
    return columns.majority_fraction(o, list(TEXTS)).select(F.col("column").alias("col"), A.r6(F.col("mode")).alias("mode"))


CHAIN = {"l_quantity": "l_quantity", "l_extendedprice": "l_extendedprice", "flat": "CASE WHEN l_linenumber < 7 THEN 1.0 ELSE l_tax END", "few": "CASE WHEN l_quantity > 40 THEN l_tax END", "spike": "CASE WHEN l_orderkey = 1 AND l_linenumber = 1 THEN 1e6 ELSE l_quantity END", "large": "l_extendedprice * 100", "empty": "CAST(NULL AS DOUBLE)"}


@query("WITH v AS (" + " UNION ALL ".join(f"SELECT '{c}' AS col, CAST({x} AS DOUBLE) AS x FROM lineitem" for c, x in CHAIN.items()) + """), f AS (SELECT col, x, count(*) AS n FROM v WHERE x IS NOT NULL GROUP BY 1, 2), m AS (SELECT col, max(n) / sum(n) AS mode FROM f GROUP BY 1),
s AS (SELECT col, avg(CASE WHEN x IS NULL THEN 1.0 ELSE 0.0 END) AS missing, max(x) AS largest, quantile_cont(x, 0.5) AS middle FROM v GROUP BY 1), o AS (SELECT col, max(power(x - middle, 2)) / nullif(avg(power(x - middle, 2)), 0) AS outlier FROM v JOIN s USING (col) GROUP BY 1)
SELECT col, CASE WHEN missing >= 0.5 THEN 'missing' WHEN mode IS NULL OR mode >= 0.8 THEN 'mode' WHEN outlier IS NULL OR outlier >= 500 THEN 'outlier' WHEN largest > 1e6 THEN 'largest' ELSE 'kept' END AS state FROM s JOIN o USING (col) LEFT JOIN m USING (col)""")
def column_filter_chain(spark, sf_dir):
    """The four filters one after the other, each on what the one before left."""
    l = A.table(spark, sf_dir, "lineitem").select(*[F.expr(x).cast("double").alias(c) for c, x in CHAIN.items()])  # noqa: E741
    found = columns.find_bad_columns(l, list(CHAIN), missing=0.5, mode=0.8, outlier=500, largest=1e6, prepare=None)
    return spark.createDataFrame([(c, "kept") for c in found.kept] + [(c, why) for why, names in found.dropped.items() for c in names], "col string, state string")


@query("""WITH v AS (SELECT 'value' AS col, value AS x FROM events UNION ALL SELECT 'squared', value * value FROM events), m AS (SELECT col, quantile_cont(x, 0.5) AS m FROM v GROUP BY 1)
SELECT col, round(max((x - m) * (x - m)) / avg((x - m) * (x - m)), 6) AS outlier FROM v JOIN m USING (col) GROUP BY 1""")
def outlier_ratio(spark, sf_dir):
    e = A.table(spark, sf_dir, "events").select("value", (F.col("value") * F.col("value")).alias("squared"))
    return columns.outlier_ratio(e, ["value", "squared"]).select(F.col("column").alias("col"), A.r6(F.col("outlier")).alias("outlier"))


@query("SELECT col FROM (SELECT 'o_totalprice' AS col, max(o_totalprice) AS v FROM orders UNION ALL SELECT 'o_orderkey', max(o_orderkey) FROM orders UNION ALL SELECT 'o_custkey', max(o_custkey) FROM orders) WHERE v > 10000")
def large_value_columns(spark, sf_dir):
    o = A.table(spark, sf_dir, "orders")
    names = ["o_totalprice", "o_orderkey", "o_custkey"]
    found = columns.find_bad_columns(o, names, largest=10_000).dropped["largest"]
    return spark.createDataFrame([(c,) for c in found], "col string")


@query(f"WITH {A.LONG}, m AS (SELECT col, avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) AS f FROM long GROUP BY 1) SELECT col FROM m WHERE f < 0.3")
def column_filter(spark, sf_dir):
    kept = columns.find_bad_columns(A.wide(spark, sf_dir), A.COLUMNS, missing=0.3).kept
    return spark.createDataFrame([(c,) for c in kept], "col string")


@query(f"""WITH {A.LONG} SELECT eid, split_part(col, '.', 1) AS field, round(avg(value), 6) AS mean3, round(stddev_samp(value), 6) AS std3 FROM long GROUP BY 1, 2""")
def row_mean_std(spark, sf_dir):
    """Every field and instance of the wide table."""
    fields = list(dict.fromkeys(c.split(".")[0] for c in A.COLUMNS))
    out = columns.row_means(A.wide(spark, sf_dir), [(f.split("-")[0], [c for c in A.COLUMNS if c.startswith(f"{f}.")]) for f in fields])
    told = [F.struct(F.lit(f).alias("field"), A.r6(F.col(f"`{f}.0_mean3`")).alias("mean3"), A.r6(F.col(f"`{f}.0_std3`")).alias("std3")) for f in fields]
    return out.select("eid", F.inline(F.array(*told)))


@query(f"WITH {A.LONG}, m AS (SELECT eid, CAST(sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS DOUBLE) / {len(A.COLUMNS)} AS f FROM long GROUP BY 1) SELECT CAST(least(floor(f * 21), 20) AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS n FROM m GROUP BY 1")
def na_histogram(spark, sf_dir):
    return columns.histogram(columns.row_missing(A.wide(spark, sf_dir), "eid", A.COLUMNS), "missing").withColumn("bin", F.col("bin").cast("long"))


FEW, MORE = ["100-0.0", "100-0.1"], ["103-2.1", "103-2.2"]


@query(f"""WITH {A.WIDE} SELECT eid, round("100-0.0", 6) AS x, round("103-2.1", 6) AS y FROM wide WHERE coalesce("100-0.0", "100-0.1") IS NOT NULL AND coalesce("103-2.1", "103-2.2") IS NOT NULL""")
def drop_all_null_fixpoint(spark, sf_dir):
    w = A.wide(spark, sf_dir)
    pick = lambda names: w.select("eid", *[F.col(f"`{c}`") for c in names])
    kept, _, _ = columns.drop_empty_rows({"few": pick(FEW), "more": pick(MORE)})
    return kept["few"].join(kept["more"], "eid").select("eid", A.r6(F.col("`100-0.0`")).alias("x"), A.r6(F.col("`103-2.1`")).alias("y"))


@query("SELECT o_orderkey, round((o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / (SELECT stddev_samp(o_totalprice) FROM orders), 6) AS z FROM orders")
def zscore(spark, sf_dir):
    o = A.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return columns.zscore(o, ["o_totalprice"]).select("o_orderkey", A.r6(F.col("o_totalprice")).alias("z"))


@query(f"""WITH {A.WIDE} SELECT eid, round(coalesce("104-3.0", (SELECT avg("104-3.0") FROM wide)), 6) AS x FROM wide""")
def fill_mean(spark, sf_dir):
    w = A.wide(spark, sf_dir).select("eid", F.col("`104-3.0`").alias("x"))
    return columns.fill_mean(w, ["x"]).select("eid", A.r6(F.col("x")).alias("x"))


@query("""SELECT c_custkey, round((c_acctbal - (SELECT quantile_cont(c_acctbal, 0.5) FROM customer)) / (SELECT quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25) FROM customer), 6) AS x FROM customer""")
def robust_scale(spark, sf_dir):
    c = A.table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return columns.robust_scale(c, ["c_acctbal"]).select("c_custkey", A.r6(F.col("c_acctbal")).alias("x"))


@query("""SELECT l_quantity, round((min(r) + max(r)) / 2.0, 6) AS rank, CAST(count(*) AS BIGINT) AS n FROM (SELECT l_quantity, row_number() OVER (ORDER BY l_quantity) AS r FROM lineitem) GROUP BY 1""")
def avg_rank_quantile(spark, sf_dir):
    counts = A.table(spark, sf_dir, "lineitem").groupBy("l_quantity").agg(F.count("*").alias("n"))
    ranked = columns.running_counts(counts.withColumn("column", F.lit("l_quantity")), ["column"], "l_quantity", "n")
    return ranked.select("l_quantity", A.r6((F.col("_upto") - (F.col("n") - 1) / 2).cast("double")).alias("rank"), "n")


@query("SELECT 'c_acctbal' AS col, CAST(count(c_acctbal) AS BIGINT) AS n, min(c_acctbal) AS low, max(c_acctbal) AS high, round(avg(c_acctbal), 6) AS mean, round(stddev_samp(c_acctbal), 6) AS sd, round(quantile_cont(c_acctbal, 0.5), 6) AS middle FROM customer")
def describe_columns(spark, sf_dir):
    d = columns.describe(A.table(spark, sf_dir, "customer"), ["c_acctbal"])
    return d.select(F.col("column").alias("col"), "n", "low", "high", *[A.r6(F.col(c)).alias(c) for c in ("mean", "sd", "middle")])


@query("""WITH g AS (SELECT c_mktsegment, 'c_acctbal' AS col, CAST(NULL AS VARCHAR) AS level, CAST(count(*) AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS percent, round(avg(c_acctbal), 6) AS mean, round(stddev_samp(c_acctbal), 6) AS sd FROM customer GROUP BY 1),
c AS (SELECT c_mktsegment, CAST(c_nationkey AS VARCHAR) AS level, CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY 1, 2)
SELECT * FROM g UNION ALL SELECT c_mktsegment, 'c_nationkey', level, n, round(100.0 * n / sum(n) OVER (PARTITION BY c_mktsegment), 6), NULL, NULL FROM c""")
def cohort_summary(spark, sf_dir):
    out = columns.cohort_summary(A.table(spark, sf_dir, "customer"), ["c_mktsegment"], ["c_acctbal"], ["c_nationkey"])
    return out.select("c_mktsegment", F.col("column").alias("col"), "level", "n", *[A.r6(F.col(c)).alias(c) for c in ("percent", "mean", "sd")])


@query("SELECT CASE WHEN o_totalprice > 300000 THEN o_orderpriority END AS level, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1")
def value_counts(spark, sf_dir):
    o = A.table(spark, sf_dir, "orders").select(F.when(F.col("o_totalprice") > 300000, F.col("o_orderpriority")).alias("p"))
    return columns.value_counts(o, "p")


@query(f"SELECT col FROM (SELECT col, count(DISTINCT v) AS k FROM ({LINES} UNION ALL SELECT 'one', 1 FROM lineitem) GROUP BY 1) WHERE k <= 1")
def constant_columns(spark, sf_dir):
    l = A.table(spark, sf_dir, "lineitem").select(*MEASURES, F.lit(1.0).alias("one"))  # noqa: E741
    return columns.distinct_values(l, [*MEASURES, "one"]).where("kinds <= 1").select(F.col("column").alias("col"))


# Results over repetitions.


@query(f"""WITH {A.RESULTS}, r AS (SELECT sample_size, feature, rep, avg(loading) AS x FROM results GROUP BY ALL)
SELECT CAST(sample_size AS BIGINT) AS sample_size, feature, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(stddev_pop(x), 6) AS std_pop FROM r GROUP BY 1, 2""")
def rep_mean_std(spark, sf_dir):
    """Deviations as of loadings (n - 1) and as of correlations (n)."""
    r = A.results(spark, sf_dir).groupBy("sample_size", "feature", "rep").agg(F.avg("loading").alias("x"))
    keys = ["sample_size", "feature"]
    both = results.mean_std(r, keys, "x", loadings=True).join(results.mean_std(r, keys, "x", loadings=False).select(*keys, F.col("std").alias("std_pop")), keys)
    return both.select(F.col("sample_size").cast("long").alias("sample_size"), "feature", *[A.r6(F.col(c)).alias(c) for c in ("mean", "std", "std_pop")])


@query(f"WITH {A.RESULTS} SELECT CAST(sample_size AS BIGINT) AS sample_size, func, round(x, 6) AS value FROM (SELECT sample_size, avg(loading) AS mean, stddev_samp(loading) AS std, min(loading) AS low FROM results GROUP BY 1) UNPIVOT (x FOR func IN (mean, std, low))")
def summary_functions(spark, sf_dir):
    s = results.summarise(A.results(spark, sf_dir), ["sample_size"], "loading", {"mean": F.avg, "std": F.stddev_samp, "low": F.min})
    return s.select(F.col("sample_size").cast("long").alias("sample_size"), "func", A.r6(F.col("value")).alias("value"))


@query(f"WITH {A.RESULTS} SELECT CAST(sample_size AS BIGINT) AS sample_size, " + ", ".join(f"round(quantile_cont(loading, {q}), 6) AS q{i}" for i, q in enumerate((0.025, 0.975, 0.05, 0.95))) + " FROM results WHERE event_type = 'error' GROUP BY 1")
def null_quantiles(spark, sf_dir):
    null = A.results(spark, sf_dir).where("event_type = 'error'")
    out = results.null_quantiles(null, ["sample_size"], "loading")
    return out.select(F.col("sample_size").cast("long").alias("sample_size"), *[A.r6(F.col(f"q{i}")).alias(f"q{i}") for i in range(4)])


BAND = """band AS (SELECT feature, nullif(low, high) AS low, CASE WHEN low <> high THEN high END AS high FROM (SELECT replace(feature, 'error', 'click') AS feature, quantile_cont(loading, 0.4) AS low, quantile_cont(loading, 0.6) AS high
 FROM results WHERE event_type = 'error' AND sample_size = 400 AND feature <> 'error_2' GROUP BY 1)),
means AS (SELECT sample_size, feature, avg(loading) AS value FROM results WHERE event_type IN ('click', 'view') GROUP BY 1, 2),
filled AS (SELECT sample_size, feature, value, coalesce(low, avg(low) OVER (PARTITION BY sample_size)) AS low, coalesce(high, avg(high) OVER (PARTITION BY sample_size)) AS high FROM means LEFT JOIN band USING (feature))"""


def _masks(spark, sf_dir):
    r = A.results(spark, sf_dir)
    null = r.where("event_type = 'error' and sample_size = 400 and feature != 'error_2'").groupBy(F.regexp_replace("feature", "error", "click").alias("feature"))
    band = null.agg(F.percentile("loading", F.lit(0.4)).alias("low"), F.percentile("loading", F.lit(0.6)).alias("high"))
    means = r.where("event_type in ('click', 'view')").groupBy("sample_size", "feature").agg(F.avg("loading").alias("value"))
    return results.significance_mask(means, band, keys=["sample_size"])


@query(f"WITH {A.RESULTS}, {BAND} SELECT CAST(sample_size AS BIGINT) AS sample_size, feature, round(low, 6) AS low, round(high, 6) AS high, low < value AND value < high AS masked FROM filled")
def mask_significance(spark, sf_dir):
    return _masks(spark, sf_dir).select(F.col("sample_size").cast("long").alias("sample_size"), "feature", A.r6(F.col("low")).alias("low"), A.r6(F.col("high")).alias("high"), "masked")


@query(f"""WITH {A.RESULTS}, {BAND}, s AS (SELECT split_part(feature, '_', 1) AS dataset, min(sample_size) AS s FROM filled WHERE NOT (low < value AND value < high) GROUP BY 1) SELECT 'all' AS subset, CAST(max(s) AS BIGINT) AS sample_size FROM s""")
def first_sig_size(spark, sf_dir):
    masks = _masks(spark, sf_dir).select(F.lit("all").alias("subset"), F.substring_index("feature", "_", 1).alias("dataset"), "sample_size", "masked")
    return results.first_significant(masks, ["subset"]).select("subset", F.col("sample_size").cast("long").alias("sample_size"))


@query("SELECT c_nationkey, c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) - 1 AS BIGINT) AS rank FROM customer")
def ordinal_rank(spark, sf_dir):
    out = results.ordinal_rank(A.table(spark, sf_dir, "customer"), ["c_nationkey"], "c_acctbal", "c_custkey")
    return out.select("c_nationkey", "c_custkey", F.col("rank").cast("long").alias("rank"))


@query("""WITH r AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS d, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS a FROM customer)
SELECT c_nationkey, c_custkey, 'top' AS "end" FROM r WHERE d <= 10 UNION ALL SELECT c_nationkey, c_custkey, 'bottom' FROM r WHERE a <= 10""")
def top_bottom_n(spark, sf_dir):
    return results.top_and_bottom(A.table(spark, sf_dir, "customer"), ["c_nationkey"], "c_acctbal", "c_custkey").select("c_nationkey", "c_custkey", "end")


ALIGN = """l AS (SELECT 'all' AS subset, sample_size, rep, CASE WHEN event_type IN ('view', 'click') THEN 'brain' ELSE 'behavioural' END AS dataset, feature, avg(loading) AS loading FROM results WHERE event_type <> 'error' GROUP BY ALL),
anchor AS (SELECT feature FROM l WHERE sample_size = 400 AND rep = 0 AND dataset = 'brain' ORDER BY abs(loading) DESC, feature DESC LIMIT 1),
sign AS (SELECT sample_size, rep, CASE WHEN loading < 0 THEN -1.0 ELSE 1.0 END AS s FROM l JOIN anchor USING (feature) WHERE dataset = 'brain')"""


@query(f"WITH {A.RESULTS}, {ALIGN} SELECT CAST(sample_size AS BIGINT) AS sample_size, CAST(rep AS BIGINT) AS rep, dataset, feature, round(loading * coalesce(s, 1.0), 6) AS loading FROM l LEFT JOIN sign USING (sample_size, rep)")
def sign_anchor_flip(spark, sf_dir):
    r = A.results(spark, sf_dir).where("event_type != 'error'")
    l = r.groupBy("sample_size", "rep", F.when(F.col("event_type").isin("view", "click"), "brain").otherwise("behavioural").alias("dataset"), "feature").agg(F.avg("loading").alias("loading"))  # noqa: E741
    l = l.select(F.lit("all").alias("subset"), "sample_size", "rep", F.lit("without_cv").alias("cca_type"), F.lit("learn").alias("set_name"), F.lit(1).alias("component"), "dataset", "feature", "loading")  # noqa: E741
    aligned, _ = results.align_signs(l, l.where("sample_size = 400 and rep = 0"))
    return aligned.select(F.col("sample_size").cast("long").alias("sample_size"), F.col("rep").cast("long").alias("rep"), "dataset", "feature", A.r6(F.col("loading")).alias("loading"))


@query(f"""WITH {A.RESULTS}, r AS (SELECT sample_size, rep, avg(CASE WHEN event_type = 'view' THEN loading END) AS x, avg(CASE WHEN event_type = 'click' THEN loading END) AS y FROM results GROUP BY 1, 2)
SELECT CAST(sample_size AS BIGINT) AS sample_size, CAST(rep AS BIGINT) AS rep, round(CASE WHEN x < 0 THEN -x ELSE x END, 6) AS r_learn, round(CASE WHEN x < 0 THEN -y ELSE y END, 6) AS r_val, round(CASE WHEN x < 0 THEN -x + y ELSE x - y END, 6) AS inflation FROM r""")
def inflation(spark, sf_dir):
    pick = lambda t: F.avg(F.when(F.col("event_type") == t, F.col("loading")))
    r = A.results(spark, sf_dir).groupBy("sample_size", "rep").agg(pick("view").alias("r_learn"), pick("click").alias("r_val")).withColumn("cca_type", F.lit("repeated_cv"))
    out = results.with_inflation(results.flip_repeated(r))
    return out.select(F.col("sample_size").cast("long").alias("sample_size"), F.col("rep").cast("long").alias("rep"), *[A.r6(F.col(c)).alias(c) for c in ("r_learn", "r_val", "inflation")])


STATS = """stats AS (SELECT event_type, sample_size, avg(loading) AS mean, stddev_samp(loading) AS std FROM results GROUP BY 1, 2)"""


@query(f"""WITH {A.RESULTS}, {STATS}, nulls AS (SELECT event_type, sample_size, loading / 100 - 2 AS r FROM results),
t AS (SELECT event_type, quantile_cont(r, 0.99) AS threshold FROM nulls WHERE sample_size = 400 GROUP BY 1), s AS (SELECT event_type, sample_size, avg(r / 2 + 1 + sample_size * 0.0015) AS mean, stddev_samp(r / 2 + 1 + sample_size * 0.0015) AS std FROM nulls GROUP BY 1, 2)
SELECT event_type, CAST(min(sample_size) AS BIGINT) AS sample_size, round(min(threshold), 6) AS threshold FROM s JOIN t USING (event_type) WHERE mean > threshold + std GROUP BY 1""")
def first_size_over_null(spark, sf_dir):
    """The 0.99 quantile of the null model at the largest size, and one deviation over it."""
    null = A.results(spark, sf_dir).select("event_type", "sample_size", (F.col("loading") / 100 - 2).alias("r_val"))
    stats = null.withColumn("r", F.col("r_val") / 2 + 1 + F.col("sample_size") * 0.0015).groupBy("event_type", "sample_size").agg(F.avg("r").alias("mean"), F.stddev_samp("r").alias("std"))
    thresholds = results.null_threshold(null, ["event_type"])
    return results.first_size_over(stats, thresholds, ["event_type"]).join(thresholds, "event_type").select("event_type", F.col("sample_size").cast("long").alias("sample_size"), A.r6(F.col("threshold")).alias("threshold"))


@query(f"WITH {A.RESULTS}, {STATS} SELECT event_type, CAST(min(sample_size) AS BIGINT) AS sample_size FROM stats WHERE mean >= 5 GROUP BY 1")
def least_size_reaching(spark, sf_dir):
    stats = A.results(spark, sf_dir).groupBy("event_type", "sample_size").agg(F.avg("loading").alias("mean"))
    return results.least_size_reaching(stats, ["event_type"], 5).select("event_type", F.col("sample_size").cast("long").alias("sample_size"))


@query(f"""WITH {A.RESULTS}, s AS (SELECT sample_size, feature, event_type, rep % 2 AS h, avg(loading) AS v FROM results GROUP BY ALL)
SELECT CAST(a.sample_size AS BIGINT) AS sample_size, feature, round(a.v - b.v, 6) AS value FROM s a JOIN s b USING (sample_size, feature) WHERE a.h = 0 AND b.h = 1""")
def summary_difference(spark, sf_dir):
    r = A.results(spark, sf_dir)
    half = lambda h: r.where(f"rep % 2 = {h}").groupBy("sample_size", "feature").agg(F.avg("loading").alias("value"))
    return results.summary_difference(half(0), half(1), ["sample_size", "feature"]).select(F.col("sample_size").cast("long").alias("sample_size"), "feature", A.r6(F.col("value")).alias("value"))


@query(f"WITH {A.RESULTS}, s AS (SELECT DISTINCT event_type, sample_size FROM results) SELECT event_type, CAST(sample_size AS BIGINT) AS sample_size, CAST(sample_size - lag(sample_size) OVER (PARTITION BY event_type ORDER BY sample_size) AS BIGINT) AS gap FROM s")
def size_lag(spark, sf_dir):
    sizes = A.results(spark, sf_dir).select("event_type", "sample_size").distinct()
    return results.size_gap(sizes, ["event_type"]).select("event_type", F.col("sample_size").cast("long").alias("sample_size"), F.col("gap").cast("long").alias("gap"))


@query(f"""WITH {A.RESULTS}, n AS (SELECT feature, quantile_cont(loading, 0.5) AS q FROM results WHERE event_type = 'error' AND sample_size = 400 GROUP BY 1) SELECT feature, CAST(s AS BIGINT) AS sample_size, round(q, 6) AS q FROM n, (SELECT DISTINCT sample_size AS s FROM results)""")
def largest_null_everywhere(spark, sf_dir):
    r = A.results(spark, sf_dir)
    null = r.where("event_type = 'error'").groupBy("feature", "sample_size").agg(A.r6(F.percentile("loading", F.lit(0.5))).alias("q"))
    return results.use_largest_null(null, r).select("feature", F.col("sample_size").cast("long").alias("sample_size"), "q")


@query(f"WITH {A.KEYED}, m AS (SELECT eid, event_type, " + ", ".join(f"avg(CASE WHEN instance = {i} THEN value END) AS s{i}" for i in range(4)) + " FROM keyed GROUP BY 1, 2) SELECT eid, event_type FROM m WHERE s0 IS NOT NULL AND s1 IS NOT NULL AND s2 IS NOT NULL AND s3 IS NOT NULL")
def complete_rows(spark, sf_dir):
    """Users and event types with values in all instances."""
    wide = columns.long_to_wide(A.keyed_events(spark, sf_dir), ["eid", "event_type"], "instance", "value", [0, 1, 2, 3])
    return wide.na.drop("any").select("eid", "event_type")


@query(f"WITH {A.RESULTS} SELECT event_type, max(abs(loading)) AS limit_value FROM results GROUP BY 1")
def absolute_limits(spark, sf_dir):
    return columns.absolute_limits(A.results(spark, sf_dir), ["event_type"], "loading")


@query("""WITH o AS (SELECT c_custkey AS eid, r, row_number() OVER (PARTITION BY r ORDER BY md5(concat(CAST(c_custkey AS VARCHAR), '-', CAST(r AS VARCHAR))), c_custkey) AS pos FROM customer, (SELECT unnest(range(5)) AS r))
SELECT eid, CAST(r AS BIGINT) AS rep, CAST(pos AS BIGINT) AS pos, pos <= (SELECT count(*) // 2 FROM customer) AS is_in FROM o""")
def hash_sample_split(spark, sf_dir):
    c = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("eid"))
    out = sampling.split_in_out(c, 5, c.count() // 2)
    return out.select("eid", F.col("rep").cast("long").alias("rep"), F.col("pos").cast("long").alias("pos"), "is_in")


@query("""WITH o AS (SELECT c_custkey AS eid, c_nationkey AS g, r, row_number() OVER (PARTITION BY r, c_nationkey ORDER BY md5(concat(CAST(c_custkey AS VARCHAR), '-', CAST(r AS VARCHAR))), c_custkey) AS pos FROM customer, (SELECT unnest(range(3)) AS r)),
q AS (SELECT c_nationkey AS g, count(*) AS n, (SELECT count(*) FROM customer) // 4 * count(*) / CAST((SELECT count(*) FROM customer) AS DOUBLE) AS x FROM customer GROUP BY 1),
k AS (SELECT g, floor(x) AS base, row_number() OVER (ORDER BY floor(x) - x, CAST(g AS VARCHAR)) AS o, (SELECT count(*) FROM customer) // 4 - (SELECT sum(floor(x)) FROM q) AS rest FROM q)
SELECT eid, CAST(r AS BIGINT) AS rep, pos <= base + CASE WHEN k.o <= rest THEN 1 ELSE 0 END AS is_in FROM o JOIN k USING (g)""")
def stratified_split(spark, sf_dir):
    c = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("eid"), F.col("c_nationkey").alias("nation"))
    return sampling.split_in_out(c, 3, c.count() // 4, strata="nation").select("eid", F.col("rep").cast("long").alias("rep"), "is_in")


SIZES = A.SIZES
_MD5 = lambda *parts: f"md5(concat_ws('-', {', '.join(f'CAST({p} AS VARCHAR)' for p in parts)}))"
_NUMBER = lambda *parts: f"CAST('0x' || substr({_MD5(*parts)}, 1, 12) AS BIGINT)"


@query(f"""WITH {SIZES}, places AS (SELECT c_custkey AS eid, r AS rep, row_number() OVER (PARTITION BY r ORDER BY {_MD5('c_custkey', 'r', '3791')}, c_custkey) AS pos FROM customer, (SELECT unnest(range(3)) AS r)),
l AS (SELECT rep, s, eid, row_number() OVER (PARTITION BY rep, s ORDER BY {_MD5('eid', 'rep', 's', "'learn3791'")}, eid) AS draw FROM places, sizes, n WHERE pos <= n // 2),
pool AS (SELECT rep, name, eid, row_number() OVER (PARTITION BY rep, name ORDER BY {_MD5('eid', 'rep', "concat(name, '3791')")}, eid) AS spot, count(*) OVER (PARTITION BY rep, name) AS held FROM (SELECT *, CASE WHEN pos <= n // 2 THEN 'learn' ELSE 'val' END AS name FROM places, n)),
w AS (SELECT rep, s, draw, name, {_NUMBER('rep', 's', 'draw', '3791', 'name')} % held + 1 AS spot FROM (SELECT DISTINCT rep, name, held FROM pool), (SELECT s, unnest(range(1, s + 1)) AS draw FROM sizes))
SELECT 'all' AS subset, CAST(rep AS BIGINT) AS rep, CAST(s AS BIGINT) AS sample_size, 'learn' AS set_name, CAST(draw AS BIGINT) AS draw, eid FROM l WHERE draw <= s
UNION ALL SELECT 'all', rep, NULL, 'val', pos, eid FROM places, n WHERE pos > n // 2 UNION ALL SELECT 'matched', w.rep, s, name, draw, eid FROM w JOIN pool USING (rep, name, spot)""")
def nested_design(spark, sf_dir):
    c = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("eid"))
    n = c.count()
    sizes = sampling.planned_sizes(n, 6, 4)
    out = sampling.design(c, sizes, 3).unionByName(sampling.design(c, sizes, 3, subset="matched", replace=True, match_validation=True))
    return out.select("subset", "set_name", "eid", *[F.col(c).cast("long").alias(c) for c in ("rep", "sample_size", "draw")])


@query(f"""WITH {SIZES}, g AS (SELECT c_nationkey AS g, count(*) AS c, (SELECT n FROM n) AS total, (SELECT n // 2 FROM n) AS inside FROM customer GROUP BY 1), x AS (SELECT *, inside * c / CAST(total AS DOUBLE) AS x FROM g),
q AS (SELECT *, floor(x) + CASE WHEN row_number() OVER (ORDER BY floor(x) - x, CAST(g AS VARCHAR)) <= inside - sum(floor(x)) OVER () THEN 1 ELSE 0 END AS held FROM x),
p AS (SELECT g, 'learn' AS name, held AS m, inside AS whole FROM q UNION ALL SELECT g, 'val', c - held, total - inside FROM q),
y AS (SELECT *, s * m / CAST(sum(m) OVER (PARTITION BY name, s) AS DOUBLE) AS y FROM p, sizes),
z AS (SELECT *, floor(y) + CASE WHEN row_number() OVER (PARTITION BY name, s ORDER BY y - floor(y) DESC, CAST(g AS VARCHAR)) <= s - sum(floor(y)) OVER (PARTITION BY name, s) THEN 1 ELSE 0 END AS k FROM y)
SELECT CAST(r AS BIGINT) AS rep, CAST(s AS BIGINT) AS sample_size, name AS set_name, CAST(g AS BIGINT) AS nation, CAST(k AS BIGINT) AS n FROM z, (SELECT unnest(range(2)) AS r) WHERE k > 0""")
def stratified_design(spark, sf_dir):
    """How many subjects of each nation are in each learning and matched validation sample."""
    c = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("eid"), F.col("c_nationkey").cast("long").alias("nation"))
    out = sampling.design(c.select("eid", "nation"), sampling.planned_sizes(c.count(), 6, 4), 2, strata="nation", match_validation=True)
    counted = out.join(c, "eid").groupBy("rep", "sample_size", "set_name", "nation").agg(F.countDistinct("eid").alias("n"))
    return counted.select(F.col("rep").cast("long").alias("rep"), F.col("sample_size").cast("long").alias("sample_size"), "set_name", "nation", "n")


def ranked_sql(source: str) -> str:
    """col, x, p: values and the shares of their average ranks, from (col, x)."""
    return f"SELECT col, x, ((min(k) + max(k)) / 2.0 - 0.375) / (max(n) + 0.25) AS p FROM (SELECT col, x, row_number() OVER (PARTITION BY col ORDER BY x) AS k, count(*) OVER (PARTITION BY col) AS n FROM ({source})) GROUP BY col, x"


TWO = "SELECT 'l_quantity' AS col, l_quantity AS x FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem"


@query(f"WITH s AS ({ranked_sql(TWO)}) SELECT col, x AS value, round({normal.sql('p')}, 6) AS score FROM ({TWO}) JOIN s USING (col, x)")
def inv_norm(spark, sf_dir):
    l = A.table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice")  # noqa: E741
    out = columns.inverse_normal(columns.wide_to_long(l, [], ["l_quantity", "l_extendedprice"]))
    return out.select(F.col("column").alias("col"), "value", A.r6(F.col("score")).alias("score"))


def quantile_sql(values: str, out: str, most: int = 1000) -> str:
    """CTEs that end in `out`: col, x, z for the distinct values of (col, x) in the table `values`: forward and backward interpolation, clipped."""
    return f"""{out}_q AS (SELECT col, least(count(x), {most}) AS m, quantile_cont(x, [i / {most - 1}.0 FOR i IN range({most})]) AS q, list_sort(list(x)) AS whole FROM {values} WHERE x IS NOT NULL GROUP BY col),
{out}_r AS (SELECT col, m, CASE WHEN m < {most} THEN whole ELSE q END AS q FROM {out}_q),
{out}_p AS (SELECT col, x, m, q, len(list_filter(q, lambda r: r < x)) AS below, len(list_filter(q, lambda r: r <= x)) AS upto FROM (SELECT DISTINCT col, x FROM {values} WHERE x IS NOT NULL) JOIN {out}_r USING (col)),
{out}_u AS (SELECT col, x, least(greatest(CASE WHEN upto = 0 THEN 0 WHEN below = m THEN 1 WHEN upto > below THEN (below + upto - 1) / 2.0 / (m - 1) ELSE (below - 1 + (x - q[below]) / (q[below + 1] - q[below])) / (m - 1) END, 1e-7), 1 - 1e-7) AS u FROM {out}_p),
{out} AS (SELECT col, x, {normal.sql('u')} AS z FROM {out}_u)"""


@query(f"""WITH v AS ({TWO}), {quantile_sql('v', 't')} SELECT l_orderkey, l_linenumber, round(a.z, 4) AS l_quantity, round(b.z, 4) AS l_extendedprice FROM lineitem
JOIN t a ON a.col = 'l_quantity' AND a.x = l_quantity JOIN t b ON b.col = 'l_extendedprice' AND b.x = l_extendedprice""")
def quantile_transform(spark, sf_dir):
    names = ["l_quantity", "l_extendedprice"]
    l = A.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *names)  # noqa: E741
    out = columns.quantile_transform(l, columns.fit_quantiles(l, names))
    return out.select("l_orderkey", "l_linenumber", *[F.round(c, 4).alias(c) for c in names])


@query(f"""WITH v AS ({TWO}), {quantile_sql('v', 't')} SELECT l_orderkey, l_linenumber, round(a.z, 4) AS number, round(l_extendedprice, 4) AS code, round(b.z, 4) AS averaged FROM lineitem
JOIN t a ON a.col = 'l_quantity' AND a.x = l_quantity JOIN t b ON b.col = 'l_extendedprice' AND b.x = l_extendedprice""")
def quantile_by_value_type(spark, sf_dir):
    """Normal scores of the columns whose value type is a number's, and of row means; a column of codes stays as it is."""
    given = {"l_quantity": "1-0.0", "l_extendedprice": "2-0.0"}
    l = A.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[F.col(c).alias(n) for c, n in given.items()], F.col("l_extendedprice").alias("2-0.0_mean3"))  # noqa: E741
    out = estimators.QuantileNormal({"1-0.0": 31, "2-0.0": 21}).fit_transform(l, ["1-0.0", "2-0.0", "2-0.0_mean3"])
    return out.select("l_orderkey", "l_linenumber", *[F.round(F.col(f"`{c}`"), 4).alias(n) for c, n in (("1-0.0", "number"), ("2-0.0", "code"), ("2-0.0_mean3", "averaged"))])


OUTLIER = "m AS (SELECT col, quantile_cont(z, 0.5) AS m FROM {0} GROUP BY 1) SELECT col, round(max((z - m) * (z - m)) / avg((z - m) * (z - m)), 4) AS outlier FROM {0} JOIN m USING (col) GROUP BY 1"


def _outliers(spark, sf_dir, prepare: str):
    found = columns.outlier_ratio(A.table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"], prepare)
    return found.select(F.col("column").alias("col"), F.round("outlier", 4).alias("outlier"))


@query(f"WITH s AS ({ranked_sql(TWO)}), i AS (SELECT col, {normal.sql('p')} AS y FROM ({TWO}) JOIN s USING (col, x)), z AS (SELECT col, (y - avg(y) OVER (PARTITION BY col)) / stddev_samp(y) OVER (PARTITION BY col) AS z FROM i), {OUTLIER.format('z')}")
def outlier_ranks(spark, sf_dir):
    """Normal scores, z-scores, then the ratio: the statistic of cleaning."""
    return _outliers(spark, sf_dir, "ranks")


@query(f"WITH z AS (SELECT col, (x - avg(x) OVER (PARTITION BY col)) / stddev_pop(x) OVER (PARTITION BY col) AS z FROM ({TWO})), {OUTLIER.format('z')}")
def outlier_standard(spark, sf_dir):
    return _outliers(spark, sf_dir, "standard")


@query(f"WITH v AS (SELECT col, (x - avg(x) OVER (PARTITION BY col)) / stddev_pop(x) OVER (PARTITION BY col) AS x FROM ({TWO})), {quantile_sql('v', 't')}, z AS (SELECT col, z FROM v JOIN t USING (col, x)), {OUTLIER.format('z')}")
def outlier_quantiles(spark, sf_dir):
    """Standardised, then by quantiles: the other order, of the selection of features."""
    return _outliers(spark, sf_dir, "quantiles")


_TIMES = " + ".join(f"CASE WHEN x >= '{t}' THEN 1 ELSE 0 END" for t in results.poisson_thresholds())


@query(f"""WITH {A.RESULTS}, h AS (SELECT sample_size, event_type, loading, b, md5(concat('3791-', event_id, '-', b)) AS h FROM results, (SELECT unnest(range(25)) AS b)),
e AS (SELECT sample_size, event_type, loading, b * 8 + i AS draw, substr(h, 4 * i + 1, 4) AS x FROM h, (SELECT unnest(range(8)) AS i)), w AS (SELECT *, {_TIMES} AS w FROM e),
m AS (SELECT sample_size, event_type, draw, sum(w * loading) / sum(w) AS m FROM w WHERE w > 0 GROUP BY ALL)
SELECT CAST(sample_size AS BIGINT) AS sample_size, event_type, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m GROUP BY 1, 2""")
def bootstrap_ci(spark, sf_dir):
    out = results.bootstrap_intervals(A.results(spark, sf_dir), ["sample_size", "event_type"], "loading", draws=200, row="event_id")
    return out.select(F.col("sample_size").cast("long").alias("sample_size"), "event_type", A.r6(F.col("low")).alias("low"), A.r6(F.col("high")).alias("high"))
