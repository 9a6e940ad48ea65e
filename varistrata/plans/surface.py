"""Queries of what surrounds the statistics: files, metadata, keyed results, samples, estimators and fitted models."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varistrata.functions import kernels
from varistrata.operators import catalog, cohort, columns, estimators, experiment, linear, results, sampling, stages
from varistrata.plans import adapters as A
from varistrata.plans import registry
from varistrata.plans.registry import query
from varistrata.sources import scratch, tables
from varistrata.streaming import ingest


def _folder(spark) -> str:
    return f"{scratch.scratch_folder(spark)}/files-{uuid.uuid4().hex}"


def _long(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def _numbered(df: DataFrame) -> DataFrame:
    """The rows of a small ordered table (a bounded report) with their place."""
    return df.coalesce(1).withColumn("place", F.monotonically_increasing_id())


# Files.


@query("SELECT c_custkey, c_name, round(c_acctbal, 2) AS c_acctbal FROM customer")
def csv_load(spark, sf_dir):
    path = _folder(spark) + "/customer.csv"
    A.table(spark, sf_dir, "customer").write.csv(path, header=True)
    return _long(tables.load_table(spark, path, ["c_custkey", "c_name", "c_acctbal"]), "c_custkey").withColumn("c_acctbal", F.round("c_acctbal", 2))


@query("SELECT p_partkey AS field_id, concat(p_name, ' \"', p_type, '\", x') AS title FROM part")
def tsv_load(spark, sf_dir):
    """A dictionary with quoted titles."""
    path = _folder(spark) + "/field.tsv"
    made = A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("field_id"), F.concat("p_name", F.lit(' "'), "p_type", F.lit('", x')).alias("title"))
    made.write.csv(path, header=True, sep="\t", escape='"')
    return tables.load_table(spark, path, schema="field_id long, title string")


@query("SELECT s_suppkey AS eid, CAST(s_nationkey AS VARCHAR) AS \"21-0.0_a\", concat(s_name, ', \"x\"') AS \"31-0.0_b\" FROM supplier")
def encoded_load(spark, sf_dir):
    """Files with two header rows each and quoted fields."""
    path = _folder(spark)
    s = A.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("k"), F.col("s_nationkey").cast("string").alias("a"), F.concat(F.lit('"'), "s_name", F.lit(', ""x"""')).alias("b"))
    body = s.select(F.pmod(F.xxhash64("k"), F.lit(3)).alias("part"), F.concat_ws(",", "k", "a", "b").alias("line")).groupBy("part").agg(F.concat_ws("\n", F.sort_array(F.collect_list("line"))).alias("lines"))
    body.select(F.concat(F.lit("eid,21-0.0,31-0.0\n,21-0.0_a,31-0.0_b\n"), "lines").alias("value")).repartition(3, "value").write.text(path)
    return tables.load_encoded(spark, path)[0]


@query("SELECT o_custkey AS eid, o_totalprice FROM orders WHERE o_totalprice > 100000")
def write_subset(spark, sf_dir):
    """Project, change row by row, write into a folder that isn't there yet, read."""
    path = _folder(spark) + "/deep/er/orders.parquet"
    o = A.table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "eid")
    tables.write_subset(o, path, ["o_totalprice"], lambda d: d.where("o_totalprice > 100000"))
    return tables.load_table(spark, path)


@query("SELECT c_custkey AS eid, c_acctbal * 2 AS c_acctbal FROM customer WHERE c_acctbal > 0")
def stream_append(spark, sf_dir):
    """New files as a stream: chunk by chunk, appended."""
    folder = _folder(spark)
    c = A.table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "eid")
    c.repartition(4).write.parquet(f"{folder}/in")
    chunks = ingest.read_chunks(spark, f"{folder}/in", c.schema, files_at_once=2)
    ingest.append_subset(chunks, f"{folder}/out", f"{folder}/state", ["c_acctbal"], lambda d: d.where("c_acctbal > 0").withColumn("c_acctbal", F.col("c_acctbal") * 2)).awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@query("WITH e AS (SELECT CASE WHEN value > 12 THEN value END AS high, CASE WHEN event_id % 3 > 0 THEN event_type END AS kind, ts FROM events) SELECT 'high' AS col, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN high IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing FROM e UNION ALL SELECT 'kind', count(*), round(avg(CASE WHEN kind IS NULL THEN 1.0 ELSE 0.0 END), 6) FROM e UNION ALL SELECT 'ts', count(*), 0 FROM e")
def running_missing(spark, sf_dir):
    """Shares of missing values of columns of several types, as chunks of a stream come in."""
    folder = _folder(spark)
    e = A.table(spark, sf_dir, "events").select(F.when(F.col("value") > 12, F.col("value")).alias("high"), F.when(F.col("event_id") % 3 > 0, F.col("event_type")).alias("kind"), "ts")
    e.repartition(5).write.parquet(f"{folder}/in")
    ingest.keep_missing(ingest.read_chunks(spark, f"{folder}/in", e.schema, files_at_once=2), ["high", "kind", "ts"], f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select(F.col("column").alias("col"), "n", A.r6(F.col("missing")).alias("missing"))


@query("""SELECT n_name AS name, concat(n_name, '-clean.csv') AS clean, concat('a/', n_name, '-new.csv') AS suffixed, concat('samples-', n_name, '-', n_nationkey + 1, 'reps-2sizes_5-50-stratified.parquet') AS sample,
concat('PCs_20_20/', n_name, '-null_model/sample_size_', n_nationkey + 50, '/sample_size_', n_nationkey + 50, '-rep3.parquet') AS result FROM nation""")
def file_names(spark, sf_dir):
    """Names of data, designs and results for each row, as columns."""
    name, number = F.col("n_name"), F.col("n_nationkey")
    sample = tables.design_name(name, number + 1, F.array(F.lit(5), F.lit(50)), stratified=True)
    result = tables.result_name((20, 20), name, number + 50, F.lit(3), null_model=True)
    return A.table(spark, sf_dir, "nation").select(name.alias("name"), tables.data_name(name, clean=True).alias("clean"), tables.with_suffix(F.concat(F.lit("a/"), name, F.lit(".csv")), "-new").alias("suffixed"), sample.alias("sample"), result.alias("result"))


@query(f"""WITH {A.RESULTS} SELECT DISTINCT concat('PCs_20_20/', event_type, CASE WHEN rep % 2 = 1 THEN '-null_model' ELSE '' END, '/sample_size_', sample_size, '/sample_size_', sample_size, '-rep', rep, '.parquet') AS path, CAST(sample_size AS BIGINT) AS sample_size, CAST(rep AS BIGINT) AS rep FROM results""")
def unit_files(spark, sf_dir):
    """The file of each unit of a grid, named from its columns and found again by its name."""
    units = A.results(spark, sf_dir).select(tables.result_name((20, 20), F.col("event_type"), F.col("sample_size"), F.col("rep"), F.col("rep") % 2 == 1).alias("path")).distinct()
    return _long(tables.find_results(units), "sample_size", "rep")


@query(f"WITH {A.RESULTS} SELECT event_type AS subset, false AS null_model, CAST(sample_size AS BIGINT) AS sample_size, feature, loading FROM results")
def result_layout(spark, sf_dir):
    """One folder for each subset, model and size."""
    path = _folder(spark)
    r = A.results(spark, sf_dir).select(F.col("event_type").alias("subset"), F.lit(False).alias("null_model"), "sample_size", "feature", "loading")
    tables.write_results(r, path)
    return _long(spark.read.parquet(path), "sample_size").withColumn("null_model", F.col("null_model").cast("boolean"))


CORRS = "corrs AS (SELECT event_type AS subset, CASE WHEN array_index = 0 THEN 'without_cv' ELSE 'repeated_cv' END AS cca_type, (instance + 1) * 100 AS sample_size, eid % 20 AS rep, avg(value) - 15 AS corr FROM keyed GROUP BY ALL)"


def _corrs(spark, sf_dir):
    k = A.keyed_events(spark, sf_dir)
    kind = F.when(F.col("array_index") == 0, "without_cv").otherwise("repeated_cv")
    return k.groupBy(F.col("event_type").alias("subset"), kind.alias("cca_type"), ((F.col("instance") + 1) * 100).alias("sample_size"), (F.col("eid") % 20).alias("rep")).agg((F.avg("value") - 15).alias("corr"))


@query(f"WITH {A.KEYED}, {CORRS} SELECT subset, cca_type, CAST(sample_size AS BIGINT) AS sample_size, CAST(rep AS BIGINT) AS rep, round(corr, 6) AS corr FROM corrs")
def long_csv(spark, sf_dir):
    path = _folder(spark) + "/corrs.csv"
    tables.write_long_csv(_corrs(spark, sf_dir), path, ["subset", "cca_type", "sample_size", "rep"])
    return tables.load_table(spark, path, schema="subset string, cca_type string, sample_size long, rep long, corr double").withColumn("corr", A.r6(F.col("corr")))


@query(f"WITH {A.KEYED}, {CORRS} SELECT subset, cca_type, CAST(sample_size AS BIGINT) AS sample_size, CAST(rep AS BIGINT) AS rep, CAST(row_number() OVER (ORDER BY subset, cca_type, sample_size, rep) - 1 AS BIGINT) AS place FROM corrs")
def correlation_order(spark, sf_dir):
    return _long(results.correlation_table(_corrs(spark, sf_dir), "place"), "sample_size", "rep").drop("corr")


@query("""WITH p AS (SELECT DISTINCT concat('x/sample_size_', c_nationkey * 10 + 50, '-rep', c_custkey % 40, '.parquet') AS path, c_nationkey * 10 + 50 AS s, c_custkey % 40 AS r FROM customer)
SELECT path, CAST(s AS BIGINT) AS sample_size, CAST(r AS BIGINT) AS rep, CAST(row_number() OVER (ORDER BY s DESC, r, path) - 1 AS BIGINT) AS place FROM p ORDER BY s DESC, r, path LIMIT 400""")
def result_order(spark, sf_dir):
    """Largest size first, 400 at most, as for a trial run."""
    c = A.table(spark, sf_dir, "customer")
    paths = c.select(F.concat(F.lit("x/sample_size_"), (F.col("c_nationkey") * 10 + 50).cast("string"), F.lit("-rep"), (F.col("c_custkey") % 40).cast("string"), F.lit(".parquet")).alias("path")).distinct()
    return _long(_numbered(tables.find_results(paths, limit=400)), "sample_size", "rep")


@query(f"WITH {A.RESULTS} SELECT CAST(rep AS BIGINT) AS rep, " + ", ".join(f"round(avg(CASE WHEN feature = '{t}_{i}' AND sample_size = 400 THEN loading END), 6) AS {t}_{i}" for t in A.EVENT_TYPES for i in range(3)) + " FROM results WHERE sample_size = 400 GROUP BY 1")
def repetition_matrix(spark, sf_dir):
    r = A.results(spark, sf_dir).where("sample_size = 400").groupBy("rep", "feature").agg(A.r6(F.avg("loading")).alias("loading"))
    return _long(results.repetition_matrix(r, [f"{t}_{i}" for t in A.EVENT_TYPES for i in range(3)]), "rep")


@query("SELECT DISTINCT c_mktsegment AS subset, what, CASE what WHEN 'schema' THEN '/else' ELSE concat('/study/', c_mktsegment, '/', what) END AS path FROM customer, (SELECT unnest(['data', 'schema', 'samples', 'results', 'figures']) AS what)")
def study_paths(spark, sf_dir):
    """The folders of a study for each segment of customers, one of them shared by all."""
    segments = A.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("subset")).distinct()
    folders = tables.study_folders(F.concat(F.lit("/study/"), "subset", F.lit("//")), tables.Paths(schema="/else"))
    return segments.select("subset", F.inline(folders))


# Heatmaps.

SIZES = (100, 200, 300, 400)
HEAT = f"""{A.RESULTS}, m AS (SELECT feature, sample_size, avg(loading) AS v, stddev_samp(loading) AS s FROM results WHERE event_type <> 'error' GROUP BY 1, 2),
b AS (SELECT feature, nullif(lo, hi) AS lo, nullif(hi, lo) AS hi FROM (SELECT replace(feature, 'error', 'click') AS feature, quantile_cont(loading, 0.4) AS lo, quantile_cont(loading, 0.6) AS hi FROM results WHERE event_type = 'error' AND sample_size = 400 GROUP BY 1)),
f AS (SELECT feature, sample_size, v, s, coalesce(lo, avg(lo) OVER (PARTITION BY sample_size)) AS lo, coalesce(hi, avg(hi) OVER (PARTITION BY sample_size)) AS hi FROM m LEFT JOIN b USING (feature))"""


def _heat(spark, sf_dir):
    r = A.results(spark, sf_dir)
    stats = r.where("event_type != 'error'").groupBy("feature", "sample_size")
    null = r.where("event_type = 'error' and sample_size = 400").groupBy(F.regexp_replace("feature", "error", "click").alias("feature")).agg(F.percentile("loading", F.lit(0.4)).alias("low"), F.percentile("loading", F.lit(0.6)).alias("high"))
    return results.heatmap_tables(stats.agg(F.avg("loading").alias("value")), stats.agg(F.stddev_samp("loading").alias("value")), null, SIZES)


def _cells(what: str) -> str:
    return f"WITH {HEAT} SELECT feature, " + ", ".join(f"max(CASE WHEN sample_size = {s} THEN {what} END) AS s{s}" for s in SIZES) + " FROM f GROUP BY 1"


def _shown(table: DataFrame, change=lambda c: c) -> DataFrame:
    return table.select("feature", *[change(F.col(f"`{s}`")).alias(f"s{s}") for s in SIZES])


@query(_cells("round(abs(v), 6)"))
def heatmap_magnitude(spark, sf_dir):
    return _shown(_heat(spark, sf_dir)["mag"], A.r6)


@query(_cells("lo < v AND v < hi"))
def heatmap_mask(spark, sf_dir):
    return _shown(_heat(spark, sf_dir)["mask"])


@query(_cells("round(s, 6)"))
def heatmap_deviation(spark, sf_dir):
    return _shown(_heat(spark, sf_dir)["std"], A.r6)


@query(f"WITH {HEAT} SELECT feature, CAST(row_number() OVER (ORDER BY abs(v) DESC, feature) - 1 AS BIGINT) AS place FROM f WHERE sample_size = 400")
def heatmap_order(spark, sf_dir):
    return results.by_largest_size(_heat(spark, sf_dir)["mag"], SIZES, place="place").select("feature", "place")


# Metadata.


@query(f"WITH {A.CATALOGUE}, {A.UDIS} SELECT udi FROM udis WHERE field_id NOT IN (SELECT field_id FROM field WHERE value_type = 41)")
def udi_reject(spark, sf_dir):
    fields = catalog.filter_by_value_type(A.catalogue(spark, sf_dir), "text")
    return catalog.filter_by_field(A.udi_table(spark, sf_dir), fields, keep=False).select("udi")


CATEGORY = "category AS (SELECT CAST(n_nationkey AS BIGINT) AS category_id, n_name AS title FROM nation), merged AS (SELECT udi, field_id, f.title, main_category, value_type, c.title AS title_category FROM udis JOIN field f USING (field_id) JOIN category c ON main_category = category_id)"


def _merged(spark, sf_dir):
    categories = A.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("category_id"), F.col("n_name").alias("title"))
    return catalog.merged_catalog(A.udi_table(spark, sf_dir), A.catalogue(spark, sf_dir), categories), categories


@query(f"WITH {A.CATALOGUE}, {A.UDIS}, {CATEGORY} SELECT udi FROM merged WHERE main_category IN (12, 15) AND value_type NOT IN (21, 22)")
def category_udis(spark, sf_dir):
    merged, _ = _merged(spark, sf_dir)
    chosen = catalog.udis_of_category(merged, [12, 15])
    return catalog.udis_of_value_type(merged, "categorical", keep=False, udis=chosen.select("udi")).select("udi")


@query(f"WITH {A.CATALOGUE}, {A.UDIS}, {CATEGORY} SELECT DISTINCT CAST(main_category AS BIGINT) AS main_category, title_category, (SELECT title FROM category WHERE category_id = 3) AS third FROM merged")
def catalog_lookup(spark, sf_dir):
    merged, categories = _merged(spark, sf_dir)
    return catalog.categories_of_udis(merged, merged.select("udi")).withColumn("third", F.lit(catalog.category_title(categories, 3)))


@query(f"WITH {A.CATALOGUE} SELECT field_id, title, CAST(value_type AS BIGINT) AS value_type FROM field WHERE field_id IN (2, 7, 19)")
def field_lookup(spark, sf_dir):
    return _long(catalog.field_info(A.catalogue(spark, sf_dir), [2, 7, 19]).select("field_id", "title", "value_type"), "value_type")


@query(f"""WITH RECURSIVE {A.TREE}, seen AS (SELECT 110::BIGINT AS c, 0 AS d UNION ALL SELECT child_id, d + 1 FROM seen JOIN tree ON parent_id = c WHERE d < 8), {A.LONG},
own AS (SELECT 100 AS f, 110 AS c UNION ALL SELECT 101, 5 UNION ALL SELECT 102, 110 UNION ALL SELECT 103, 9999 UNION ALL SELECT 104, 14)
SELECT eid, col, round(value, 6) AS value FROM long WHERE split_part(col, '-', 2) LIKE '2.%' AND CAST(split_part(col, '-', 1) AS INTEGER) IN (SELECT f FROM own WHERE c IN (SELECT c FROM seen)) AND value IS NOT NULL""")
def domain_select(spark, sf_dir):
    """A named domain as one call: categories, instances, columns, writing."""
    fields = spark.createDataFrame([(100, "a", 31, 110), (101, "b", 31, 5), (102, "c", 31, 110), (103, "d", 31, 9999), (104, "e", 31, 14)], "field_id int, title string, value_type int, main_category long")
    path = _folder(spark) + "/viprs.parquet"
    recommended = spark.createDataFrame([], "category_id long, field_id int")
    settings, _ = catalog.select_domain("viprs", A.wide(spark, sf_dir), path, fields, A.category_tree(spark, sf_dir), recommended)
    chosen = settings["columns"]
    return columns.wide_to_long(tables.load_table(spark, path), ["eid"], chosen, "col").where("value is not null").withColumn("value", A.r6(F.col("value")))


@query(f"WITH {A.LONG} SELECT eid, col, round(value, 6) AS value FROM long WHERE col LIKE '104-%' AND value IS NOT NULL AND eid IN (SELECT eid FROM wide WHERE coalesce(" + ", ".join(f'\"{c}\"' for c in A.COLUMNS if not c.startswith("104-")) + ") IS NOT NULL)")
def holdout_split(spark, sf_dir):
    """Columns of one field held out of a domain while it is cleaned."""
    held = [c for c in A.COLUMNS if c.startswith("104-")]
    _, others, _ = columns.clean({"behavioural": A.wide(spark, sf_dir)}, {"behavioural": columns.CleaningPlan(holdout=held)})
    return columns.wide_to_long(others["holdout_behavioural"], ["eid"], held, "col").where("value is not null").withColumn("value", A.r6(F.col("value")))


@query("SELECT c_custkey AS eid, c_acctbal, CAST(r AS BIGINT) AS draw FROM customer, (SELECT unnest([1, 2]) AS r) WHERE c_nationkey = 3")
def rows_of_sample(spark, sf_dir):
    """The rows of a sample's keys, a key drawn twice comes twice."""
    c = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("eid"), "c_acctbal", "c_nationkey")
    sample = c.where("c_nationkey = 3").select("eid", F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("draw"))
    return cohort.select_rows(c, sample).select("eid", "c_acctbal", "draw")


@query("SELECT c_custkey AS eid, c_acctbal AS demo__balance FROM customer WHERE c_acctbal > 5000")
def cohort_filter(spark, sf_dir):
    demo = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("eid"), F.col("c_acctbal").alias("balance"))
    return cohort.build_study({"demo": demo}).filter(lambda d: d["demo__balance"] > 5000).frame


@query("""SELECT coalesce(a.eid, b.eid, c.eid) AS eid, x, y, z FROM (SELECT c_custkey AS eid, c_acctbal AS x FROM customer WHERE c_acctbal > 0) a FULL JOIN (SELECT c_custkey AS eid, c_name AS y FROM customer WHERE c_nationkey < 20) b ON a.eid = b.eid
FULL JOIN (SELECT o_custkey AS eid, CAST(count(*) AS BIGINT) AS z FROM orders GROUP BY 1) c ON coalesce(a.eid, b.eid) = c.eid""")
def extracts_joined(spark, sf_dir):
    c = A.table(spark, sf_dir, "customer")
    a = c.where("c_acctbal > 0").select(F.col("c_custkey").alias("eid"), F.col("c_acctbal").alias("x"))
    b = c.where("c_nationkey < 20").select(F.col("c_custkey").alias("eid"), F.col("c_name").alias("y"))
    return cohort.join_extracts([a, b, A.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("eid")).agg(F.count("*").alias("z"))])


@query("SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS who, o_totalprice AS price FROM orders UNION ALL SELECT l_orderkey, NULL, l_extendedprice FROM lineitem")
def concat_rows(spark, sf_dir):
    """Tables under one another; a column that one lacks is NULL there."""
    o = A.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("who"), F.col("o_totalprice").alias("price"))
    l = A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_extendedprice").alias("price"))  # noqa: E741
    return columns.concat([o, l])


# Keyed results.


@query("SELECT r_name AS region, CAST(k AS VARCHAR) AS nation, kind, CAST(r_regionkey * 10 + k + CASE kind WHEN 'a' THEN 0 ELSE 100 END AS BIGINT) AS value FROM region, (SELECT unnest([0, 1, 2]) AS k), (SELECT unnest(['a', 'b']) AS kind)")
def nested_items(spark, sf_dir):
    """A nested mapping as rows."""
    key = F.col("r_regionkey") * 10
    held = F.create_map(*[x for k in range(3) for x in (F.lit(str(k)), F.create_map(F.lit("a"), (key + k).cast("long"), F.lit("b"), (key + k + 100).cast("long")))])
    regions = A.table(spark, sf_dir, "region").select(F.col("r_name").alias("region"), held.alias("held"))
    return results.nested_frame(regions, "held", ["nation", "kind"])


STATUSES, PRIORITIES = ("F", "O", "P"), ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query(f"""SELECT o_custkey, status, priority, CAST(count(*) FILTER (WHERE o_orderstatus = status AND o_orderpriority = priority) AS BIGINT) AS n
FROM orders, (SELECT unnest({list(STATUSES)}) AS status), (SELECT unnest({list(PRIORITIES)}) AS priority) GROUP BY ALL""")
def nested_counts(spark, sf_dir):
    """Counts of each customer's orders as maps of status and priority, and as rows again."""
    cells = [[F.count(F.when((F.col("o_orderstatus") == s) & (F.col("o_orderpriority") == p), 1)) for p in PRIORITIES] for s in STATUSES]
    maps = [x for s, row in zip(STATUSES, cells, strict=True) for x in (F.lit(s), F.create_map(*[y for p, n in zip(PRIORITIES, row, strict=True) for y in (F.lit(p), n)]))]
    held = A.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.create_map(*maps).alias("held"))
    return results.nested_frame(held, "held", ["status", "priority"], "n")


def _nested(spark, sf_dir):
    return results.Nested(_long(A.results(spark, sf_dir), "sample_size", "rep").select("event_type", "sample_size", "rep", F.col("loading").alias("value")), ("event_type", "sample_size", "rep"))


@query(f"WITH {A.RESULTS} SELECT CAST(rep AS BIGINT) AS rep, round(loading, 6) AS value FROM results WHERE event_type = 'click' AND sample_size = 200")
def nested_slice(spark, sf_dir):
    return _nested(spark, sf_dir).under("click", 200).frame.withColumn("value", A.r6(F.col("value")))


@query(f"""WITH {A.RESULTS}, x AS (SELECT event_type, sample_size, rep, loading AS v FROM results WHERE NOT (event_type = 'click' AND sample_size = 200 AND rep = 3) UNION ALL SELECT 'click', 200, 3, 7.5 UNION ALL SELECT 'click', 200, 4, 1.25)
SELECT event_type, CAST(sample_size AS BIGINT) AS sample_size, CAST(rep AS BIGINT) AS rep, CAST(count(*) AS BIGINT) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM x GROUP BY 1, 2, 3""")
def nested_apply(spark, sf_dir):
    """A value set, one appended, and functions over all keys."""
    changed = _nested(spark, sf_dir).put(("click", 200, 3), 7.5).append(("click", 200, 4), 1.25)
    out = changed.apply({"n": F.count, "mean": F.avg, "std": F.stddev_pop})
    return out.withColumns({c: A.r6(F.col(c)) for c in ("mean", "std")})


@query(f"""WITH {A.RESULTS}, x AS (SELECT event_type, sample_size, rep, CASE WHEN event_id % 11 > 0 THEN loading END AS v FROM results), t AS (SELECT event_type, sample_size, rep, 'spread' AS func, CASE WHEN count(v) = count(*) THEN mad(v) END AS value FROM x GROUP BY ALL
UNION ALL SELECT event_type, sample_size, rep, 'middle', median(v) FROM x GROUP BY ALL UNION ALL SELECT event_type, sample_size, rep, 'range', max(v) - min(v) FROM x GROUP BY ALL)
SELECT event_type, CAST(sample_size AS BIGINT) AS sample_size, CAST(rep AS BIGINT) AS rep, func, round(value, 6) AS value FROM t""")
def functions_under_keys(spark, sf_dir):
    """Functions of Python over the list under each key: one that a missing value makes missing, one for pandas only, one of numpy."""
    r = A.results(spark, sf_dir).withColumn("loading", F.when(F.col("event_id") % 11 > 0, F.col("loading")))
    held = results.Nested(r, ("event_type", "sample_size", "rep"), "loading")
    found = held.apply_any({"spread": lambda v: np.median(np.abs(v - np.median(v))), "middle": lambda v: v.median(skipna=True), "range": lambda v: np.nanmax(v) - np.nanmin(v) if np.isfinite(v).any() else None}, order=["event_id"])
    return _long(found.frame, "sample_size", "rep").select("event_type", "sample_size", "rep", "func", A.r6(F.col("loading")).alias("value"))


@query(f"WITH {A.KEYED} SELECT eid, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM keyed GROUP BY 1")
def list_stats(spark, sf_dir):
    lists = A.keyed_events(spark, sf_dir).groupBy("eid").agg(F.collect_list("value").alias("values"))
    return lists.select("eid", A.r6(results.list_mean("values")).alias("mean"), A.r6(results.list_std("values")).alias("std"))


@query(f"WITH {A.RESULTS}, m AS (SELECT sample_size, array_index_of AS component, avg(loading) AS corr FROM (SELECT *, CAST(right(feature, 1) AS INTEGER) + 1 AS array_index_of FROM results) GROUP BY 1, 2) SELECT CAST(sample_size AS BIGINT) AS sample_size, CAST(component AS BIGINT) AS component, round(corr * CASE component WHEN 1 THEN 0.5 WHEN 2 THEN -1 ELSE 2 END, 6) AS corr FROM m")
def multiplied_correlations(spark, sf_dir):
    m = A.results(spark, sf_dir).groupBy("sample_size", (F.substring("feature", -1, 1).cast("int") + 1).alias("component")).agg(F.avg("loading").alias("corr"))
    return _long(results.multiply_correlations(m, [0.5, -1, 2]), "sample_size", "component").withColumn("corr", A.r6(F.col("corr")))


@query(f"WITH {A.RESULTS} SELECT CAST(sample_size AS BIGINT) AS sample_size, feature, round(avg(loading), 6) AS mean, round(quantile_cont(loading, 0.5), 6) AS median, round(max(loading), 6) AS top FROM results GROUP BY 1, 2")
def ensembles(spark, sf_dir):
    """Scores of several models as one: by name, and by a function."""
    r, keys = A.results(spark, sf_dir), ["sample_size", "feature"]
    parts = [results.ensemble_scores(r, keys, "loading", m).withColumnRenamed("loading", n) for m, n in (("mean", "mean"), ("nanmedian", "median"), (F.max, "top"))]
    out = parts[0].join(parts[1], keys).join(parts[2], keys)
    return _long(out, "sample_size").withColumns({c: A.r6(F.col(c)) for c in ("mean", "median", "top")})


@query(f"WITH {A.KEYED}, {CORRS} SELECT concat(subset, '-', cca_type) AS subset_cca_type, subset = 'click' AS is_ref, CAST(count(*) AS BIGINT) AS n FROM corrs GROUP BY 1, 2")
def subset_labels(spark, sf_dir):
    return results.mark_reference(results.subset_label(_corrs(spark, sf_dir)), "subset", "click").groupBy("subset_cca_type", "is_ref").agg(F.count("*").alias("n"))


@query(f"WITH {HEAT} SELECT feature, CAST(sample_size AS BIGINT) AS sample_size, v > hi OR v < lo AS significant FROM f")
def significant_loadings(spark, sf_dir):
    r = A.results(spark, sf_dir)
    means = r.where("event_type != 'error'").groupBy("feature", "sample_size").agg(F.avg("loading").alias("value"))
    null = r.where("event_type = 'error' and sample_size = 400").groupBy(F.regexp_replace("feature", "error", "click").alias("feature")).agg(F.percentile("loading", F.lit(0.4)).alias("low"), F.percentile("loading", F.lit(0.6)).alias("high"))
    bounds = results.significance_mask(means, null, keys=["sample_size"])
    return _long(bounds.select("feature", "sample_size", results.significant("value", "low", "high").alias("significant")), "sample_size")


@query("SELECT unnest(['n_folds   5', 'rotation  aligned']) AS line")
def told_settings(spark, sf_dir):
    s = experiment.Settings()
    return spark.createDataFrame([(x,) for x in results.told({"n_folds": s.n_folds, "rotation": s.rotation}).split("\n")], "line string")


# Samples.


@query("SELECT i, CAST(CASE WHEN i = 0 THEN 25 WHEN i = 9 THEN n // 2 ELSE floor(exp(ln(25) + i * (ln(n // 2) - ln(25)) / 9)) END AS BIGINT) AS size FROM (SELECT CAST(unnest(range(10)) AS BIGINT) AS i), (SELECT count(*) AS n FROM customer)")
def log_sizes(spark, sf_dir):
    """Sizes from 20 components with 5 folds up to half of all subjects."""
    sizes = sampling.planned_sizes(A.table(spark, sf_dir, "customer").count(), 10, 20)
    return spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "i long, size long")


@query("""WITH n AS (SELECT count(*) AS n FROM customer), s AS (SELECT CAST(CASE WHEN i = 0 THEN 25 WHEN i = 9 THEN n // 2 ELSE floor(exp(ln(25) + i * (ln(n // 2) - ln(25)) / 9)) END AS BIGINT) AS size FROM (SELECT unnest(range(10)) AS i), n),
k AS (SELECT c_mktsegment, count(*) AS k FROM customer GROUP BY 1) SELECT c_mktsegment, size FROM k, s WHERE size <= k // 2""")
def subset_sizes(spark, sf_dir):
    """Sizes of the whole cohort that each subset can have."""
    c = A.table(spark, sf_dir, "customer")
    sizes = sampling.planned_sizes(c.count(), 10, 20)
    return sampling.sizes_of_subsets(c.groupBy("c_mktsegment").agg(F.count("*").alias("n")), sizes).select("c_mktsegment", F.col("sample_size").cast("long").alias("size"))


# Estimators.

LINE = "l_orderkey, l_linenumber"


def _lines(spark, sf_dir, *names: str) -> DataFrame:
    return A.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[F.col(n).cast("double").alias(n) for n in names])


@query(f"SELECT {LINE}, round((l_quantity - (SELECT avg(l_quantity) FROM lineitem)) / (SELECT stddev_pop(l_quantity) FROM lineitem), 6) AS l_quantity FROM lineitem")
def standardise(spark, sf_dir):
    return estimators.Standardise().fit_transform(_lines(spark, sf_dir, "l_quantity"), ["l_quantity"]).withColumn("l_quantity", A.r6(F.col("l_quantity")))


@query(f"""WITH s AS (SELECT quantile_cont(l_quantity, 0.5) AS m, quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25) AS r FROM lineitem), z AS (SELECT l_orderkey, l_linenumber, (l_quantity - m) / r AS x, l_tax FROM lineitem, s),
w AS (SELECT sum(l_tax * x) / sum(l_tax * l_tax) AS w FROM z) SELECT {LINE}, round(x - l_tax * w, 6) AS l_quantity FROM z, w""")
def chain_scale_deconfound(spark, sf_dir):
    """A chain of two steps, with a parameter of one set by name."""
    chain = estimators.Chain([("scale", estimators.RobustScale()), ("deconfound", estimators.Deconfound())])
    out = chain.fit_transform(_lines(spark, sf_dir, "l_quantity", "l_tax"), ["l_quantity"], ["l_tax"])
    return out.select("l_orderkey", "l_linenumber", A.r6(F.col("l_quantity")).alias("l_quantity"))


SCALED_LESS_TAX = registry.ORACLES["chain_scale_deconfound"]


@query(SCALED_LESS_TAX)
def stored_pipeline(spark, sf_dir):
    """The same two steps as stages of a Pipeline of Spark's, written when fitted, read again and applied."""
    rows = _lines(spark, sf_dir, "l_quantity", "l_tax")
    made = Pipeline(stages=[stages.FrameStage(estimators.RobustScale(), ["l_quantity"]), stages.FrameStage(estimators.Deconfound(), ["l_quantity"], ["l_tax"])])
    path = _folder(spark) + "/model"
    made.fit(rows).write().save(path)
    out = PipelineModel.load(path).transform(rows)
    return out.select("l_orderkey", "l_linenumber", A.r6(F.col("l_quantity")).alias("l_quantity"))


@query(f"""WITH s AS (SELECT avg(l_tax) AS m, stddev_samp(l_tax) AS r FROM lineitem), z AS (SELECT l_orderkey, l_linenumber, l_quantity AS x, (l_tax - m) / r AS a, ((l_tax - m) / r) * ((l_tax - m) / r) AS b FROM lineitem, s),
g AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * x) AS ax, sum(b * x) AS bx FROM z), w AS (SELECT (bb * ax - ab * bx) / (aa * bb - ab * ab) AS wa, (aa * bx - ab * ax) / (aa * bb - ab * ab) AS wb FROM g)
SELECT {LINE}, round(x - a * wa - b * wb, 4) AS x FROM z, w""")
def views_deconfounded(spark, sf_dir):
    """Confounds through their own chain (scaled, squared), then a named dataset deconfounded by both."""
    lines = _lines(spark, sf_dir, "l_quantity", "l_tax").withColumn("eid", F.monotonically_increasing_id())
    lines = scratch.cut_lineage(lines)
    views = estimators.Views({"x": estimators.Chain([("deconfound", estimators.Deconfound())])}, estimators.Chain([("scale", estimators.Standardise()), ("square", estimators.Square())]))
    views.set_params(confounds__scale__ddof=1)
    out = views.fit(lines, {"x": ["l_quantity"]}, ["l_tax"]).transform(lines)["x"]
    return out.join(lines.select("eid", "l_orderkey", "l_linenumber"), "eid").select("l_orderkey", "l_linenumber", F.round("l_quantity", 4).alias("x"))


@query("SELECT unnest(['l_quantity', 'l_tax', 'flat', 'few']) AS col, unnest(['kept', 'kept', 'mode', 'missing']) AS state")
def selected_features(spark, sf_dir):
    """Columns that few rows have, and those with one dominant value, go; the reasons stay."""
    l = _lines(spark, sf_dir, "l_quantity", "l_tax").select("*", F.lit(1.0).alias("flat"), F.when(F.col("l_quantity") > 40, F.col("l_tax")).alias("few"))  # noqa: E741
    found = estimators.SelectColumns().fit(l, ["l_quantity", "l_tax", "flat", "few"])
    return spark.createDataFrame([(c, "kept") for c in found.columns_out] + [(c, why) for why, names in found.dropped.items() for c in names], "col string, state string")


@query("SELECT CAST(count(*) AS BIGINT) AS n, round(sum(c_acctbal), 2) AS total, CAST(count(DISTINCT c_custkey) AS BIGINT) AS subjects, true AS moved FROM customer")
def shuffled_view(spark, sf_dir):
    """A dataset whose rows are dealt to other keys: the same rows, the same keys, other pairs."""
    c = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("eid"), F.col("c_acctbal").alias("x"))
    views = estimators.Views({"x": estimators.Chain([])}, shuffled=("x",))
    out = views.fit(c, {"x": ["x"]}).transform(c)["x"]
    both = out.join(c.withColumnRenamed("x", "own"), "eid")
    return both.agg(F.count("*").alias("n"), F.round(F.sum("x"), 2).alias("total"), F.count_distinct("eid").alias("subjects"), (F.count_if(F.col("x") != F.col("own")) > F.count("*") / 2).alias("moved"))


@query(f"""WITH {A.WIDE}, s AS (SELECT c_custkey AS eid, c_acctbal AS x, CASE WHEN c_nationkey % 4 > 0 THEN c_acctbal * 2 + c_nationkey END AS y FROM customer), r AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM s)
SELECT eid, round(x, 3) AS x, round(coalesce(y, a + b * x), 3) AS y FROM s, r""")
def impute_by_regression(spark, sf_dir):
    """A column with missing values and one without: the regression of one on the other."""
    c = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("eid"), F.col("c_acctbal").alias("x"), F.when(F.col("c_nationkey") % 4 > 0, F.col("c_acctbal") * 2 + F.col("c_nationkey")).alias("y"))
    return linear.iterative_impute(c, ["x", "y"], "eid", ridge=1e-15).select("eid", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


# Components and canonical correlation.


@query("""WITH s AS (SELECT regr_sxx(v, q) AS qq, regr_syy(v, q) AS vv, regr_sxy(v, q) AS qv FROM (SELECT l_quantity AS q, l_discount * 100 AS v FROM lineitem)),
e AS (SELECT (qq + vv) / 2 + sqrt((qq - vv) * (qq - vv) / 4 + qv * qv) AS hi, qq + vv AS total FROM s), f AS (SELECT unnest([0.25, 0.5, 0.75, 0.9, 0.99]) AS fraction)
SELECT CAST(fraction AS DOUBLE) AS fraction, CAST(CASE WHEN fraction < hi / total THEN 1 ELSE 2 END AS BIGINT) AS components FROM e, f""")
def components_reaching(spark, sf_dir):
    l = A.table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("q"), (F.col("l_discount") * 100).alias("v"))  # noqa: E741
    shares = [0.25, 0.5, 0.75, 0.9, 0.99]
    found = linear.components_reaching(linear.fit_pca(l, ["q", "v"]), shares)
    return spark.createDataFrame(list(zip(shares, found, strict=True)), "fraction double, components long")


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity - avg(l_quantity) OVER () AS q, l_discount * 100 - avg(l_discount * 100) OVER () AS v, avg(l_quantity) OVER () AS mq, avg(l_discount * 100) OVER () AS mv FROM lineitem),
s AS (SELECT sum(q * q) AS qq, sum(v * v) AS vv, sum(q * v) AS qv FROM l), e AS (SELECT *, (qq + vv) / 2 + sqrt((qq - vv) * (qq - vv) / 4 + qv * qv) AS hi FROM s),
d AS (SELECT (hi - vv) / sqrt((hi - vv) * (hi - vv) + qv * qv) AS a, qv / sqrt((hi - vv) * (hi - vv) + qv * qv) AS b FROM e), t AS (SELECT l.*, CASE WHEN a < 0 THEN -a ELSE a END AS a, CASE WHEN a < 0 THEN -b ELSE b END AS b FROM l, d)
SELECT l_orderkey, l_linenumber, round(a * q + b * v, 4) AS score, round(mq + a * (a * q + b * v), 4) AS restored FROM t""")
def saved_components(spark, sf_dir):
    """Components saved, loaded, applied, and turned back into columns."""
    l = A.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("q"), (F.col("l_discount") * 100).alias("v"))  # noqa: E741
    held = tables.object_text(linear.fit_pca(l, ["q", "v"], 1))
    model = tables.object_of(held, kernels.NanPca)
    out = linear.pca_restore(linear.pca_scores(l, ["q", "v"], model), ["q", "v"], model)
    return out.select("l_orderkey", "l_linenumber", F.round("PC1", 4).alias("score"), F.round("q_restored", 4).alias("restored"))


CANONICAL = f"""{A.VIEWS}, m AS (SELECT var_samp(a0) AS xx, covar_samp(a0, a1) AS xz, var_samp(a1) AS zz, var_samp(b0) AS yy, covar_samp(b0, b2) AS yw, var_samp(b2) AS ww, covar_samp(a0, b0) AS xy, covar_samp(a0, b2) AS xw, covar_samp(a1, b0) AS zy, covar_samp(a1, b2) AS zw FROM views),
k AS (SELECT (zz * xy - xz * zy) / dx AS p, (zz * xw - xz * zw) / dx AS q, (xx * zy - xz * xy) / dx AS r, (xx * zw - xz * xw) / dx AS s, (ww * xy - yw * xw) / dy AS t, (ww * zy - yw * zw) / dy AS u, (yy * xw - yw * xy) / dy AS v, (yy * zw - yw * zy) / dy AS w
 FROM (SELECT *, xx * zz - xz * xz AS dx, yy * ww - yw * yw AS dy FROM m)),
e AS (SELECT p * t + q * v + r * u + s * w AS trace, (p * t + q * v) * (r * u + s * w) - (p * u + q * w) * (r * t + s * v) AS det FROM k)"""


@query(f"WITH {CANONICAL} SELECT CAST(1 AS BIGINT) AS component, round(sqrt(trace / 2 + sqrt(trace * trace / 4 - det)), 6) AS corr FROM e UNION ALL SELECT 2, round(sqrt(trace / 2 - sqrt(trace * trace / 4 - det)), 6) FROM e")
def cca_2x2(spark, sf_dir):
    """Two columns each: the eigenvalues of a 2 by 2 matrix."""
    model = linear.fit_cca(A.customer_views(spark, sf_dir, "a0", "a1", "b0", "b2"), ["a0", "a1"], ["b0", "b2"])
    return spark.createDataFrame([(k + 1, round(float(c), 6)) for k, c in enumerate(model.correlations)], "component long, corr double")


@query(f"WITH {A.VIEWS}, r AS (SELECT regr_slope(b2, a1) AS s, regr_intercept(b2, a1) AS i FROM views) SELECT eid, round(i + s * a1, 4) AS b2 FROM views, r")
def cca_predict(spark, sf_dir):
    """The second view from the first; of one column each, that is the regression line."""
    v = A.customer_views(spark, sf_dir, "a1", "b2")
    model = linear.fit_cca(v, ["a1"], ["b2"])
    return linear.cca_predict(v, ["a1"], ["b2"], model).select("eid", F.round("b2_predicted", 4).alias("b2"))


@query(f"""WITH {A.VIEWS}, g AS (SELECT sum(a0 * c0) AS a, sum(a0 * b0) AS b, sum(a1 * c0) AS c, sum(a1 * b0) AS d FROM views), n AS (SELECT *, sign(a * d - b * c) AS t FROM g),
q AS (SELECT a + t * d AS p, b - t * c AS q, c - t * b AS r, d + t * a AS s FROM n), f AS (SELECT *, sqrt(abs(p * s - q * r)) AS f FROM q)
SELECT eid, round((a0 * p + a1 * r) / f, 2) AS a0, round((a0 * q + a1 * s) / f, 2) AS a1 FROM views, f""")
def rotated_scores(spark, sf_dir):
    """Two scores rotated to two references: the nearest orthogonal matrix of a 2 by 2 one."""
    out = linear.rotate_to(A.customer_views(spark, sf_dir, "a0", "a1", "b0", "c0"), ["a0", "a1"], ["c0", "b0"])
    return out.select("eid", F.round("a0", 2).alias("a0"), F.round("a1", 2).alias("a1"))


@query("""WITH l AS (SELECT l_orderkey % 2 = 0 AS fitted, l_quantity AS x, l_tax AS z, l_extendedprice AS y FROM lineitem), g AS (SELECT regr_sxx(y, x) AS xx, regr_sxy(z, x) AS xz, regr_sxx(y, z) AS zz, regr_sxy(y, x) AS xy, regr_sxy(y, z) AS zy, avg(x) AS mx, avg(z) AS mz, avg(y) AS my FROM l WHERE fitted),
b AS (SELECT *, (zz * xy - xz * zy) / (xx * zz - xz * xz) AS bx, (xx * zy - xz * xy) / (xx * zz - xz * xz) AS bz FROM g), e AS (SELECT fitted, y, y - my - bx * (x - mx) - bz * (z - mz) AS e FROM l, b)
SELECT CASE WHEN fitted THEN 'fit' ELSE 'test' END AS set_name, round(1 - sum(e * e) / (sum(y * y) - sum(y) * sum(y) / count(*)), 6) AS r2, round(sqrt(avg(e * e)), 2) AS rmse FROM e GROUP BY 1""")
def regression_with_covariate(spark, sf_dir):
    """One component with a covariate always in, fitted on even orders, scored on both."""
    l = A.table(spark, sf_dir, "lineitem")  # noqa: E741
    told = [linear.regression_scores(l, ["l_quantity"], ["l_tax"], "l_extendedprice", F.col("l_orderkey") % 2 == 0, method=m, root=r).select("set_name", F.round("score", d).alias(n)) for m, r, n, d in (("r2", False, "r2", 6), ("mse", True, "rmse", 2))]
    return told[0].join(told[1], "set_name")


@query("""WITH l AS (SELECT l_orderkey % 2 = 0 AS fitted, l_quantity AS x, l_tax AS z, l_extendedprice AS y FROM lineitem), o AS (SELECT regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM l WHERE fitted),
g AS (SELECT regr_sxx(y, x) AS xx, regr_sxy(z, x) AS xz, regr_sxx(y, z) AS zz, regr_sxy(y, x) AS xy, regr_sxy(y, z) AS zy, avg(x) AS mx, avg(z) AS mz, avg(y) AS my FROM l WHERE fitted),
b AS (SELECT *, (zz * xy - xz * zy) / (xx * zz - xz * xz) AS bx, (xx * zy - xz * xy) / (xx * zz - xz * xz) AS bz FROM g),
e AS (SELECT 1 AS k, fitted, y, y - i - s * x AS e FROM l, o UNION ALL SELECT 2, fitted, y, y - my - bx * (x - mx) - bz * (z - mz) FROM l, b)
SELECT CAST(k AS BIGINT) AS components, CASE WHEN fitted THEN 'fit' ELSE 'test' END AS set_name, round(1 - sum(e * e) / (sum(y * y) - sum(y) * sum(y) / count(*)), 6) AS score FROM e GROUP BY 1, 2""")
def cumulative_regression(spark, sf_dir):
    out = linear.regression_scores(A.table(spark, sf_dir, "lineitem"), ["l_quantity", "l_tax"], [], "l_extendedprice", F.col("l_orderkey") % 2 == 0, cumulative=True)
    return _long(out, "components").withColumn("score", A.r6(F.col("score")))


@query("""WITH s AS (SELECT sum(l_tax * l_tax) AS a, sum(l_tax * l_discount) AS b, sum(l_discount * l_discount) AS d FROM lineitem), e AS (SELECT a - 2 * d AS a, b, d - 2 * d AS d FROM s),
v AS (SELECT *, (a + d) / 2 + sqrt((a - d) * (a - d) / 4 + b * b) AS hi FROM e), u AS (SELECT *, (hi - d) * (hi - d) + b * b AS n FROM v)
SELECT round(CASE WHEN hi > 0 THEN hi * (hi - d) * (hi - d) / n ELSE 0 END, 4) AS xx, round(CASE WHEN hi > 0 THEN hi * (hi - d) * b / n ELSE 0 END, 4) AS xy, round(CASE WHEN hi > 0 THEN hi * b * b / n ELSE 0 END, 4) AS yy, true AS definite FROM u""")
def nearest_definite(spark, sf_dir):
    """A matrix with a negative eigenvalue: that one is lifted to about 0, the other stays."""
    g = linear.moments(A.table(spark, sf_dir, "lineitem"), ["l_tax", "l_discount"]).products
    m = kernels.nearest_spd(g - 2 * g[1, 1] * np.eye(2))
    return spark.createDataFrame([(round(float(m[0, 0]), 4) + 0.0, round(float(m[0, 1]), 4) + 0.0, round(float(m[1, 1]), 4) + 0.0, bool(np.linalg.eigvalsh(m).min() > 0))], "xx double, xy double, yy double, definite boolean")


@query("""WITH v AS (SELECT CASE WHEN l_linenumber % 3 > 0 THEN l_quantity END AS q, l_discount * 100 AS v FROM lineitem), z AS (SELECT coalesce(q - avg(q) OVER (), 0) AS q, v - avg(v) OVER () AS v FROM v),
s AS (SELECT sum(q * q) AS qq, sum(v * v) AS vv, sum(q * v) AS qv, count(*) AS n FROM z), e AS (SELECT n, (qq + vv) / 2 AS m, sqrt((qq - vv) * (qq - vv) / 4 + qv * qv) AS d FROM s)
SELECT CAST(1 AS BIGINT) AS component, round((m + d) / (n - 1), 4) AS variance FROM e UNION ALL SELECT 2, round((m - d) / (n - 1), 4) FROM e""")
def nan_pca_2x2(spark, sf_dir):
    """Components with missing values, which count as 0 after centring."""
    l = A.table(spark, sf_dir, "lineitem").select(F.when(F.col("l_linenumber") % 3 > 0, F.col("l_quantity")).alias("q"), (F.col("l_discount") * 100).alias("v"))  # noqa: E741
    return spark.createDataFrame([(k + 1, round(float(v), 4)) for k, v in enumerate(linear.fit_pca(l, ["q", "v"]).variance)], "component long, variance double")


@query(f"WITH {A.VIEWS} SELECT round(abs(corr(a1, b2)), 6) AS corr FROM views")
def views_cca(spark, sf_dir):
    """Two datasets, each through its own chain, and their canonical correlation."""
    chain = lambda: estimators.Chain([("scale", estimators.RobustScale()), ("components", estimators.Components(1))])
    v = A.customer_views(spark, sf_dir, "a1", "b2").na.drop("any", subset=["a1", "b2"])
    model = estimators.fit_views_cca(estimators.Views({"a": chain(), "b": chain()}), v, {"a": ["a1"], "b": ["b2"]})
    return spark.createDataFrame([(round(float(model.correlations[0]), 6),)], "corr double")


@query("SELECT c_custkey AS eid, c_acctbal FROM customer WHERE c_custkey % 17 <> 0")
def strict_withdrawal(spark, sf_dir):
    """Subjects to drop who must all be there."""
    c = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("eid"), "c_acctbal")
    return cohort.without_subjects(c, c.where("eid % 17 = 0").select("eid"), strict=True)


@query(f"WITH {A.RESULTS}, r AS (SELECT sample_size, feature, CASE WHEN event_id % 997 <> 0 THEN loading END AS x FROM results) SELECT CAST(sample_size AS BIGINT) AS sample_size, feature, " + ", ".join(f"round(CASE WHEN count(x) = count(*) THEN quantile_cont(x, {q}) END, 6) AS q{i}" for i, q in enumerate((0.025, 0.975))) + " FROM r GROUP BY 1, 2")
def quantiles_with_missing(spark, sf_dir):
    """Quantiles as of correlations: one missing value makes the group's missing."""
    r = A.results(spark, sf_dir).withColumn("loading", F.when(F.col("event_id") % 997 != 0, F.col("loading")))
    out = results.null_quantiles(r, ["sample_size", "feature"], "loading", (0.025, 0.975), skip_missing=False)
    return _long(out, "sample_size").withColumns({c: A.r6(F.col(c)) for c in ("q0", "q1")})
