"""Queries of catalogue selection, cohorts, joins and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from varistrata.operators import catalog, cohort, columns, results
from varistrata.plans import adapters as A
from varistrata.plans.registry import query
from varistrata.sources import tables

BRAIN = A.COLUMNS[:12]


@query(f"""WITH {A.UDIS} SELECT udi, CAST(regexp_extract(udi, '([0-9]+)-([0-9]+)\\.([0-9]+)', 1) AS BIGINT) AS field_id, CAST(regexp_extract(udi, '([0-9]+)-([0-9]+)\\.([0-9]+)', 2) AS BIGINT) AS instance,
CAST(regexp_extract(udi, '([0-9]+)-([0-9]+)\\.([0-9]+)', 3) AS BIGINT) AS array_index FROM udis""")
def udi_parse(spark, sf_dir):
    return A.udi_table(spark, sf_dir).select("udi", *[c.cast("long").alias(n) for c, n in zip(tables.udi_parts("udi"), ("field_id", "instance", "array_index"), strict=True)])


@query(f"""WITH {A.WIDE} SELECT eid FROM wide WHERE coalesce({', '.join(f'"{c}"' for c in BRAIN)}) IS NOT NULL""")
def subject_nonnull_filter(spark, sf_dir):
    return cohort.with_any_value(A.wide(spark, sf_dir), BRAIN).select("eid")


@query("SELECT c_custkey AS eid, c_acctbal FROM customer c WHERE NOT EXISTS (SELECT 1 FROM customer w WHERE w.c_custkey % 17 = 0 AND w.c_custkey = c.c_custkey)")
def withdrawn_anti_join(spark, sf_dir):
    c = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("eid"), "c_acctbal")
    gone = c.where("eid % 17 = 0").select("eid").unionByName(spark.range(-3, 0).select(F.col("id").alias("eid")))
    return cohort.without_subjects(c, gone)


ROOTS = [1001, 1003, 107]


@query(f"""WITH RECURSIVE {A.TREE}, seen AS (SELECT unnest({ROOTS})::BIGINT AS category_id, 0 AS depth UNION ALL
SELECT child_id, depth + 1 FROM seen JOIN tree ON parent_id = category_id WHERE depth < 8) SELECT DISTINCT category_id FROM seen""")
def category_closure(spark, sf_dir):
    return catalog.category_closure(A.category_tree(spark, sf_dir), ROOTS)


@query(f"WITH {A.CATALOGUE} SELECT field_id, title FROM field WHERE regexp_matches(title, 'red|widget.*PROMO') AND NOT regexp_matches(title, 'ring (test)')")
def title_regex_filter(spark, sf_dir):
    kept = catalog.filter_by_title(A.catalogue(spark, sf_dir), "red|widget.*PROMO")
    return catalog.filter_by_title(kept, "ring (test)", keep=False).select("field_id", "title")


@query(f"WITH {A.CATALOGUE} SELECT field_id, CAST(value_type AS BIGINT) AS value_type FROM field WHERE value_type IN (21, 22, 31)")
def value_type_filter(spark, sf_dir):
    return catalog.filter_by_value_type(A.catalogue(spark, sf_dir), ["categorical", 31]).select("field_id", F.col("value_type").cast("long").alias("value_type"))


@query(f"""WITH {A.UDIS}, k AS (SELECT * FROM udis WHERE instance IN (0, 1, 2)) SELECT udi FROM (SELECT udi, instance, max(instance) OVER (PARTITION BY field_id, array_index) AS top FROM k) WHERE instance = top""")
def instance_max_keep(spark, sf_dir):
    return catalog.filter_by_instance(A.udi_table(spark, sf_dir), [0, 1, 2], "max").select("udi")


@query(f"""WITH RECURSIVE {A.TREE}, {A.CATALOGUE}, {A.UDIS}, seen AS (SELECT 101::BIGINT AS category_id, 0 AS depth UNION ALL SELECT child_id, depth + 1 FROM seen JOIN tree ON parent_id = category_id WHERE depth < 8),
f AS (SELECT field_id FROM field WHERE main_category IN (SELECT category_id FROM seen) UNION SELECT field_id FROM field WHERE field_id % 50 = 0 UNION SELECT unnest([3, 5])::BIGINT),
g AS (SELECT field_id FROM field WHERE field_id IN (SELECT field_id FROM f) AND value_type IN (11, 21, 22, 31) AND NOT regexp_matches(title, 'blue'))
SELECT udi FROM udis WHERE field_id IN (SELECT field_id FROM g) AND instance IN (1, 2)""")
def composite_select(spark, sf_dir):
    fields = A.catalogue(spark, sf_dir)
    recommended = fields.where("field_id % 50 = 0").select(F.lit(101).cast("long").alias("category_id"), "field_id")
    return catalog.select_columns(A.udi_table(spark, sf_dir), fields, A.category_tree(spark, sf_dir), recommended, [101], [3, 5], "numeric", titles_reject=["blue"], instances=[1, 2]).select("udi")


def _any_kind(spark, sf_dir):
    """Fields of which some have no value type or one that isn't known, and identifiers with instances from 1 to 4."""
    kind = F.when(F.col("field_id") % 7 == 0, F.lit(None)).when(F.col("field_id") % 11 == 0, F.lit(199)).otherwise(F.col("value_type"))
    u = A.udi_table(spark, sf_dir).withColumn("instance", F.col("instance") + 1)
    return A.catalogue(spark, sf_dir).withColumn("value_type", kind), u.withColumn("udi", F.concat(F.col("field_id").cast("string"), F.lit("-"), F.col("instance").cast("string"), F.lit("."), F.col("array_index").cast("string")))


@query(f"""WITH RECURSIVE {A.TREE}, {A.CATALOGUE}, {A.UDIS}, seen AS (SELECT 101::BIGINT AS category_id, 0 AS depth UNION ALL SELECT child_id, depth + 1 FROM seen JOIN tree ON parent_id = category_id WHERE depth < 8)
SELECT concat(field_id, '-', instance + 1, '.', array_index) AS udi FROM udis WHERE field_id IN (SELECT field_id FROM field WHERE main_category IN (SELECT category_id FROM seen))""")
def default_select(spark, sf_dir):
    """All there is below a category: neither value types nor instances are filtered by."""
    fields, udis = _any_kind(spark, sf_dir)
    none = fields.limit(0).select(F.col("main_category").alias("category_id"), "field_id")
    return catalog.select_columns(udis, fields, A.category_tree(spark, sf_dir), none, [101]).select("udi")


@query(f"""WITH {A.CATALOGUE}, {A.UDIS}, category AS (SELECT CAST(n_nationkey AS BIGINT) AS category_id, n_name AS title FROM nation)
SELECT udi, concat(f.title, ' (', udi, ')') AS encoded, f.title AS plain FROM udis JOIN field f USING (field_id) JOIN category c ON f.main_category = c.category_id""")
def unsuffixed_labels(spark, sf_dir):
    """Labels of names without an encoding: such a name is its own suffix, where suffixes are shown."""
    categories = A.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("category_id"), F.col("n_name").alias("title"))
    udis = A.udi_table(spark, sf_dir)
    merged = catalog.merged_catalog(udis, A.catalogue(spark, sf_dir), categories)
    told = [catalog.labels(udis.select(F.col("udi").alias("udi_encoded")), merged, suffixes=s).select("udi", F.col("label").alias(n)) for s, n in ((True, "encoded"), (False, "plain"))]
    return told[0].join(told[1], "udi")


@query(f"""WITH {A.CATALOGUE}, {A.UDIS}, category AS (SELECT CAST(n_nationkey AS BIGINT) AS category_id, n_name AS title FROM nation), e AS (SELECT udi, concat(udi, CASE WHEN array_index = 0 THEN '_orig' WHEN array_index = 1 THEN '_squared' ELSE '_mean3' END) AS udi_encoded, field_id FROM udis)
SELECT udi_encoded, concat('[', c.title, '] ', f.title, CASE WHEN udi_encoded LIKE '%mean3' THEN ' (mean3)' ELSE '' END) AS label FROM e JOIN field f USING (field_id) JOIN category c ON f.main_category = c.category_id""")
def catalog_labels(spark, sf_dir):
    categories = A.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("category_id"), F.col("n_name").alias("title"))
    udis = A.udi_table(spark, sf_dir)
    suffix = F.when(F.col("array_index") == 0, "_orig").when(F.col("array_index") == 1, "_squared").otherwise("_mean3")
    merged = catalog.merged_catalog(udis, A.catalogue(spark, sf_dir), categories)
    return catalog.labels(udis.select(F.concat("udi", suffix).alias("udi_encoded")), merged, with_category=True).select("udi_encoded", "label")


DISEASE_COLUMNS = ["d0", "d1", "d2", "d3"]
PSYCHO = "(coalesce(d0 = 'Z864' OR d0[1:3] IN ('F10','F11','F12','F13','F14','F15','F16','F17','F18','F19'), false) OR coalesce(d1 = 'Z864' OR d1[1:3] IN ('F10','F11','F12','F13','F14','F15','F16','F17','F18','F19'), false) OR coalesce(d2 = 'Z864' OR d2[1:3] IN ('F10','F11','F12','F13','F14','F15','F16','F17','F18','F19'), false))"
HYPER = "(coalesce(d0 = 'I10', false) OR coalesce(d1 = 'I10', false) OR coalesce(d2 = 'I10', false) OR coalesce(d3 = 'I10', false))"


@query(f"WITH {A.DISEASES} SELECT eid FROM diseases WHERE d0 IS NULL AND d1 IS NULL AND d2 IS NULL AND d3 IS NULL")
def healthy_subset(spark, sf_dir):
    return cohort.subset(A.diseases(spark, sf_dir), "healthy", DISEASE_COLUMNS).select("eid")


@query(f"WITH {A.DISEASES} SELECT eid, {PSYCHO} AS psychoactive, {HYPER} AS hypertension FROM diseases")
def any_code_subset(spark, sf_dir):
    return A.diseases(spark, sf_dir).select("eid", *[cohort.SUBSETS[n](DISEASE_COLUMNS).alias(n) for n in ("psychoactive", "hypertension")])


@query(f"""WITH {A.DISEASES}, p AS (SELECT eid FROM diseases WHERE {PSYCHO}), h AS (SELECT eid FROM diseases WHERE {HYPER})
SELECT 'psychoactive_no_overlap' AS subset, eid FROM (SELECT eid FROM p EXCEPT SELECT eid FROM h) UNION ALL SELECT 'hypertension_no_overlap', eid FROM (SELECT eid FROM h EXCEPT SELECT eid FROM p)
UNION ALL SELECT 'hyperpsycho', eid FROM (SELECT eid FROM h INTERSECT SELECT eid FROM p)""")
def subset_algebra(spark, sf_dir):
    d = A.diseases(spark, sf_dir)
    names = ("psychoactive_no_overlap", "hypertension_no_overlap", "hyperpsycho")
    tags = F.array_compact(F.array(*[F.when(cohort.SUBSETS[n](DISEASE_COLUMNS), F.lit(n)) for n in names]))
    return d.select(F.explode(tags).alias("subset"), "eid")


@query(f"""WITH {A.DISEASES}, m AS (SELECT 'psychoactive' AS subset, eid FROM diseases WHERE {PSYCHO} UNION ALL SELECT 'hypertension', eid FROM diseases WHERE {HYPER} UNION ALL SELECT 'all', eid FROM diseases)
SELECT x.subset AS a, y.subset AS b, CAST(count(*) AS BIGINT) AS n FROM m x JOIN m y ON x.eid = y.eid AND x.subset <= y.subset GROUP BY 1, 2""")
def subset_overlaps(spark, sf_dir):
    d = A.diseases(spark, sf_dir)
    tags = F.array_compact(F.array(*[F.when(cohort.SUBSETS[n](DISEASE_COLUMNS), F.lit(n)) for n in ("psychoactive", "hypertension", "all")]))
    return results.overlaps(d.select("eid", F.explode(tags).alias("subset")))


@query("SELECT c_custkey AS eid, c_acctbal AS demo__balance, s.orders AS orders__n FROM customer JOIN (SELECT o_custkey, count(*) AS orders FROM orders GROUP BY 1) s ON c_custkey = o_custkey")
def dataset_alignment(spark, sf_dir):
    o = A.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("eid")).agg(F.count("*").alias("n"))
    c = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("eid"), F.col("c_acctbal").alias("balance")).join(o.select("eid"), "eid", "left_semi")
    data = cohort.StudyData.of(c).add_dataset("demo", c).add_dataset("orders", o)
    return data.frame


@query("SELECT l_orderkey, " + ", ".join(f"CAST(sum(CASE WHEN l_returnflag = '{v}' THEN 1 ELSE 0 END) AS BIGINT) AS flag_{v}" for v in "ANR") + " FROM lineitem GROUP BY 1")
def one_hot(spark, sf_dir):
    encoded = columns.one_hot(A.table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("flag")), "flag", ["A", "N", "R"])
    return encoded.groupBy("l_orderkey").agg(*[F.sum(f"flag_{v}").alias(f"flag_{v}") for v in "ANR"])


@query("SELECT o_orderkey, o_totalprice, round(o_totalprice * o_totalprice, 2) AS o_totalprice_squared FROM orders")
def square_columns(spark, sf_dir):
    out = columns.square_columns(A.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"])
    return out.withColumn("o_totalprice_squared", F.round("o_totalprice_squared", 2))


@query("SELECT CAST(p_size // 5 AS BIGINT) AS age_group, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY 1")
def age_group_bucket(spark, sf_dir):
    from varistrata.operators.sampling import age_group

    return A.table(spark, sf_dir, "part").groupBy(age_group("p_size").cast("long").alias("age_group")).agg(F.count("*").alias("n"))


@query(f"WITH {A.RESULTS} SELECT feature, " + ", ".join(f"round(avg(CASE WHEN sample_size = {s} THEN loading END), 6) AS s{s}" for s in (100, 200, 300, 400)) + " FROM results GROUP BY 1")
def long_to_wide(spark, sf_dir):
    r = A.results(spark, sf_dir).groupBy("feature", "sample_size").agg(A.r6(F.avg("loading")).alias("loading"))
    return columns.long_to_wide(r, ["feature"], "sample_size", "loading", [100, 200, 300, 400]).withColumnsRenamed({str(s): f"s{s}" for s in (100, 200, 300, 400)})


@query(f"WITH {A.LONG} SELECT eid, col, round(value, 6) AS value FROM long WHERE value IS NOT NULL")
def wide_to_long(spark, sf_dir):
    return columns.wide_to_long(A.wide(spark, sf_dir), ["eid"], A.COLUMNS, "col").where("value is not null").withColumn("value", A.r6(F.col("value")))


@query("""SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(l, '\\((mean|std)[0-9]+\\)', '(\\1)', 'g'), ' \\([0-9]+\\)', '', 'g'), '^\\[[^\\]]*\\] ', '', 'g') AS label
FROM (SELECT p_partkey, concat('[', p_brand, '] ', p_name, CASE p_size % 3 WHEN 0 THEN ' (mean25)' WHEN 1 THEN ' (std4) (17)' ELSE ' (12)' END) AS l FROM part)""")
def label_cleanup(spark, sf_dir):
    tail = F.when(F.col("p_size") % 3 == 0, " (mean25)").when(F.col("p_size") % 3 == 1, " (std4) (17)").otherwise(" (12)")
    made = A.table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("["), "p_brand", F.lit("] "), "p_name", tail).alias("l"))
    return made.select("p_partkey", results.clean_label("l").alias("label"))


@query("SELECT p_partkey, CASE WHEN v = 1 OR v // 1000 = 1 THEN 'one' WHEN v = 2 OR v // 1000 = 2 THEN 'two' WHEN v = 4 OR v // 1000 = 4 THEN 'four' END AS name FROM (SELECT p_partkey, CASE WHEN p_size < 25 THEN p_size ELSE p_size * 90 END AS v FROM part)")
def ethnicity_style_map(spark, sf_dir):
    v = A.table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") < 25, F.col("p_size")).otherwise(F.col("p_size") * 90).alias("v"))
    return v.select("p_partkey", results.code_label("v", {1: "one", 2: "two", 4: "four"}).alias("name"))


PATHS = "SELECT concat('PCs_20_20/all/sample_size_', c_nationkey * 10 + 50, '/sample_size_', c_nationkey * 10 + 50, '-rep', c_custkey % 7, '.parquet') AS path FROM customer"


@query(f"""WITH p AS (SELECT DISTINCT path FROM ({PATHS})) SELECT path, CAST(regexp_extract(path, '/sample_size_([0-9]+)-rep', 1) AS BIGINT) AS sample_size, CAST(regexp_extract(path, 'rep([0-9]+)', 1) AS BIGINT) AS rep FROM p
WHERE CAST(regexp_extract(path, 'rep([0-9]+)', 1) AS BIGINT) IN (1, 3, 5)""")
def result_paths(spark, sf_dir):
    c = A.table(spark, sf_dir, "customer")
    size = (F.col("c_nationkey") * 10 + 50).cast("string")
    paths = c.select(F.concat(F.lit("PCs_20_20/all/sample_size_"), size, F.lit("/sample_size_"), size, F.lit("-rep"), (F.col("c_custkey") % 7).cast("string"), F.lit(".parquet")).alias("path")).distinct()
    labels = spark.range(7).select(F.col("id").cast("int").alias("i_rep"), (F.col("id") % 2).cast("int").alias("label"))
    return tables.find_results(paths, labels, 1).select("path", F.col("sample_size").cast("long").alias("sample_size"), F.col("rep").cast("long").alias("rep"))


@query("SELECT DISTINCT a.region AS a, b.region AS b FROM (SELECT r_name AS region FROM region) a, (SELECT r_name AS region FROM region) b")
def key_cross_product(spark, sf_dir):
    r = A.table(spark, sf_dir, "region").select(F.col("r_name").alias("a"))
    return results.key_product(r, r.select(F.col("a").alias("b")))


#: Categories of all named domains; half of the fields lie in one below them (its number and this more).
DOMAIN_CATEGORIES = sorted({c for d in catalog.DOMAINS.values() for c in d.get("categories", ())})
BELOW = 500_000
#: What titles of fields end with, so that each domain's patterns meet some.
ENDINGS = ["L1 part", "Index for card A", "ICD10 code", "Place of birth in UK", "Time elapsed in trial", "plain", "mean of L3"]


def _domain_fields(spark, sf_dir):
    p = A.table(spark, sf_dir, "part")
    at = F.element_at(F.array(*[F.lit(c) for c in DOMAIN_CATEGORIES]), (F.col("p_partkey") % len(DOMAIN_CATEGORIES) + 1).cast("int"))
    below = F.when(F.col("p_partkey") % 16 >= 8, F.lit(BELOW)).otherwise(0)
    ending = F.element_at(F.array(*[F.lit(e) for e in ENDINGS]), (F.col("p_partkey") % len(ENDINGS) + 1).cast("int"))
    return p.select(F.col("p_partkey").alias("field_id"), F.concat_ws(" ", "p_name", ending).alias("title"), (F.col("p_size") % 3 + 11).cast("int").alias("value_type"), (at + below).cast("long").alias("main_category"))


def _domain_sql(name: str) -> str:
    d = catalog.DOMAINS[name]
    listed = lambda values: ", ".join(str(v) for v in values)
    inside = [f"main_category IN ({listed([*d['categories'], *(c + BELOW for c in d['categories'])])})"] if d.get("categories") else []
    inside += [f"field_id IN ({listed(d['extra_fields'])})"] if d.get("extra_fields") else []
    titles = [f"regexp_matches(title, '{d['title']}')"] if "title" in d else []
    titles += [f"NOT regexp_matches(title, '{t}')" for t in d.get("titles_reject", ())]
    chosen = f"SELECT u.*, max(instance) OVER (PARTITION BY field_id, array_index) AS top FROM udis u WHERE instance IN ({listed(d['instances'])}) AND field_id IN (SELECT field_id FROM df WHERE {' AND '.join(['(' + ' OR '.join(inside) + ')', *titles])})"
    return f"SELECT '{name}' AS domain, udi FROM ({chosen})" + (" WHERE instance = top" if d.get("keep_instance") == "max" else "")


@query(f"""WITH {A.UDIS}, df AS (SELECT p_partkey AS field_id, concat_ws(' ', p_name, {ENDINGS}[p_partkey % {len(ENDINGS)} + 1]) AS title,
 {DOMAIN_CATEGORIES}[p_partkey % {len(DOMAIN_CATEGORIES)} + 1] + CASE WHEN p_partkey % 16 >= 8 THEN {BELOW} ELSE 0 END AS main_category FROM part) """ + " UNION ALL ".join(_domain_sql(n) for n in catalog.DOMAINS))
def named_domains(spark, sf_dir):
    """The columns of every named domain, by its categories and those below them, single fields, titles and instances."""
    fields = _domain_fields(spark, sf_dir)
    tree = fields.where(f"main_category > {BELOW}").select((F.col("main_category") - BELOW).alias("parent_id"), F.col("main_category").alias("child_id")).distinct()
    none = fields.limit(0).select(F.col("main_category").alias("category_id"), "field_id")
    udis = A.udi_table(spark, sf_dir)
    parts = [catalog.select_columns(udis, fields, tree, none, **d).select(F.lit(n).alias("domain"), "udi") for n, d in catalog.DOMAINS.items()]
    return columns.concat(parts)
