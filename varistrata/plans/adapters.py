"""The engine's kinds of input, made from the test tables: each as a DataFrame and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varistrata.sources.scratch import cut_lineage

EVENT_TYPES = ["view", "click", "purchase", "signup", "error"]
FIELDS = {t: 100 + i for i, t in enumerate(EVENT_TYPES)}
INSTANCES, ARRAYS = 4, 3
COLUMNS = [f"{FIELDS[t]}-{i}.{a}" for t in EVENT_TYPES for i in range(INSTANCES) for a in range(ARRAYS)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(col: Column) -> Column:
    return F.round(col, 6)


def keyed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with eid, field_id, instance (of 8 days) and array_index."""
    e = table(spark, sf_dir, "events")
    code = F.lit(100)
    for t in EVENT_TYPES:
        code = F.when(F.col("event_type") == t, F.lit(FIELDS[t])).otherwise(code)
    return e.select(
        F.col("event_id"), F.col("user_id").alias("eid"), "event_type", "value", code.alias("field_id"),
        F.least(F.floor((F.dayofmonth("ts") - 1) / 8), F.lit(INSTANCES - 1)).cast("int").alias("instance"), (F.col("event_id") % ARRAYS).cast("int").alias("array_index"),
    )


KEYED = f"""keyed AS (SELECT event_id, user_id AS eid, event_type, value,
 CASE event_type {' '.join(f"WHEN '{t}' THEN {c}" for t, c in FIELDS.items())} ELSE 100 END AS field_id,
 CAST(least((day(ts) - 1) // 8, {INSTANCES - 1}) AS INTEGER) AS instance, CAST(event_id % {ARRAYS} AS INTEGER) AS array_index FROM events)"""


def _parts(column: str) -> tuple[int, int, int]:
    field, rest = column.split("-")
    instance, array = rest.split(".")
    return int(field), int(instance), int(array)


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each user, a column for each field, instance and array index: the mean value, NULL without events."""
    k = keyed_events(spark, sf_dir)
    return k.groupBy("eid").agg(*[F.avg(F.when((F.col("field_id") == f) & (F.col("instance") == i) & (F.col("array_index") == a), F.col("value"))).alias(c) for c in COLUMNS for f, i, a in [_parts(c)]])


WIDE = (
    KEYED
    + ", wide AS (SELECT eid, "
    + ", ".join(f'avg(CASE WHEN field_id = {f} AND instance = {i} AND array_index = {a} THEN value END) AS "{c}"' for c in COLUMNS for f, i, a in [_parts(c)])
    + " FROM keyed GROUP BY eid)"
)
LONG = WIDE + ", long AS (" + " UNION ALL ".join(f"SELECT eid, '{c}' AS col, \"{c}\" AS value FROM wide" for c in COLUMNS) + ")"


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as fields: title of name, brand and type, a value type by size, and the brand's number as category."""
    p = table(spark, sf_dir, "part")
    kinds = F.array(*[F.lit(v) for v in (11, 21, 22, 31, 41, 51, 61, 101)])
    return p.select(
        F.col("p_partkey").alias("field_id"), F.concat_ws(" ", "p_name", F.lit("(test)"), "p_type").alias("title"),
        F.element_at(kinds, F.col("p_size") % 8 + 1).alias("value_type"), F.regexp_extract("p_brand", r"(\d+)", 1).cast("long").alias("main_category"),
    )


CATALOGUE = """field AS (SELECT p_partkey AS field_id, concat_ws(' ', p_name, '(test)', p_type) AS title,
 [11, 21, 22, 31, 41, 51, 61, 101][p_size % 8 + 1] AS value_type, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT) AS main_category FROM part)"""


def udi_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column identifiers of the parts that lineitems have: instance by line number, array by supplier.

    A part has at most 30 of them (NULL is a value too; numbers are not negative), so lineitems become a row of bits for each
    part; those are checkpointed, as some queries read the identifiers several times.
    """
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    bit = F.coalesce(F.col("l_linenumber") % 4, F.lit(4)) * 6 + F.coalesce(F.col("l_suppkey") % 5, F.lit(5))
    placed = l.select(F.col("l_partkey").alias("field_id"), bit.cast("int").alias("_bit"))
    parts = cut_lineage(placed.groupBy("field_id").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits")))
    told = parts.select("field_id", F.explode(F.filter(F.sequence(F.lit(0), F.lit(29)), lambda k: F.getbit("_bits", k) == 1)).alias("_bit"))
    value = lambda x, none: F.when(x != none, x).cast("int")
    return told.select("field_id", value(F.floor(F.col("_bit") / 6), 4).alias("instance"), value(F.col("_bit") % 6, 5).alias("array_index")).withColumn(
        "udi", F.concat(F.col("field_id").cast("string"), F.lit("-"), F.col("instance").cast("string"), F.lit("."), F.col("array_index").cast("string"))
    )


UDIS = """udis AS (SELECT *, concat(field_id, '-', instance, '.', array_index) AS udi FROM
 (SELECT DISTINCT l_partkey AS field_id, CAST(l_linenumber % 4 AS INTEGER) AS instance, CAST(l_suppkey % 5 AS INTEGER) AS array_index FROM lineitem))"""


def category_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations and (twice over, by nation and region) suppliers as a tree of numbers."""
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    up = n.select((F.col("n_regionkey") + 1000).cast("long").alias("parent_id"), (F.col("n_nationkey") + 100).cast("long").alias("child_id"))
    down = s.select((F.col("s_nationkey") + 100).cast("long").alias("parent_id"), (F.col("s_suppkey") % 30).cast("long").alias("child_id"))
    return up.unionByName(down).distinct()


TREE = """tree AS (SELECT DISTINCT * FROM (SELECT CAST(n_regionkey + 1000 AS BIGINT) AS parent_id, CAST(n_nationkey + 100 AS BIGINT) AS child_id FROM nation
 UNION ALL SELECT CAST(s_nationkey + 100 AS BIGINT), CAST(s_suppkey % 30 AS BIGINT) FROM supplier))"""


def diseases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three code columns for each customer, from order priorities and states; NULL for most."""
    o = table(spark, sf_dir, "orders")
    big = lambda cond, code: F.max(F.when(cond & (F.col("o_totalprice") > 400000), F.lit(code)))
    coded = o.groupBy("o_custkey").agg(
        big(F.col("o_orderpriority") == "1-URGENT", "I10").alias("d0"), big(F.col("o_orderpriority") == "2-HIGH", "F109").alias("d1"), big(F.col("o_orderstatus") == "P", "Z864").alias("d2"), big(F.col("o_orderpriority") == "5-LOW", "I101").alias("d3")
    )
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("eid"))
    return c.join(coded, c["eid"] == coded["o_custkey"], "left").drop("o_custkey")


DISEASES = """coded AS (SELECT o_custkey, max(CASE WHEN o_orderpriority = '1-URGENT' AND o_totalprice > 400000 THEN 'I10' END) AS d0,
 max(CASE WHEN o_orderpriority = '2-HIGH' AND o_totalprice > 400000 THEN 'F109' END) AS d1, max(CASE WHEN o_orderstatus = 'P' AND o_totalprice > 400000 THEN 'Z864' END) AS d2,
 max(CASE WHEN o_orderpriority = '5-LOW' AND o_totalprice > 400000 THEN 'I101' END) AS d3 FROM orders GROUP BY o_custkey),
diseases AS (SELECT c_custkey AS eid, d0, d1, d2, d3 FROM customer LEFT JOIN coded ON c_custkey = o_custkey)"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as loadings: sample_size by instance, rep by user, feature by type and array, `error` events as the null model."""
    k = keyed_events(spark, sf_dir)
    return k.select(((F.col("instance") + 1) * 100).alias("sample_size"), (F.col("eid") % 20).cast("int").alias("rep"), F.concat("event_type", F.lit("_"), F.col("array_index").cast("string")).alias("feature"), "event_type", (F.col("value") - 15).alias("loading"), "event_id")


RESULTS = KEYED + """, results AS (SELECT (instance + 1) * 100 AS sample_size, CAST(eid % 20 AS INTEGER) AS rep, concat(event_type, '_', array_index) AS feature, event_type, value - 15 AS loading, event_id FROM keyed)"""


def customer_views(spark: SparkSession, sf_dir: str, *wanted: str) -> DataFrame:
    """Customers with two views: orders (a*) and lineitems (b*), and confounds (c*); wanted: those of the columns that are asked for (none named: all).

    Checkpointed, a row for each customer: models take several passes, and each would join orders and lineitems again. A column that
    isn't wanted must be left out here, before the checkpoint: else its sums are shuffled with the others.
    """
    o, l, c = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "customer"))  # noqa: E741
    a = o.groupBy(F.col("o_custkey").alias("eid")).agg(F.count("*").cast("double").alias("a0"), F.avg("o_totalprice").alias("a1"), F.stddev_samp("o_totalprice").alias("a2"))
    # Sums of each order first: its lines lie together, so the task that reads them adds most of them up.
    lines = l.groupBy("l_orderkey").agg(*[f(v).alias(f"{n}_{v}") for v in ("l_quantity", "l_discount", "l_extendedprice") for n, f in (("sum", F.sum), ("n", F.count))])
    mean = lambda v: F.try_divide(F.sum(f"sum_{v}"), F.sum(f"n_{v}"))
    b = lines.join(o.select("o_orderkey", F.col("o_custkey").alias("eid")), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("eid").agg(mean("l_quantity").alias("b0"), mean("l_discount").alias("b1"), mean("l_extendedprice").alias("b2"))
    base = c.select(F.col("c_custkey").alias("eid"), F.col("c_acctbal").alias("c0"), (F.col("c_nationkey") % 5).cast("double").alias("c1"))
    views = base.join(a, "eid").join(b, "eid")
    return cut_lineage(views.select("eid", *wanted) if wanted else views)


VIEWS = """a AS (SELECT o_custkey AS eid, CAST(count(*) AS DOUBLE) AS a0, avg(o_totalprice) AS a1, stddev_samp(o_totalprice) AS a2 FROM orders GROUP BY 1),
b AS (SELECT o_custkey AS eid, avg(l_quantity) AS b0, avg(l_discount) AS b1, avg(l_extendedprice) AS b2 FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
views AS (SELECT c_custkey AS eid, c_acctbal AS c0, CAST(c_nationkey % 5 AS DOUBLE) AS c1, a0, a1, a2, b0, b1, b2 FROM customer JOIN a ON c_custkey = a.eid JOIN b ON c_custkey = b.eid)"""


def halves(spark: SparkSession, sf_dir: str, dims: int = 32) -> DataFrame:
    """Embeddings as two views of 32 columns each (x*, y*) and the label as confounds."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("eid"), "label", *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(dims)], *[F.col("embedding")[dims + i].cast("double").alias(f"y{i}") for i in range(dims)])


#: Names of the columns of `halves`.
EMBEDDED = [f"{v}{i}" for v in "xy" for i in range(32)]

#: CTEs `n` and `sizes` (s): six sizes of samples of customers, evenly spaced in logarithm.
SIZES = """n AS (SELECT count(*) AS n FROM customer), sizes AS (SELECT i, CAST(CASE WHEN i = 0 THEN 5 WHEN i = 5 THEN n // 2 ELSE floor(exp(ln(5) + i * (ln(n // 2) - ln(5)) / 5)) END AS INTEGER) AS s FROM n, (SELECT unnest(range(6)) AS i))"""
