"""The driver contract, with and without the training-data operators."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_works_alone(tmp_path):
    """Without the subpackage and the pipeline the entry still imports, and tells nothing; one that lacks a library is told of."""
    shutil.copytree(f"{ROOT}/varistrata", f"{tmp_path}/varistrata", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    ask = "import warnings; warnings.simplefilter('error'); import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"
    said = subprocess.run([sys.executable, "-c", ask], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    n, sql, pipeline = said.stdout.split()
    assert int(n) > 120 and int(sql) > 110 and pipeline == "False"
    os.makedirs(f"{tmp_path}/varistrata/llm")
    for name, body in (("__init__", ""), ("queries", "import no_such_library_at_all")):
        with open(f"{tmp_path}/varistrata/llm/{name}.py", "w") as f:
            f.write(body)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries()"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert said.returncode == 0 and "no_such_library_at_all" in said.stderr


def test_customer_views_are_joined_once(spark):
    """Models take several passes over the views: each reads rows that are there, not orders and lineitems again."""
    from varistrata.plans import adapters

    v = adapters.customer_views(spark, "/root/testdata/sf0.001")
    plan = v._jdf.queryExecution().optimizedPlan().toString()
    assert v.count() > 0 and "Join" not in plan and "Aggregate" not in plan, plan


def test_views_hold_only_the_columns_asked_for(spark, monkeypatch):
    """What the grid of one-column views doesn't look at (quantities, discounts, counts and means of orders) is never summed or shuffled."""
    from varistrata.plans import adapters, registry

    class Kept(Exception):
        pass

    def kept(df):
        raise Kept(df.columns, df._jdf.queryExecution().optimizedPlan().toString())

    monkeypatch.setattr(adapters, "cut_lineage", kept)
    with pytest.raises(Kept) as told:
        registry.QUERIES["grid_one_column_views"](spark, "/root/testdata/sf0.001")
    columns, plan = told.value.args
    assert columns == ["eid", "a2", "b2", "c0"]
    assert "sum_l_extendedprice" in plan and not any(c in plan for c in ("sum_l_quantity", "sum_l_discount", "AS a0#", "AS a1#", "AS c1#"))


def test_column_identifiers_are_kept_as_bits_of_parts(spark, tmp_path):
    """Identifiers are distinct rows of lineitem, NULLs too, and no task has a row for each of them before the parts are exploded."""
    from pyspark.sql import functions as F

    from varistrata.plans import adapters

    rows = [(p, n, s) for p in (1, 2, 7) for n in (1, 2, 3, 4, 7, None) for s in (1, 5, 9, 11, None) if (p, n) != (7, 4)] * 2
    spark.createDataFrame(rows, "l_partkey long, l_linenumber int, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    u = adapters.udi_table(spark, str(tmp_path))
    want = {(p, None if n is None else n % 4, None if s is None else s % 5) for p, n, s in rows}
    got = [tuple(r) for r in u.select("field_id", "instance", "array_index").collect()]
    assert len(got) == len(want) and set(got) == want
    assert dict(u.dtypes) == {"field_id": "bigint", "instance": "int", "array_index": "int", "udi": "string"}
    assert u.where(F.col("udi").isNull() != (F.col("instance").isNull() | F.col("array_index").isNull())).isEmpty()
    assert "Aggregate" not in u._jdf.queryExecution().optimizedPlan().toString()
