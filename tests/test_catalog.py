import pytest
from store_helpers import DATA, rows

from ledgerline.plans import catalog


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query_equals_its_sql(spark, duck, name):
    got = catalog.queries()[name](spark, DATA)
    want = duck.sql(catalog.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_point_filter_reaches_the_scan(spark):
    from ledgerline.operators import lookup, resolve

    ops = spark.read.parquet(f"{DATA}/orders.parquet").selectExpr("o_orderkey seq", "cast(1 as tinyint) op", "o_orderpriority key", "cast('' as binary) value")
    plan = lookup.get(resolve.snapshot(ops.withColumn("key", ops["key"])), b"5-LOW")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(o_orderpriority)" in plan or "EqualTo(o_orderpriority" in plan


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_works_without_the_llm_folder():
    import subprocess
    import sys

    code = """
import importlib.abc, sys
class Gone(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name in ("corpus_pipeline", "ledgerline.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert "snapshot_events" in e.queries() and not any(k.startswith("op") for k in e.queries())
assert "pipeline" not in e.oracle_sql()
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0])
