import re

import pytest

from siltlog.plans import catalogue

from compare import duck_rows, rows_of


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_equals_sql(spark, sf_dir, name):
    got, cols = rows_of(catalogue.QUERIES[name](spark, sf_dir))
    want, names = duck_rows(sf_dir, catalogue.SQL[name])
    assert cols == names
    assert got == want


def test_key_predicate_reaches_the_scan(spark, sf_dir, tmp_path):
    from pyspark.sql import functions as F

    from siltlog.operators.resolve import resolve
    from siltlog.operators.scope import Scope
    from siltlog.plans import fixtures

    fixtures.orders(spark, sf_dir).write.parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    view = resolve(log, carry=("len",)).where(Scope.prefix(b"\0" * 7 + b"\x05")(F.col("k"))).select("k")
    plan = view._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(k" in plan and "LessThan(k" in plan
    assert ",v:" not in plan and "<v:" not in plan
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    sizes = resolve(log).groupBy().agg(F.sum("len"))._jdf.queryExecution().executedPlan().toString()
    assert ",v:" not in sizes and "SortAggregate" not in sizes


@pytest.mark.parametrize("name", ["kv_iter_keys_prefix", "kv_totals", "kv_column_totals", "kv_cf_disk_usage"])
def test_pages_that_share_a_url(spark, sf_dir, tmp_path, name):
    from pyspark.sql import functions as F

    for table in ("events", "orders"):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").write.parquet(str(tmp_path / f"{table}.parquet"))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    again = pages.where("page_id % 3 = 0 OR startswith(url, 'http://m.')").withColumn("page_id", F.col("page_id") + 1000).withColumn("html", F.concat("html", F.lit("é")))
    nameless = pages.where("page_id < 2").withColumn("page_id", F.col("page_id") + 2000).withColumn("url", F.lit(None).cast("string"))
    pages.unionByName(again).unionByName(nameless).coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got, cols = rows_of(catalogue.QUERIES[name](spark, str(tmp_path)))
    sql = catalogue.SQL[name]
    for table in ("events", "orders", "pages"):
        sql = re.sub(rf"\bFROM {table}\b", f"FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')", sql)
    want, names = duck_rows(sf_dir, sql)
    assert cols == names
    assert got == want
