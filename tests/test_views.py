"""Pairs and judgments: dealt by item in shares that don't grow with the table, and equal to SQL on odd rows."""

import duckdb
import pytest

from twinframe.plans import registry
from twinframe.plans import views as V

SMALL = "/root/testdata/sf0.001"


def plain(frame):
    return sorted(map(str, frame[sorted(frame.columns)].astype(object).where(frame.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", ["pairs", "judgments"])
def test_a_task_takes_in_the_same_share_at_any_size(spark, monkeypatch, name):
    want, lines = plain(V.view(spark, SMALL, name).toPandas()), V.table(spark, SMALL, "lineitem").count()
    for share in (500, 2000):
        monkeypatch.setattr(V, "ITEM_ROWS", share)
        made = V.view(spark, SMALL, name)
        assert made.rdd.getNumPartitions() == -(-lines // share)
        if share == 500:
            assert plain(made.toPandas()) == want


def test_groups_of_items_stay_where_they_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(V, "ITEM_ROWS", 500)
    plan = registry.QUERIES["cluster_rates_cube"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and not any("item_id" in x and "REPARTITION_BY_NUM" not in x for x in plan.split("\n") if "Exchange hashpartitioning" in x)


@pytest.mark.parametrize("name", ["pairs", "judgments"])
def test_odd_lines_as_in_sql(spark, tmp_path, name):
    row = (1, 5, 3, 1, 10.0, 99.5, 0.06, 0.07, "R", "O")
    odd = [row, (*row[:3], 2, *row[4:]), (2, 5, None, 1, None, 7.0, 0.01, 0.0, None, None), (2, 5, None, None, 3.5, None, None, None, "A", None), (2, 5, -3, 2, -4.5, 1.0, 0.1, 0.1, "R", "F"), (2, 5, -3, 3, 4.5, 1.0, 0.1, 0.1, "R", "F"), (None, *row[1:]), (9, *row[1:])]
    kinds = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"
    spark.createDataFrame(odd, kinds).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "1-URGENT"), (1, "5-LOW"), (2, None), (None, "2-HIGH")], "o_orderkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    d = duckdb.connect()
    for t in ("lineitem", "orders"):
        d.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    got, want = V.view(spark, str(tmp_path), name), d.sql(V.DUCK[name])
    assert got.columns == want.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall())) and want.fetchall()


def test_length_quintiles_of_pairs_without_a_length_as_in_sql(spark, tmp_path):
    kinds = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"
    lines = [(k, 5, k % 3, n, 10.0, None if k % 4 == 0 else 10.0 * (k % 11), 0.06, 0.07, "R" if (k + n) % 3 else "A", "O") for k in range(90) for n in (1, 2)]
    spark.createDataFrame(lines, kinds).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, None if k % 5 == 0 else ("1-URGENT", "5-LOW")[k % 2]) for k in range(90)], "o_orderkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    d = duckdb.connect()
    for t in ("lineitem", "orders"):
        d.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    got, want = registry.QUERIES["length_quintiles"](spark, str(tmp_path)), d.sql(registry.ORACLES["length_quintiles"])
    assert got.columns == want.columns and got.filter("lo IS NULL").count() > 0
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))
