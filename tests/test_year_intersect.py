"""Years, not rows, are brought together: repeats go before the shuffle and not only after it."""

from pyspark.sql import functions as F

from quantloom.plans import catalog


def test_repeats_go_before_years_meet(spark):
    out = catalog.QUERIES["join_year_intersect"](spark, "/root/testdata/sf0.001")
    plan = [x.strip(" :+-") for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines()]
    at = next(i for i, x in enumerate(plan) if x.startswith("Union"))
    assert sum(x.startswith("Aggregate [yr") for x in plan[at + 1 :]) == 2 and not any(x.startswith("Join") for x in plan), plan


def test_years_of_both_tables_with_nulls(spark, tmp_path):
    for name, key, rows in (("orders", "o_orderdate", ["1995-05-01", "1995-06-01", "1996-01-01", None, None]), ("lineitem", "l_shipdate", ["1996-02-01", "1996-02-01", "1997-01-01", None])):
        spark.createDataFrame([(x,) for x in rows], "d string").select(F.col("d").cast("timestamp").alias(key)).write.parquet(f"{tmp_path}/{name}.parquet")
    got = catalog.QUERIES["join_year_intersect"](spark, str(tmp_path)).collect()
    assert sorted((r.yr for r in got), key=str) == [1996, None]
