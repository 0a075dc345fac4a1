"""The screening configuration and the limits of both channels."""

from quantloom.operators.screener import ScreenConfig, first_tier
from pyspark.sql import functions as F


def test_config():
    assert ScreenConfig().validate() == []
    bad = ScreenConfig.from_dict({"weight_roe": 0.5, "main_limit": 0, "min_fcf_years_obs": 6, "nothing": 1})
    assert len(bad.validate()) == 3


def test_first_tier(spark):
    rows = [(k, 1990, 10.0, 1.0, 1.0, 10.0 + k, float(k)) for k in range(6)]  # code 0 pays nothing
    rows += [(k, None, float(k), 1.0, 1.0, None, None) for k in range(10, 14)]
    rows += [(20, 1999, 10.0, 1.0, 1.0, 5.0, 1.0), (21, 1990, 1.0, 1.0, 1.0, 5.0, 1.0), (22, 1990, 10.0, 1.0, -1.0, 5.0, 1.0), (23, 1990, 10.0, 1.0, 1.0, -5.0, 1.0)]
    df = spark.createDataFrame(rows, "code long, listed int, total_mv double, turnover double, pb double, pe_ttm double, dv_ttm double")
    got = first_tier(df, ScreenConfig(main_limit=3, obs_limit=2), F.lit(2000)).collect()
    assert {(r.code, r.channel) for r in got} == {(5, "main"), (4, "main"), (3, "main"), (13, "observation"), (12, "observation")}
    none = df.where("code < 6").withColumn("dv_ttm", F.lit(None).cast("double"))
    assert first_tier(none, ScreenConfig(), F.lit(2000)).count() == 6
    assert first_tier(df.limit(0), ScreenConfig(), F.lit(2000)).count() == 0
