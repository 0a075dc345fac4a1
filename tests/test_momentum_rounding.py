"""The momentum report against its SQL on many rebalances, some of whose means end in half a tenth."""

import duckdb
import numpy as np
import pandas as pd

from quantloom.plans import catalog


def test_report_rounds_as_its_sql(spark, tmp_path):
    rng = np.random.default_rng(7)
    weeks, brands = 1500, [f"Brand#{k}" for k in range(11, 36)]
    close = np.round(100 * np.exp(np.cumsum(rng.normal(0.001, 0.05, (len(brands), weeks)).clip(-0.1, 0.1), axis=1)), 2)
    parts = pd.DataFrame({"p_partkey": range(len(brands)), "p_brand": brands})
    day = pd.Timestamp("1990-01-01") + pd.to_timedelta(np.arange(weeks) * 7, "D")
    lines = pd.DataFrame({"l_partkey": np.repeat(np.arange(len(brands)), weeks), "l_shipdate": np.tile(day, len(brands)).astype("datetime64[us]"), "l_quantity": 1.0, "l_extendedprice": close.ravel()})
    parts.to_parquet(tmp_path / "part.parquet")
    lines.to_parquet(tmp_path / "lineitem.parquet")
    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    want = con.execute(catalog.ORACLES["mom_report"]).df().sort_values("date").reset_index(drop=True)
    got = pd.DataFrame([r.asDict() for r in catalog.QUERIES["mom_report"](spark, str(tmp_path)).collect()])
    got["date"], got["week_start"] = got["date"].astype(str), got["week_start"].astype(str)
    got = got.sort_values("date").reset_index(drop=True)[want.columns.tolist()]
    assert len(want) == weeks // 5
    differ = (got.astype(str) != want.astype(str)).any(axis=1)
    assert not differ.any(), (got[differ].head(3), want[differ].head(3))
