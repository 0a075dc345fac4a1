"""Queries of backtests, price distributions, momentum and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quantloom.functions import sql
from quantloom.operators import backtest as bt
from quantloom.sources.bars import BARS, table, weekly_brand_bars
from quantloom.sources.shared import scratch
from quantloom.streaming import snapshots, stateful

from .q_panel import S, full_sql, n_rows

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_c = F.col


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_D = f"{full_sql('close', 5, f'avg(close) OVER {n_rows(5)}')} - {full_sql('close', 20, f'avg(close) OVER {n_rows(20)}')}"


@query(f"WITH {BARS}, d AS (SELECT symbol, trade_date, {_D} AS d FROM bars), e AS (SELECT *, lag(d) OVER ({S}) AS p FROM d) SELECT symbol, trade_date, CASE WHEN p <= 0 AND d > 0 THEN 1 WHEN p >= 0 AND d < 0 THEN -1 ELSE 0 END AS signal FROM e")
def bt_signals(spark, sf_dir):
    return bt.with_signals(weekly_brand_bars(spark, sf_dir), "ma_cross").select("symbol", "trade_date", "signal")


@query(f"WITH {BARS}, m AS (SELECT symbol, trade_date, close / lag(close, 20) OVER ({S}) - 1 AS m FROM bars) SELECT symbol, trade_date, CASE WHEN m > 0 THEN 1 WHEN m < 0 THEN -1 ELSE 0 END AS signal FROM m")
def bt_signals_momentum(spark, sf_dir):
    return bt.with_signals(weekly_brand_bars(spark, sf_dir), "momentum").select("symbol", "trade_date", "signal")


@query(f"WITH {BARS} SELECT symbol, arg_max(close, trade_date) / arg_min(close, trade_date) - 1 AS benchmark FROM bars GROUP BY 1")
def bt_benchmark(spark, sf_dir):
    return bt.buy_hold(weekly_brand_bars(spark, sf_dir))


def _run(strategy):
    def run(spark, sf_dir):
        t = bt.run_backtest(weekly_brand_bars(spark, sf_dir), strategy)
        return t.select("symbol", *[F.round(c, 6).alias(c) for c in t.columns if c not in ("symbol", "n_trades")], "n_trades")

    return run


QUERIES |= {f"bt_run_{s}": _run(s) for s in ("buy_hold", "ma_cross", "momentum", "rsi_reverse")}

_CHIP = f"""{BARS}, tv AS (SELECT *, least(volume / 1000, 0.999999::DOUBLE) AS t, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS rn FROM bars),
 lf AS (SELECT *, t * exp(coalesce(sum(ln(1 - t)) OVER (PARTITION BY symbol ORDER BY trade_date DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lft,
        min(low) OVER (PARTITION BY symbol) AS lo, max(high) OVER (PARTITION BY symbol) AS hi FROM tv WHERE rn <= 120),
 pb AS (SELECT lf.*, b.b AS bucket, (hi - lo) / 149 AS step, lo + b.b * ((hi - lo) / 149) AS price, (high + low + 2 * close) / 4 AS mid FROM lf, (SELECT unnest(range(150)) AS b) b),
 wt AS (SELECT *, CASE WHEN price >= low - step / 2 AND price <= high + step / 2 THEN greatest(1e-9::DOUBLE, 1 - abs(price - mid) / ((high - low) + step)) ELSE 0 END AS w FROM pb),
 sh AS (SELECT *, w / nullif(sum(w) OVER (PARTITION BY symbol, trade_date), 0) * lft AS share FROM wt),
 ds AS (SELECT symbol, bucket, min(price) AS price, sum(share) AS mass FROM sh GROUP BY 1, 2),
 chip AS (SELECT symbol, bucket, price, mass / sum(mass) OVER (PARTITION BY symbol) AS mass FROM ds)"""


def _chips(spark, sf_dir):
    bars = weekly_brand_bars(spark, sf_dir).withColumn("turnover", _c("volume") / 1000)
    return bt.chip_distribution(bars)


@query(f"WITH {_CHIP} SELECT symbol, bucket::INTEGER AS bucket, round(price, 6) AS price, round(mass, 8) AS mass FROM chip")
def chip_dist(spark, sf_dir):
    return _chips(spark, sf_dir).select("symbol", "bucket", F.round("price", 6).alias("price"), F.round("mass", 8).alias("mass"))


@query(f"WITH {_CHIP}, c AS (SELECT symbol, arg_max(close, trade_date) AS close FROM bars GROUP BY 1), cu AS (SELECT *, sum(mass) OVER (PARTITION BY symbol ORDER BY bucket) AS cum FROM chip JOIN c USING (symbol)) SELECT symbol, round(sum(mass) FILTER (price <= close), 6) AS profit_ratio, round(sum(price * mass), 5) AS mean_cost FROM cu GROUP BY 1")
def chip_summary(spark, sf_dir):
    close = weekly_brand_bars(spark, sf_dir).groupBy("symbol").agg(F.max_by("close", "trade_date").alias("close"))
    t = bt.chip_summary(_chips(spark, sf_dir), close)
    return t.select("symbol", F.round("profit_ratio", 6).alias("profit_ratio"), F.round("mean_cost", 5).alias("mean_cost"))


@query(f"WITH {_CHIP} SELECT symbol, bucket::INTEGER AS bucket, round(price, 6) AS price, round(mass, 8) AS mass FROM chip")
def chip_sql(spark, sf_dir):
    """The distribution as a table function in SQL text."""
    sql.register(spark)
    bars = weekly_brand_bars(spark, sf_dir).withColumn("turnover", _c("volume") / 1000)
    return spark.sql("SELECT symbol, bucket, round(price, 6) AS price, round(mass, 8) AS mass FROM chip_histogram(TABLE({bars}), buckets => 150)", bars=bars)


_M = f"{BARS}, m AS (SELECT symbol, trade_date, close / lag(close, 19) OVER ({S}) - 1 AS m20, close / lag(close, 5) OVER ({S}) - 1 AS m5 FROM bars)"


@query(f"WITH {_M}, r AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY m5 DESC, symbol) AS rank FROM m WHERE m20 > 0 AND m5 IS NOT NULL) SELECT trade_date, symbol, rank, 0.5::DOUBLE / count(*) OVER (PARTITION BY trade_date) AS weight FROM r WHERE rank <= 5")
def mom_hedge(spark, sf_dir):
    return bt.momentum_hedge(weekly_brand_bars(spark, sf_dir))


@query(f"WITH {_M} SELECT symbol, round(arg_max(m20, trade_date) * 100, 6) AS m FROM m WHERE m20 IS NOT NULL GROUP BY 1")
def mom_one(spark, sf_dir):
    t = weekly_brand_bars(spark, sf_dir).withColumn("m", bt.momentum(20)).where("m is not null")
    return t.groupBy("symbol").agg(F.round(F.max_by("m", "trade_date") * 100, 6).alias("m"))


_REPORT = f"""WITH {BARS}, p AS (SELECT symbol, trade_date, close FROM bars WHERE close <> 0), d AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS i, count(*) OVER () AS n FROM p WHERE symbol = 'Brand#25'),
    rb AS (SELECT i AS r, greatest(i - 5, 0) AS r5, greatest(i - 4, 0) AS r4 FROM d WHERE (n - 1 - i) % 5 = 0), x AS (SELECT p.*, i FROM p JOIN d USING (trade_date)),
    m AS (SELECT symbol, r, count(*) AS k, round((arg_max(close, i) / arg_min(close, i) - 1) * 100, 1) AS m, round((max(close) FILTER (i = r) / max(close) FILTER (i = r5) - 1) * 100, 1) AS m5,
        coalesce(round((max(close) FILTER (i = r) / max(close) FILTER (i = r4) - 1) * 100, 1), 0) AS w FROM rb JOIN x ON i <= r AND i > r - 20 GROUP BY 1, 2),
    q AS (SELECT * FROM m WHERE symbol NOT IN ('Brand#25', 'Brand#24') AND k > 1),
    t AS (SELECT * FROM q WHERE m > 0 AND m5 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY r ORDER BY m5 DESC, symbol) <= 5),
    a AS (SELECT rb.r, rb.r5, coalesce(g.top, []) AS top, coalesce(g.gain, 0) AS gain FROM rb LEFT JOIN (SELECT r, list(symbol ORDER BY m5 DESC, symbol) AS top, avg(m5) AS gain FROM t GROUP BY 1) g USING (r)),
    b AS (SELECT *, coalesce(lag(top) OVER (ORDER BY r), []) AS bf FROM a)
    SELECT d.trade_date::VARCHAR AS date, s.trade_date::VARCHAR AS week_start, (SELECT count(*) FROM q WHERE q.r = b.r) AS pool_size, array_to_string(top, ',') AS top, array_to_string(list_filter(top, lambda x: NOT list_contains(bf, x)), ',') AS added,
        array_to_string(list_sort(list_filter(bf, lambda x: NOT list_contains(top, x))), ',') AS removed, array_to_string(list_filter(top, lambda x: list_contains(bf, x)), ',') AS kept,
        round(gain * 0.5::DOUBLE + iv.w * 0.5::DOUBLE, 1) AS strategy_w, bn.w AS bench_w, iv.w AS inverse_w
    FROM b JOIN d ON d.i = b.r JOIN d s ON s.i = b.r5 JOIN m bn ON bn.r = b.r AND bn.symbol = 'Brand#25' JOIN m iv ON iv.r = b.r AND iv.symbol = 'Brand#24'"""


@query(_REPORT)
def mom_report(spark, sf_dir):
    return bt.momentum_report(weekly_brand_bars(spark, sf_dir), "Brand#25", "Brand#24")


# The batch forms of the streams: the same plans over a bounded table (tests run them as streams too).


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, max(value) AS hi FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf_dir):
    from quantloom.streaming import snapshots

    return snapshots.tumbling(table(spark, sf_dir, "events"))


@query("""SELECT w AS start, user_id, count(*) AS n FROM (SELECT user_id, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS w FROM events) GROUP BY 1, 2""")
def stream_sliding(spark, sf_dir):
    from quantloom.streaming import snapshots

    return snapshots.sliding(table(spark, sf_dir, "events"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT min(ts) AS start, user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark, sf_dir):
    from quantloom.streaming import snapshots

    return snapshots.sessions(table(spark, sf_dir, "events"))


@query("SELECT user_id, max(ts) AS ts FROM events GROUP BY 1")
def stream_snapshot(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, sf_dir, "events").withColumn("r", F.row_number().over(w)).where("r = 1").select("user_id", "ts")


# Streams that run as such, over the whole table, into a Parquet sink that is read back.


_HISTORY = "SELECT min(ts) + (max(ts) - min(ts)) / 2 AS cut, max(ts) AS newest FROM events"


@query(f"""WITH c AS ({_HISTORY}), s AS (
        SELECT user_id, arg_max(ts, (ts, event_id)) AS ts, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1)
    SELECT user_id, epoch_us(ts) AS at, value, CASE WHEN ts < cut THEN 'history' ELSE 'quote' END AS source, ts + INTERVAL 1 DAY < newest AS stale
    FROM s, c WHERE ts >= cut OR ts + INTERVAL 1 DAY < newest""")
def stream_bootstrap(spark, sf_dir):
    """The first half of the time is history, the second the stream. A key that the stream never names shows up once it is stale."""
    t = table(spark, sf_dir, "events")
    lo, hi = t.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))), F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    cut = (lo or 0) + ((hi or 0) - (lo or 0)) // 2
    quotes = snapshots.read_events(spark, sf_dir).where(at >= cut)
    changes = stateful.bootstrapped_snapshot(quotes, t.where(at < cut), "user_id", "ts", "event_id", "value")
    rows = stateful.run_to_table(changes, scratch(spark, "bootstrap"))
    last = rows.groupBy(F.col("key").alias("user_id")).agg(F.max_by(F.struct("at", "value", "source"), F.struct("at", "id")).alias("r"), F.max(F.when(F.col("kind") == "stale", F.col("at"))).alias("s"))
    return last.select("user_id", "r.at", "r.value", "r.source", F.coalesce(F.col("s") == F.col("r.at"), F.lit(False)).alias("stale"))


@query("""WITH e AS (SELECT user_id, ts, event_id, event_type = 'click' AS take FROM events WHERE event_type IN ('click', 'purchase')),
    n AS (SELECT *, lead(ts) OVER w AS nxt, count(*) FILTER (NOT take) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS acks FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    x AS (SELECT * FROM n WHERE take AND ts + INTERVAL 2 HOUR < coalesce(nxt, (SELECT max(ts) FROM events)))
    SELECT user_id, epoch_us(ts + INTERVAL 2 HOUR) AS at, row_number() OVER (PARTITION BY user_id, acks ORDER BY ts, event_id) AS tries FROM x""")
def stream_requeue(spark, sf_dir):
    """A click takes the user's task, a purchase acknowledges it; what is held for over two hours goes back."""
    action = F.when(F.col("event_type") == "click", "take").when(F.col("event_type") == "purchase", "ack").otherwise("other")
    events = snapshots.read_events(spark, sf_dir).withColumn("action", action)
    rows = stateful.run_to_table(stateful.requeued(events, "user_id", "ts", "event_id", "action", "2 hours"), scratch(spark, "requeue"))
    return rows.select(F.col("task").alias("user_id"), "at", "tries")
