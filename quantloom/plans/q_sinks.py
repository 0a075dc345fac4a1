"""Queries of sinks and files: each writes whole tables to the shared folder and returns what it reads back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.sources import files, merge
from quantloom.sources.bars import SNAPSHOT, customer_snapshot, table
from quantloom.sources.cache import ParquetCache
from quantloom.sources.shared import scratch
from quantloom.streaming.snapshots import read_events

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


def _merged(spark: SparkSession, name: str, keys: list[str], batches: list[tuple[str, DataFrame]], **options) -> DataFrame:
    path = scratch(spark, name)
    for batch, rows in batches:
        merge.merge_batch(rows, path, keys, batch, **options)
    return merge.read_table(spark, path)


# --- keyed merges ----------------------------------------------------------------------------------------------------


@query("""SELECT user_id AS symbol, ts::DATE::VARCHAR AS trade_date, event_type AS data_source, arg_max(value, (hour(ts) >= 12, ts, event_id)) AS value,
    arg_max(event_id, (hour(ts) >= 12, ts, event_id)) AS event_id FROM events GROUP BY 1, 2, 3""")
def snk_upsert_hist(spark, sf_dir):
    """Morning, then afternoon; the morning comes once more and is known by its batch."""
    t = table(spark, sf_dir, "events")
    rows = t.select(_c("user_id").alias("symbol"), F.to_date("ts").cast("string").alias("trade_date"), _c("event_type").alias("data_source"), "value", "event_id", "ts")
    morning, afternoon = rows.where(F.hour("ts") < 12), rows.where(F.hour("ts") >= 12)
    out = _merged(spark, "hist", ["symbol", "trade_date", "data_source"], [("am", morning), ("pm", afternoon), ("am", morning)], order=["ts", "event_id"])
    return out.drop("ts")


@query("""SELECT o_custkey AS symbol, year(o_orderdate) || 'Q' || quarter(o_orderdate) AS report_period, o_orderpriority AS data_source,
    arg_max(o_totalprice, (o_orderstatus, o_orderdate, o_orderkey)) AS revenue, arg_max(o_orderkey, (o_orderstatus, o_orderdate, o_orderkey)) AS o_orderkey
    FROM orders GROUP BY 1, 2, 3""")
def snk_upsert_fin(spark, sf_dir):
    """A batch for each status; a later one replaces a company's period of the same source."""
    t = table(spark, sf_dir, "orders")
    period = F.concat(F.year("o_orderdate"), F.lit("Q"), F.quarter("o_orderdate"))
    rows = t.select(_c("o_custkey").alias("symbol"), period.alias("report_period"), _c("o_orderpriority").alias("data_source"), _c("o_totalprice").alias("revenue"), "o_orderkey", "o_orderdate", "o_orderstatus")
    batches = [(s, rows.where(_c("o_orderstatus") == s)) for s in ("F", "O", "P")]
    return _merged(spark, "fin", ["symbol", "report_period", "data_source"], batches, order=["o_orderdate", "o_orderkey"]).drop("o_orderdate", "o_orderstatus")


@query("SELECT source, lang, max(n_chars) AS n_chars, arg_max(doc_id, (n_chars, doc_id)) AS doc_id FROM documents GROUP BY 1, 2")
def snk_upsert_news(spark, sf_dir):
    """The greater version wins whichever batch brings it: long documents come first here."""
    rows = table(spark, sf_dir, "documents").select("source", "lang", "n_chars", "doc_id")
    batches = [("long", rows.where("n_chars >= 2000")), ("short", rows.where("n_chars < 2000"))]
    return _merged(spark, "news", ["source", "lang"], batches, order=["doc_id"], version="n_chars")


@query("SELECT conv_id AS message_id, role AS platform, max(turn) AS turn, arg_max(text, turn) AS content FROM conversations GROUP BY 1, 2")
def snk_upsert_social(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").select(_c("conv_id").alias("message_id"), _c("role").alias("platform"), "turn", _c("text").alias("content"))
    return _merged(spark, "social", ["message_id", "platform"], [("opening", t.where("turn < 2")), ("rest", t.where("turn >= 2"))], order=["turn"])


@query("SELECT user_id AS message_id, max(event_type) AS kind, arg_max(props, (event_type, ts, event_id)) AS content, arg_max(event_id, (event_type, ts, event_id)) AS event_id FROM events GROUP BY 1")
def snk_upsert_internal(spark, sf_dir):
    """Departments by name, one batch each: the last one replaces the message; further columns of a batch widen the table."""
    t = table(spark, sf_dir, "events").select(_c("user_id").alias("message_id"), _c("event_type").alias("kind"), _c("props").alias("content"), "event_id", "ts")
    kinds = [r[0] for r in t.select("kind").distinct().orderBy("kind").collect()]  # event types, five of them
    return _merged(spark, "internal", ["message_id"], [(k, t.where(_c("kind") == k)) for k in kinds], order=["ts", "event_id"]).drop("ts")


@query("SELECT user_id, max(ts) AS ts, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1")
def snk_quotes(spark, sf_dir):
    """A stream of quotes merged into the snapshot on disk, micro-batch by micro-batch."""
    path = scratch(spark, "quotes")
    quotes = read_events(spark, sf_dir).select("user_id", "ts", "value", F.struct("ts", "event_id").alias("version"))
    merge.merge_stream(quotes, path, ["user_id"], f"{path}/checkpoint", version="version").awaitTermination()
    return merge.read_table(spark, path).select("user_id", _c("ts").cast("timestamp_ntz").alias("ts"), "value")


@query(f"WITH {SNAPSHOT} SELECT c.c_custkey AS code, c_name AS name, snap.total_mv / 10000 AS total_mv FROM customer c LEFT JOIN snap ON snap.code = c.c_custkey")
def snk_basics(spark, sf_dir):
    """Names first; the sync with market values then replaces the rows it has."""
    names = table(spark, sf_dir, "customer").select(_c("c_custkey").alias("code"), _c("c_name").alias("name"))
    metrics = customer_snapshot(spark, sf_dir).select("code", "name", (_c("total_mv") / 10000).alias("total_mv")).where("total_mv is not null")
    return _merged(spark, "basics", ["code"], [("names", names), ("metrics", metrics)])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) - INTERVAL 365 DAY FROM orders)")
def snk_retention(spark, sf_dir):
    path = scratch(spark, "retention")
    merge.merge_batch(table(spark, sf_dir, "orders"), path, ["o_orderkey"], "all")
    newest = merge.read_table(spark, path).agg(F.max("o_orderdate")).first()[0]
    if newest is not None:
        merge.retain(spark, path, _c("o_orderdate") >= F.lit(newest) - F.expr("interval 365 days"), "drop")
    return merge.read_table(spark, path).select("o_orderkey", "o_totalprice")


# --- files -----------------------------------------------------------------------------------------------------------


@query("SELECT to_json({'event_id': event_id, 'user_id': user_id})::VARCHAR AS row FROM events")
def snk_export(spark, sf_dir):
    path = scratch(spark, "export")
    files.write_json(table(spark, sf_dir, "events").select("event_id", "user_id"), f"{path}/events")
    return spark.read.text(f"{path}/events").select(_c("value").alias("row"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def snk_import(spark, sf_dir):
    """Documents exported as JSON lines and imported under a schema, keyed: a second import replaces them."""
    path = scratch(spark, "import")
    t = table(spark, sf_dir, "events").select("event_id", "props")
    files.write_json(t, f"{path}/export")
    got = spark.read.schema("event_id long, props string").json(f"{path}/export").select("event_id", F.from_json("props", "k long")["k"].alias("k"))
    for batch in ("first", "again"):
        merge.merge_batch(got, f"{path}/table", ["event_id"], batch)
    return merge.read_table(spark, f"{path}/table")


@query(f"""WITH {SNAPSHOT} SELECT code, name, printf('%.2f', total_mv) AS shown, total_mv FROM snap WHERE total_mv IS NOT NULL ORDER BY total_mv DESC, code LIMIT 50""")
def snk_csv_html(spark, sf_dir):
    """The report's 50 companies as CSV and as a page; both are read back and joined."""
    path = scratch(spark, "report")
    top = customer_snapshot(spark, sf_dir).select("code", "name", "total_mv").where("total_mv is not null").orderBy(F.desc("total_mv"), "code").limit(50)
    ParquetCache(spark, f"{path}/cache").get_or_make("report:top", lambda: top)
    top = ParquetCache(spark, f"{path}/cache").get("report:top")
    files.write_csv(top, f"{path}/csv")
    files.write_html(top, f"{path}/html", "Report", [F.desc("total_mv"), F.asc("code")])
    page = files.read_html_rows(spark, f"{path}/html", ["code", "name", "shown"]).withColumn("code", _c("code").cast("long"))
    return files.read_csv(spark, f"{path}/csv", "code long, name string, total_mv double").join(page.drop("name"), "code").select("code", "name", "shown", "total_mv")


@query("SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def src_csv(spark, sf_dir):
    path = scratch(spark, "csv")
    files.write_csv(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), path)
    return files.read_csv(spark, path, "c_custkey long, c_name string, c_acctbal double, c_mktsegment string")


@query("SELECT c_custkey AS code, c_mktsegment AS industry, c_acctbal AS balance FROM customer")
def src_parse_text(spark, sf_dir):
    """Lines with commas, tabs or blanks by nation, told apart line by line."""
    path = scratch(spark, "lines")
    t = table(spark, sf_dir, "customer")
    sep = F.element_at(F.array(F.lit(","), F.lit("\t"), F.lit("   ")), (_c("c_nationkey") % 3 + 1).cast("int"))
    t.select(F.concat(_c("c_custkey").cast("string"), sep, _c("c_mktsegment"), sep, _c("c_acctbal").cast("string")).alias("line")).write.text(f"{path}/lines")
    p = spark.read.text(f"{path}/lines").select(files.parse_line(_c("value"), "code long, industry string, balance double").alias("p"))
    return p.select("p.*")


@query("SELECT o_orderpriority AS k, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def src_parquet_cache(spark, sf_dir):
    """Kept, expired, made anew and invalidated by prefix; what is read in the end is the last generation."""
    at = [1000.0]
    cache = ParquetCache(spark, scratch(spark, "cache"), clock=lambda: at[0])
    orders = table(spark, sf_dir, "orders")
    make = lambda: orders.groupBy(_c("o_orderpriority").alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    cache.get_or_make("orders:stale", lambda: make().withColumn("n", F.lit(0).cast("long")), ttl=60)
    at[0] += 61
    cache.get_or_make("orders:stale", make, ttl=60)
    cache.get_or_make("orders:priority", lambda: make().limit(0), ttl=60)
    cache.invalidate("orders:p")
    cache.get_or_make("orders:priority", lambda: cache.get("orders:stale", ttl=60), ttl=60)
    return cache.get("orders:priority")
