"""Readers, writers and cached stages of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .cache import ParquetCache


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",", header: bool = True) -> DataFrame:
    return spark.read.csv(path, schema=schema, sep=sep, header=header)


def parse_line(text: Column, schema: str) -> Column:
    """A line as CSV, else tab-separated, else by white space, in the first form that gives all its fields."""
    fields = len(schema.split(","))
    forms = [("," , text), ("\t", text), (" ", F.regexp_replace(F.trim(text), r"\s+", " "))]
    parsed = [F.when(F.size(F.split(x, sep)) >= fields, F.from_csv(x, schema, {"sep": sep})) for sep, x in forms]
    return F.coalesce(*parsed)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_html(df: DataFrame, path: str, title: str, order: list[Column]) -> None:
    """A page with one table, rows in ``order``, numbers with two decimals, texts escaped. For reports of bounded size: it is one file."""

    def cell(name: str, kind: str) -> Column:
        x = F.format_string("%.2f", F.col(name)) if kind in ("double", "float") else F.col(name).cast("string")
        for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            x = F.replace(x, F.lit(sign), F.lit(entity))
        return F.concat(F.lit("<td>"), F.coalesce(x, F.lit("")), F.lit("</td>"))

    head = f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{title}</title></head><body><table><tr>" + "".join(f"<th>{c}</th>" for c in df.columns) + "</tr>"
    rows = df.orderBy(*order).coalesce(1).select(F.concat(F.lit("<tr>"), *[cell(c, t) for c, t in df.dtypes], F.lit("</tr>")).alias("line"))
    spark = df.sparkSession
    page = spark.createDataFrame([(head,)], "line string").coalesce(1).union(rows).union(spark.createDataFrame([("</table></body></html>",)], "line string").coalesce(1))
    page.coalesce(1).write.mode("overwrite").text(path)


def read_html_rows(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The cells of a page that ``write_html`` wrote, as texts."""
    cells = F.regexp_extract_all("value", F.lit("<td>([^<]*)</td>"), 1)
    t = spark.read.text(path).where(F.col("value").startswith("<tr>")).select(cells.alias("c"))
    out = [F.get("c", F.lit(k)) for k in range(len(columns))]
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        out = [F.replace(x, F.lit(entity), F.lit(sign)) for x in out]
    return t.select(*[x.alias(c) for x, c in zip(out, columns)])


def cached(spark: SparkSession, root: str, key: str, make: Callable[[], DataFrame], ttl: float | None = None) -> DataFrame:
    """``make()`` stored as Parquet under the key; read back while it is there and not older than ``ttl`` seconds."""
    return ParquetCache(spark, root).get_or_make(key, make, ttl)


def retained(df: DataFrame, ts: str, days: int) -> DataFrame:
    """Rows of the last ``days`` before the newest."""
    newest = df.agg(F.max(ts).alias("__newest"))
    # One row, whatever the table.
    return df.join(F.broadcast(newest), F.col(ts) >= F.col("__newest") - F.expr(f"interval {days} days")).drop("__newest")
