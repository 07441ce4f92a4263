"""Logs made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keys import be
from ..operators.schema import LOG, ColumnFamily, Registry
from ..operators.writes import log_frame

REGISTRY = Registry(
    [ColumnFamily("events", 1, 8), ColumnFamily("orders", 2, 16, 8), ColumnFamily("lines", 3, 12, 8), ColumnFamily("pages", 4, None, 4, purge_at=0), ColumnFamily("documents", 5, 8), ColumnFamily("unused", 6)]
)
#: Sequence numbers in a segment of each log.
SEGMENT = {"events": 1000, "orders": 1500, "lines": 6000, "pages": 50, "documents": 250}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _log(rows: DataFrame, cf: str) -> DataFrame:
    rows = rows.withColumn("cf", F.lit(cf)).withColumn("segment_id", (F.floor((F.col("lsn") - 1) / SEGMENT[cf]) + 1).cast("int"))
    return log_frame(rows).select(*LOG.fieldNames())


def events(spark: SparkSession, sf_dir: str, after: int | None = None, upto: int | None = None) -> DataFrame:
    """Keys are users; errors delete a user, every 97th signup the range of eight users from its own on. Numbers after one and up to another are read alone."""
    e = _read(spark, sf_dir, "events")
    if after is not None and upto is not None:  # numbers are ids and 1: said of ids, it reaches the scan
        e = e.where((F.col("event_id") >= after) & (F.col("event_id") < upto))
    kind = F.when((F.col("event_type") == "signup") & (F.col("event_id") % 97 == 0), 2).when(F.col("event_type") == "error", 1).otherwise(0)
    return _log(e.select((F.col("event_id") + 1).alias("lsn"), be(F.col("user_id"), 8).alias("k"), kind.alias("kind"), F.when(kind == 2, be(F.col("user_id") + 8, 8)).alias("range_end"), F.encode("props", "utf-8").alias("v")), "events")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    return _log(o.select((F.col("o_orderkey") + 1).alias("lsn"), F.concat(be(F.col("o_custkey"), 8), be(F.col("o_orderkey"), 8)).alias("k"), F.lit(0).alias("kind"), F.encode("o_orderpriority", "utf-8").alias("v")), "orders")


LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lsn by a total order of all rows: ranks inside each order are added to the number of rows of the orders before it, by ranges of order keys, so that no task sorts the whole table."""
    rows = _read(spark, sf_dir, "lineitem").select(*LINE_ORDER)
    part = F.shiftright("l_orderkey", 10)
    sums = rows.groupBy(part.alias("part")).count()
    before = sums.select("part", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rows = rows.withColumn("part", part).join(F.broadcast(before), "part")
    lsn = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(*LINE_ORDER))
    return _log(rows.select(lsn.alias("lsn"), F.concat(be(F.col("l_orderkey"), 8), be(F.col("l_linenumber"), 4)).alias("k"), F.lit(0).alias("kind"), F.encode(F.concat("l_returnflag", "l_linestatus"), "utf-8").alias("v")), "lines")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "pages")
    return _log(p.select((F.col("page_id") + 1).alias("lsn"), F.encode("url", "utf-8").alias("k"), F.lit(0).alias("kind"), F.encode("html", "utf-8").alias("v")), "pages")


def page_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages with keys of their own: the url (null: empty), a zero byte and the page's number. Pages that share a url don't replace each other."""
    p = _read(spark, sf_dir, "pages")
    k = F.concat(F.coalesce(F.encode("url", "utf-8"), F.lit(b"")), F.lit(b"\0"), be(F.col("page_id"), 8))
    return _log(p.select((F.col("page_id") + 1).alias("lsn"), k.alias("k"), F.lit(0).alias("kind"), F.encode("html", "utf-8").alias("v")), "pages")


def url_of(k: Column) -> Column:
    """The url in a key of ``page_entries``."""
    return F.substring(k, F.lit(1), F.octet_length(k) - 9)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "documents")
    return _log(d.select((F.col("doc_id") + 1).alias("lsn"), be(F.col("doc_id"), 8).alias("k"), F.lit(0).alias("kind"), F.encode("text", "utf-8").alias("v")), "documents")
