"""Views over the driver's test tables that give the operators their inputs.

They are test inputs, not operators: each maps a generic table onto the
shape a market/news operator reads (see FIXTURES.md, part B).  The same
definitions exist as DuckDB SQL in ``checks/oracle.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# The eight names excluded from the listing adapter (stand-ins
# for the stablecoin exclusion list).
LISTING_EXCLUDED = [
    "Customer#000000001", "Customer#000000002", "Customer#000000003", "Customer#000000004",
    "Customer#000000005", "Customer#000000006", "Customer#000000007", "Customer#000000008",
]


# Declared schemas of the driver's tables: the scan needs no schema
# inference (no footer reads while the plan is built).
TABLE_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": ("p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
             "p_retailprice double"),
    "orders": ("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
               "o_orderdate timestamp_ntz, o_orderpriority string"),
    "lineitem": ("l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                 "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                 "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"),
    "events": ("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
               "props string"),
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


# Job setting: how many partitions the long texts are dealt out to after the
# scan.  For a table that is one row group (which Spark reads in one task);
# unset, as for every table of many row groups, the scan's own splits stay.
TEXT_PARTITIONS = "spark.marketpulse.textPartitions"
TEXT_TABLES = ("documents", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read
    if name in TABLE_SCHEMAS:
        reader = reader.schema(TABLE_SCHEMAS[name])
    df = reader.parquet(f"{sf_dir}/{name}.parquet")
    n = int(spark.conf.get(TEXT_PARTITIONS, "0"))
    return df.repartition(n) if n and name in TEXT_TABLES else df


def prices_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars: symbol = order priority, Close = day's total price."""
    o = table(spark, sf_dir, "orders")
    return (o.groupBy(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("Date"))
             .agg(F.round(F.sum("o_totalprice"), 2).alias("Close"),
                  F.count(F.lit(1)).cast("double").alias("Volume")))


def bars_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly OHLCV bars per event type (input of the streaming tests)."""
    e = table(spark, sf_dir, "events")
    return (e.groupBy(F.col("event_type").alias("symbol"),
                      F.date_trunc("hour", F.col("ts")).alias("Date"))
             .agg(F.max_by("value", "ts").alias("Close"), F.min_by("value", "ts").alias("Open"),
                  F.max("value").alias("High"), F.min("value").alias("Low"),
                  F.count(F.lit(1)).cast("double").alias("Volume")))


def news_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles: first line = title, the rest = body, id = md5(title || body)."""
    d = table(spark, sf_dir, "documents")
    title = F.substring_index(F.col("text"), "\n", 1)
    body = F.expr("substr(text, length(substring_index(text, '\n', 1)) + 2)")
    return (d.select(
        F.col("doc_id"),
        title.alias("title"),
        body.alias("body"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
         + F.make_dt_interval(F.lit(0), F.lit(0), F.col("doc_id").cast("int"))).alias("published_at"),
        F.concat(F.lit("https://news.example/"), F.col("doc_id").cast("string")).alias("url"),
        F.concat_ws("|", F.col("lang"), F.col("source")).alias("keywords"))
        .withColumn("id", F.md5(F.concat(F.col("title"), F.col("body")))))


def vectors_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector records: embeddings keyed by doc id, metadata from ``news_v``."""
    e = table(spark, sf_dir, "embeddings")
    n = news_v(spark, sf_dir)
    return (e.join(n, e.vec_id == n.doc_id, "inner")
             .select(e.vec_id.alias("vec_id"), n.id.alias("news_id"), n.title, n.body,
                     F.concat_ws("\n", n.title, n.body).alias("content"), e.embedding,
                     n.published_at,
                     F.unix_timestamp(n.published_at.cast("timestamp")).cast("double").alias("timestamp")))


def questions_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query vectors: every embedding is also a question (its nearest
    articles are its related news)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))


def chat_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat messages: conversation = session, role mapped to sender."""
    c = table(spark, sf_dir, "conversations")
    created = (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
               + F.make_dt_interval(F.lit(0), F.col("conv_id").cast("int"), F.col("turn").cast("int")))
    sender = (F.when(F.col("role") == "user", "user")
               .when(F.col("role") == "assistant", "bot").otherwise(F.col("role")))
    return c.select(
        F.concat(F.lit("m-"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("id"),
        F.concat(F.lit("s-"), F.col("conv_id").cast("string")).alias("session_id"),
        sender.alias("sender"), F.col("text").alias("message"), created.alias("created_at"),
        F.col("conv_id"), F.col("turn"))


def sessions_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One session row per conversation; every third keeps a default title."""
    c = table(spark, sf_dir, "conversations")
    first = c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("first_text"))
    title = F.when(F.col("conv_id") % 3 == 0,
                   F.concat(F.lit("新對話 "), (F.col("conv_id") / 3 + 1).cast("long").cast("string")))\
             .otherwise(F.col("first_text"))
    return first.select(
        F.concat(F.lit("s-"), F.col("conv_id").cast("string")).alias("id"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
         + F.make_dt_interval(F.lit(0), F.col("conv_id").cast("int"))).alias("created_at"),
        title.alias("title"))


def listings_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coin listing: symbol = customer name, market cap = account balance."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_name").alias("symbol"), F.col("c_acctbal").alias("market_cap"),
                    F.col("c_custkey").alias("pos"))


def labels_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled texts for the default sentiment classifier."""
    lab = table(spark, sf_dir, "labels")
    d = table(spark, sf_dir, "documents")
    return lab.join(d, "doc_id").select("doc_id", "text", F.col("quality").alias("label"))
