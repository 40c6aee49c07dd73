"""Bindings of the tables' roles to the sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilsight.functions.text import RuleSplitter

#: Lines that a task gathers to orders, about, however many there are in all.
TASK_LINES = 250_000
#: Labels of so many documents at most are broadcast, some 60 bytes each.
BROADCAST_LABELS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def basket(spark: SparkSession, sf_dir: str, term: str = "p_brand") -> DataFrame:
    """uuid (customer), field (order priority), clause_pos (order), term, label (of the line): a row a line."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    parts = table(spark, sf_dir, "part").select("p_partkey", term)
    label = F.when(F.col("l_returnflag") == "R", "PII").when(F.col("l_returnflag") == "A", "PROFILE").otherwise("NONE")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(F.col("o_custkey").alias("uuid"), F.col("o_orderpriority").alias("field"), F.col("l_orderkey").alias("clause_pos"), F.col(term).alias("term"), label.alias("label"))


def basket_orders(spark: SparkSession, sf_dir: str, term: str = "p_brand") -> DataFrame:
    """uuid, field, clause_pos, matched_terms (sorted) and label (the largest) of each order: `basket` by order.

    Lines are gathered by order before they meet the orders, so that they move once more
    and without the orders' columns, in as many parts as keep a part's size.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    parts = table(spark, sf_dir, "part").select("p_partkey", term)
    label = F.when(F.col("l_returnflag") == "R", "PII").when(F.col("l_returnflag") == "A", "PROFILE").otherwise("NONE")
    n = max(spark.sparkContext.defaultParallelism, lines.count() // TASK_LINES)
    rows = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("clause_pos"), F.col(term).alias("term"), label.alias("label"))
    gathered = rows.repartition(n, "clause_pos").groupBy("clause_pos").agg(F.array_sort(F.collect_set("term")).alias("matched_terms"), F.max("label").alias("label"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("uuid"), F.col("o_orderpriority").alias("field"), F.col("o_orderkey").alias("clause_pos"))
    # an order that is listed twice alike is one
    orders = orders.repartition(n, "clause_pos").dropDuplicates()
    return orders.join(gathered, "clause_pos").select("uuid", "field", "clause_pos", "matched_terms", "label")


def basket_detail(spark: SparkSession, sf_dir: str, term: str = "p_brand") -> DataFrame:
    """The detail table: an order's sorted set of terms."""
    return basket_orders(spark, sf_dir, term).drop("label")


def basket_spans(spark: SparkSession, sf_dir: str, term: str = "p_brand") -> DataFrame:
    """uuid, field, clause_pos, clause, label: an order as a span with its largest label."""
    return spans_of(basket_orders(spark, sf_dir, term))


def spans_of(orders: DataFrame) -> DataFrame:
    """Orders as spans: a span's name is the order's, and for every fourth order the customer's, so that some repeat."""
    rows = orders.select("uuid", "field", "clause_pos", "label")
    name = F.when(F.col("clause_pos") % 4 == 0, F.concat(F.lit("customer "), F.col("uuid").cast("string"))).otherwise(F.concat(F.lit("order "), F.col("clause_pos").cast("string")))
    return rows.withColumn("clause", name)


def basket_texts(spark: SparkSession, sf_dir: str, term: str = "p_brand") -> DataFrame:
    """basket_detail with text: the orders of a year and status are a text of their field."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("clause_pos"), F.concat(F.year("o_orderdate").cast("string"), F.col("o_orderstatus")).alias("text"))
    return basket_detail(spark, sf_dir, term).join(orders, "clause_pos")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uuid, field, text, label of documents that are labelled."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    labels = table(spark, sf_dir, "labels")
    label = F.when(F.col("toxic") == 1, "PII").when(F.col("quality") == 1, "PROFILE").otherwise("NONE")
    # labels are counted, so that texts do not move
    labels = labels.select("doc_id", label.alias("label"))
    labels = F.broadcast(labels) if labels.count() <= BROADCAST_LABELS else labels
    return docs.join(labels, "doc_id").select(F.col("doc_id").alias("uuid"), F.col("source").alias("field"), "text", "label")


def text_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uuid, field, clause_pos, clause, label."""
    rows = texts(spark, sf_dir).withColumn("_c", RuleSplitter().split(F.col("text")))
    return rows.select("uuid", "field", F.posexplode("_c").alias("clause_pos", "clause"), "label")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """y_true, y_pred, split and support made of events: risk of a user's rare values, and a rough guess at it."""
    e = table(spark, sf_dir, "events")
    y = F.round(F.log10(F.lit(1000.0) / (1 + F.pmod(F.col("event_id") * 7919, F.lit(1000)))), 6)
    guess = F.round(y + F.pmod(F.col("event_id") * 31, F.lit(17)) / 17.0 - 0.5, 2)
    return e.select(y.alias("y_true"), guess.alias("y_pred"), F.when(F.col("event_id") % 5 == 0, "test").otherwise("train").alias("split"), (1 + F.pmod(F.col("event_id") * 7919, F.lit(1000))).alias("support"))
