"""The driver's `events` table seen as alerts, with redeliveries and late arrivals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertweave.session import configure

REDELIVERY_OFFSET = 1_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_alerts(events: DataFrame) -> DataFrame:
    """Alert rows of an events table: one delivery each, plus a redelivery of every tenth event."""
    user, event, value = F.col("user_id"), F.col("event_type"), F.col("value")
    text = lambda c: c.cast("string")
    ts = F.col("ts").cast("timestamp")
    delay = F.when(F.col("event_id") % 20 == 0, 180).otherwise(F.col("event_id") % 7)
    once = events.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("tenant_"), text(user % 4)).alias("tenant_id"),
        text(F.col("event_id")).alias("source_event_id"),
        ts.alias("timestamp"),
        (ts + F.make_dt_interval(mins=delay.cast("int"))).alias("ingested_at"),
        F.when(event.isin("signup", "click"), "IAM").when(event == "view", "FIREWALL").otherwise("XDR").alias("source_type"),
        F.lit("MockVendor").alias("source_vendor"),
        F.concat(F.lit("Product_"), event).alias("source_product"),
        event.alias("alert_type"),
        F.when(value >= 150, "CRITICAL").when(value >= 80, "HIGH").when(value >= 40, "MEDIUM")
        .when(value >= 15, "LOW").otherwise("INFO").alias("severity"),
        F.when(event != "view", F.when(user % 37 == 0, "SYSTEM").otherwise(F.concat(F.lit("user_"), text(user)))).alias("user"),
        F.when(event.isin("error", "purchase"), F.concat(F.lit("host_"), text(F.expr("user_id div 3")))).alias("host"),
        F.concat(F.lit("10.0."), text(user % 7), F.lit("."), text(user % 50)).alias("src_ip"),
        F.when(event == "view", F.concat(F.lit("203.0.113."), text(F.col("event_id") % 200))).alias("dst_ip"),
        F.lit(None).cast("string").alias("domain"),
        F.lit(None).cast("string").alias("process_name"),
        F.when(event == "error", F.concat(F.lit("hash_"), F.get_json_object("props", "$.k"))).alias("file_hash"),
        F.when(event == "view", "NETWORK_ACTIVITY").when(event.isin("signup", "click"), "AUTHENTICATION")
        .otherwise("ENDPOINT_ACTIVITY").alias("category_name"),
    )
    again = once.where("id % 10 = 0").select(
        *[
            (F.col("id") + REDELIVERY_OFFSET).alias("id") if c == "id"
            else (F.col("timestamp") + F.make_dt_interval(mins=F.lit(30))).alias(c) if c == "ingested_at"
            else F.col(c)
            for c in once.columns
        ]
    )
    return once.unionByName(again)


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_alerts(table(spark, sf_dir, "events"))
