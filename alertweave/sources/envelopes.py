"""Alert envelopes, in tables, files or streams: single, batch and webhook deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertweave import model


def read_envelopes(spark: SparkSession, path: str) -> DataFrame:
    """Envelopes stored as JSON lines; the payload object is kept as JSON text."""
    return spark.read.schema(model.ENVELOPE_SCHEMA).json(path)


def stream_envelopes(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(model.ENVELOPE_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)


def from_kafka_value(messages: DataFrame) -> DataFrame:
    """Envelopes out of the value column of a Kafka source."""
    return messages.select(
        F.from_json(F.col("value").cast("string"), model.ENVELOPE_SCHEMA).alias("_e")
    ).select("_e.*")


def webhook_envelopes(hooks: DataFrame) -> DataFrame:
    """Envelopes of bare webhook payloads (columns tenant_id, payload); missing parts get defaults."""
    v = F.try_parse_json("payload")

    def part(name: str, default: str):
        given = F.try_variant_get(v, f"$.{name}", "variant").isNotNull()
        return F.when(given, F.try_variant_get(v, f"$.{name}", "string")).otherwise(F.lit(default))

    return hooks.select(
        F.coalesce("tenant_id", F.lit("default-tenant")).alias("tenant_id"),
        part("source_type", "UNKNOWN").alias("source_type"),
        part("vendor", "UnknownWebhookVendor").alias("source_vendor"),
        part("product", "UnknownWebhookProduct").alias("source_product"),
        "payload",
    )


def file_envelopes(records: DataFrame, tenant_id: str, source_hint: str | None = None) -> DataFrame:
    """Envelopes of file records. Vendor and product come from the payload where it names them."""
    v = F.try_parse_json("payload")

    def part(name: str, default: str):
        given = F.try_variant_get(v, f"$.{name}", "variant").isNotNull()
        return F.when(given, F.try_variant_get(v, f"$.{name}", "string")).otherwise(F.lit(default))

    return records.select(
        "path", "record_no", F.lit(tenant_id).alias("tenant_id"), F.lit(source_hint or "UNKNOWN").alias("source_type"),
        part("vendor", "UnknownVendor").alias("source_vendor"), part("product", "UnknownProduct").alias("source_product"),
        "payload",
    )


def split_batches(envelopes: DataFrame, limit: int = model.ENVELOPE_BATCH_LIMIT) -> tuple[DataFrame, DataFrame]:
    """(accepted envelopes, refused batches): a batch (batch_id) above the limit is refused whole."""
    sizes = envelopes.groupBy("batch_id").agg(F.count(F.lit(1)).alias("records")).where(F.col("records") > limit)
    refused = sizes.withColumn("error", F.lit(f"Batch size limit exceeded (max {limit})"))
    return envelopes.join(refused.select("batch_id"), "batch_id", "left_anti"), refused
