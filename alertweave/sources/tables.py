"""Evidence tables in a shared folder: raw first, then alerts and the dead letters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertweave import model
from alertweave.functions import columns as C
from alertweave.operators.normalize import alerts_of, normalize, quarantine_of
from alertweave.session import cut_lineage

RAW, ALERTS, QUARANTINE = "raw_events", "normalized_alerts", "quarantine"


def raw_rows(envelopes: DataFrame) -> DataFrame:
    """Envelopes as raw evidence: id, receipt time, payload hash, status RECEIVED, hot storage."""
    have = set(envelopes.columns)
    received = F.col("received_at") if "received_at" in have else F.current_timestamp()
    keep = [F.col(c) for c in ("path", "record_no", "batch_id") if c in have]
    vendor_id = F.try_variant_get(F.try_parse_json("payload"), "$.vendor_id", "string")
    return envelopes.select(
        (F.col("raw_event_id") if "raw_event_id" in have else F.uuid()).alias("raw_event_id"),
        "tenant_id", "source_type", "source_vendor", "source_product", vendor_id.alias("source_event_id"),
        received.alias("received_at"), "payload", C.payload_hash(F.col("payload")).alias("raw_payload_sha256"),
        F.lit("RECEIVED").alias("processing_status"), F.lit("HOT").alias("storage_tier"),
        F.to_date(received).alias("received_date"), *keep,
    )


def _stored(rows: DataFrame, path: str, *partitions: str) -> DataFrame:
    rows.write.mode("overwrite").partitionBy(*partitions).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def store_raw(envelopes: DataFrame, root: str, run: str) -> DataFrame:
    """Write raw evidence before anything else, one folder per run so a retry overwrites itself."""
    path = f"{root}/{RAW}/run={run}"
    return _stored(raw_rows(envelopes), path, "tenant_id", "received_date")


def store_normalized(raw: DataFrame, root: str, run: str) -> tuple[DataFrame, DataFrame]:
    """Normalise stored raw events, once; write alerts and quarantine. Returns both as stored."""
    done = cut_lineage(normalize(raw.drop("processing_status", "received_date")))
    alerts = alerts_of(done).withColumn("alert_date", F.to_date("timestamp"))
    good, bad = f"{root}/{ALERTS}/run={run}", f"{root}/{QUARANTINE}/run={run}"
    return _stored(alerts, good, "tenant_id", "alert_date"), _stored(quarantine_of(done), bad, "tenant_id")


def raw_status(raw: DataFrame, alerts: DataFrame, quarantine: DataFrame) -> DataFrame:
    """Raw events with their final status, by what was really stored.

    In the alert table: NORMALIZED; in the dead letters: NORMALIZATION_FAILED; in neither:
    PERSISTENCE_FAILED.
    """
    ok = alerts.select("raw_event_id", F.lit(True).alias("_ok"))
    bad = quarantine.select("raw_event_id", F.col("normalization_error").alias("_error"))
    return (
        raw.drop("processing_status").join(ok, "raw_event_id", "left").join(bad, "raw_event_id", "left")
        .withColumn(
            "processing_status",
            F.when(F.col("_ok"), "NORMALIZED").when(F.col("_error").isNotNull(), "NORMALIZATION_FAILED")
            .otherwise("PERSISTENCE_FAILED"),
        )
        .withColumn(
            "normalization_error",
            F.when(F.col("processing_status") == "PERSISTENCE_FAILED",
                   "error_code=PERSISTENCE_FAILURE reason='Failed to save normalized alert'").otherwise(F.col("_error")),
        )
        .drop("_ok", "_error")
    )


def read_alerts(spark: SparkSession, root: str, tenant: str | None = None) -> DataFrame:
    """Stored alerts, of one tenant if given (partition pruning), without raw payloads."""
    schema = T.StructType([*model.ALERT_SCHEMA.fields, T.StructField("alert_date", T.DateType())])
    alerts = spark.read.schema(schema).parquet(f"{root}/{ALERTS}")
    alerts = alerts.where(F.col("tenant_id") == tenant) if tenant else alerts
    return alerts.select(*[f.name for f in model.ALERT_SCHEMA])


def alerts_by_id(alerts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Alerts asked for by (tenant_id, id); another tenant's ids find nothing."""
    return alerts.join(wanted.select("tenant_id", "id").distinct(), ["tenant_id", "id"], "left_semi")
