"""Exact redelivery removal by fingerprint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertweave import model
from alertweave.functions import columns as C
from alertweave.operators.hot import join_in_place
from alertweave.session import cut_lineage


def with_fingerprint(alerts: DataFrame) -> DataFrame:
    return alerts.withColumn(
        "dedup_fingerprint",
        C.fingerprint(*[F.col(c) for c in
                        ("tenant_id", "source_type", "source_vendor", "source_product", "source_event_id")]),
    )


def arrival(prefix: str = "") -> Column:
    return F.struct(F.col(f"{prefix}ingested_at"), F.col(f"{prefix}id"))


def first_deliveries(alerts: DataFrame) -> DataFrame:
    """Keep, per fingerprint, the first alert by (ingested_at, id); alerts without one all stay.

    `row_number() = 1` lets Spark drop all but one row per key inside each task before the
    shuffle, so a fingerprint with very many copies does not become one big group.
    """
    tagged = with_fingerprint(alerts).withColumn(
        "_key", F.coalesce("dedup_fingerprint", F.concat(F.lit("row:"), F.col("id").cast("string")))
    )
    w = Window.partitionBy("tenant_id", "_key").orderBy("ingested_at", "id")
    return tagged.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_key")


def new_deliveries(alerts: DataFrame, history: DataFrame) -> DataFrame:
    """First deliveries whose fingerprint an earlier run has not seen.

    `history` has (tenant_id, dedup_fingerprint).
    """
    seen = history.select("tenant_id", "dedup_fingerprint").where("dedup_fingerprint is not null")
    firsts = first_deliveries(alerts)
    # Rows without a fingerprint repeat nothing; in the join they would all meet.
    named = firsts.where("dedup_fingerprint is not null").join(seen, ["tenant_id", "dedup_fingerprint"], "left_anti")
    return named.unionByName(firsts.where("dedup_fingerprint is null"))


def mark_duplicates(alerts: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Every alert with dedup_fingerprint, its version and duplicate_of_alert_id (null for a first).

    `history` has (tenant_id, dedup_fingerprint, id) of alerts already processed.
    """
    tagged = with_fingerprint(alerts)
    firsts = (
        tagged.where("dedup_fingerprint is not null")
        .groupBy("tenant_id", "dedup_fingerprint")
        .agg(F.min(arrival()).alias("_first"), F.count(F.lit(1)).alias("_n"))
        .select("tenant_id", "dedup_fingerprint", F.col("_first.id").alias("_first_id"), "_n")
    )
    # One row per fingerprint, read for its size and for the join.
    firsts = cut_lineage(firsts)
    total = firsts.agg(F.sum("_n")).first()[0] or 0
    if history is not None:
        known = (
            history.groupBy("tenant_id", "dedup_fingerprint").agg(F.min("id").alias("_known_id"))
        )
        firsts = firsts.join(known, ["tenant_id", "dedup_fingerprint"], "left").select(
            "tenant_id", "dedup_fingerprint", F.coalesce("_known_id", "_first_id").alias("_first_id"), "_n"
        )
    # Rows without a fingerprint repeat nothing; in the join they would all meet.
    named = join_in_place(tagged.where("dedup_fingerprint is not null"), firsts, ["tenant_id", "dedup_fingerprint"], total)
    return (
        named.unionByName(tagged.where("dedup_fingerprint is null"), allowMissingColumns=True)
        .withColumn("duplicate_of_alert_id", F.when(F.col("_first_id") != F.col("id"), F.col("_first_id")))
        .withColumn("dedup_fingerprint_version",
                    F.when(F.col("dedup_fingerprint").isNotNull(), model.FINGERPRINT_VERSION))
        .drop("_first_id")
    )


def cursor_batch(alerts: DataFrame, after_ingested, after_id, limit: int | None = model.CURSOR_BATCH) -> DataFrame:
    """Alerts behind the cursor (ingested_at, id), in cursor order, at most `limit` (None: all)."""
    behind = alerts.where(
        F.struct("ingested_at", "id")
        > F.struct(F.lit(after_ingested).cast("timestamp").alias("ingested_at"), F.lit(after_id).alias("id"))
    )
    return behind if limit is None else behind.orderBy("ingested_at", "id").limit(limit)
