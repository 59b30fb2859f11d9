"""Ingestion: envelopes or files to stored raw evidence, alerts and dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertweave.session import configure
from alertweave.sources import envelopes as V
from alertweave.sources import files as S
from alertweave.sources import tables as B


def ingest(envelopes: DataFrame, root: str, run: str) -> DataFrame:
    """Store, normalise, store; one status row per envelope."""
    configure(envelopes.sparkSession)
    raw = B.store_raw(envelopes, root, run)
    alerts, bad = B.store_normalized(raw, root, run)
    return B.raw_status(raw, alerts, bad)


def final_status(counts: dict[str, Column]) -> Column:
    failed = (counts["parse_failed"] > 0) | (counts["normalization_failed"] > 0)
    some = (counts["normalized"] > 0) | (counts["raw_records_stored"] > 0)
    return (
        F.when(F.col("error_message").isNotNull(), "FAILED")
        .when(failed & some, "PARTIAL")
        .when(failed, "FAILED")
        .otherwise("COMPLETED")
    )


def import_report(files: DataFrame, statuses: DataFrame) -> DataFrame:
    """Per file: how many records came, parsed, normalised, failed, and the job status.

    `statuses` has path, processing_status, normalization_error, one row per record.
    """
    state = F.col("processing_status")
    counted = statuses.groupBy("path").agg(
        F.count(F.lit(1)).alias("records_received"),
        F.count_if(state == "PARSE_FAILED").alias("parse_failed"),
        F.count_if(state.isin("NORMALIZED", "NORMALIZATION_FAILED")).alias("raw_records_stored"),
        F.count_if(state == "NORMALIZED").alias("normalized"),
        F.count_if(state == "NORMALIZATION_FAILED").alias("normalization_failed"),
        F.count_if((state == "NORMALIZATION_FAILED") & F.col("normalization_error").contains("No normalizer found"))
        .alias("unsupported"),
    )
    names = ["records_received", "parse_failed", "raw_records_stored", "normalized", "normalization_failed", "unsupported"]
    report = files.join(counted, "path", "left").na.fill(0, names)
    nothing = (F.col("parse_failed") > 0) & (F.col("raw_records_stored") == 0)
    return report.select(
        "path", "filename", "format", *names, F.col("records_received").alias("records_parsed"),
        final_status({n: F.col(n) for n in names}).alias("status"),
        F.coalesce("error_message", F.when(nothing, "All records failed to process.")).alias("error_message"),
    )


def import_files(spark: SparkSession, path: str | list[str], root: str, run: str, tenant_id: str,
                 source_hint: str | None = None) -> DataFrame:
    """Import all files under a path; one report row per file.

    A record without a vendor or product cannot be stored as raw evidence and counts as
    parse_failed; it is set aside before the raw table is written.
    """
    configure(spark)
    files, records = S.load_alerts(spark, path)
    every = V.file_envelopes(records, tenant_id, source_hint)
    storable = F.col("source_vendor").isNotNull() & F.col("source_product").isNotNull()
    done = ingest(every.where(storable), root, run)
    failed = every.where(~storable).select(
        "path", F.lit("PARSE_FAILED").alias("processing_status"), F.lit(None).cast("string").alias("normalization_error")
    )
    statuses = done.select("path", "processing_status", "normalization_error").unionByName(failed)
    return import_report(files, statuses)
