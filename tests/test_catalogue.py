"""Registered queries against their SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_queries import TABLES, rows_of, same

SF = "/root/testdata/sf0.001"
QUICK = [
    "normalize_xdr", "source_routing", "timestamp_validation", "payload_hash", "import_status", "tenant_scan", "cursor_batch",
    "dedup_first", "dedup_flags", "dedup_against_history", "rule_lookup", "signals_gap60", "signals_session_window", "late_merge",
    "late_matches", "signal_entities", "new_entities", "severity_distribution", "source_distribution", "incident_list",
    "active_incident_jobs", "stage_durations", "pipeline_status", "latest_job", "stale_jobs", "job_reuse", "evidence_top50",
    "validate_assessments", "redact_secrets", "withheld_text", "private_addresses", "message_aliases", "mixed_packages",
    "incidents_assigned", "incident_memberships", "incident_details", "explanation_anchors", "stream_dedup", "stream_signals",
    "stream_dashboard", "dense_entity_links", "dense_entity_best_links", "import_jsonl", "import_csv", "import_files_report",
    "envelope_sources", "alerts_looked_up", "job_outcomes", "leak_scan", "released_packages", "refused_packages",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, duck, name):
    ours = entry.queries()[name](spark, SF).toPandas()
    theirs = duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert same(rows_of(ours), rows_of(theirs))


@pytest.mark.parametrize("name", ["normalize_xdr", "normalize_canonical"])
def test_one_row_group_is_normalised_by_all_cores(spark, name):
    rows = entry.queries()[name](spark, SF).select("raw_event_id").rdd.glom().map(len).collect()
    assert sum(n > 0 for n in rows) >= spark.sparkContext.defaultParallelism and max(rows) < sum(rows) / 4


def test_entry(spark):
    assert entry.entry(spark).count() == 988
