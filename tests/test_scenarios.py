"""End to end: vendor events in, signals, edges and incidents out."""

import pytest
from pyspark.sql import functions as F

from alertweave.operators.normalize import alerts_of, normalize, quarantine_of
from alertweave.plans import reports
from alertweave.plans.correlate import correlate, run_metrics
from tests.scenarios import COLUMNS, SCENARIOS, demo_chain, envelope


def alerts(spark, rows):
    df = spark.createDataFrame(rows, COLUMNS).withColumn("received_at", F.to_timestamp("received_at"))
    return normalize(df)


@pytest.fixture(scope="module")
def run(spark):
    """All scenarios at once, each in a tenant of its own (F keeps its two)."""
    rows = [
        envelope(e, e["tenant"] if name == "F" else f"tenant_{name}") for name, events in SCENARIOS.items() for e in events
    ]
    normalised = alerts(spark, rows)
    assert normalised.where("processing_status <> 'NORMALIZED'").count() == 0
    return correlate(alerts_of(normalised))


def of(df, tenant):
    return [r.asDict() for r in df.where(F.col("tenant_id") == tenant).collect()]


@pytest.mark.parametrize(
    ("tenant", "signals", "edges", "incidents"),
    [
        ("tenant_A", 4, 0, 1), ("tenant_B", 1, 0, 0), ("tenant_C", 1, 0, 1), ("tenant_D", 2, 0, 0), ("tenant_E", 1, 0, 0),
        ("tenant-1", 1, 0, 0), ("tenant-2", 1, 0, 0), ("tenant_G", 2, 0, 0), ("tenant_H", 3, 1, 1),
    ],
)
def test_counts(run, tenant, signals, edges, incidents):
    assert len(of(run.stage.signals, tenant)) == signals
    assert len(of(run.edges, tenant)) == edges
    assert len(of(run.incidents, tenant)) == incidents


def test_attack_is_a_critical_singleton(run):
    (incident,) = of(run.incidents, "tenant_A")
    assert (incident["incident_type"], incident["severity"]) == ("SINGLETON_DETECTION", "CRITICAL")


def test_duplicate_is_counted_once(run):
    (signal,) = of(run.stage.signals, "tenant_B")
    assert signal["occurrence_count"] == 1
    (metrics,) = of(run_metrics(run), "tenant_B")
    assert metrics["duplicates_detected"] == 1


def test_burst_is_one_signal(run):
    (signal,) = of(run.stage.signals, "tenant_C")
    assert (signal["occurrence_count"], signal["severity"]) == (10, "CRITICAL")


def test_benign_is_info(run):
    (signal,) = of(run.stage.signals, "tenant_E")
    assert signal["severity"] == "INFO"


def test_late_arrival_links_two_and_escalates(run):
    (edge,) = of(run.edges, "tenant_H")
    assert (edge["score"], edge["reasons"]) == (55, ["SAME_DEVICE", "TIME_PROXIMITY_5M"])
    (incident,) = of(run.incidents, "tenant_H")
    assert (incident["incident_type"], incident["severity"]) == ("CORRELATED_INCIDENT", "CRITICAL")
    members = {r["signal_id"] for r in of(run.members, "tenant_H")}
    assert members == {edge["left_signal_id"], edge["right_signal_id"]}


def test_demo_chain(spark):
    normalised = alerts(spark, demo_chain())
    assert quarantine_of(normalised).count() == 4
    assert {r.normalization_error for r in quarantine_of(normalised).collect()} == {
        "field='timestamp' reason='Input should be a valid datetime or date'"
    }
    run = correlate(alerts_of(normalised))
    counts = sorted(r.occurrence_count for r in run.stage.signals.collect())
    assert counts == [1, 4, 6, 7]
    (edge,) = run.edges.collect()
    assert edge.score == 55
    (incident,) = run.incidents.collect()
    assert (incident.incident_type, incident.severity) == ("CORRELATED_INCIDENT", "CRITICAL")
    (rolled,) = reports.rollup(run.members, run.stage.signals, run.stage.unique).collect()
    assert (rolled.signal_count, rolled.evidence_count) == (2, 11)
    (noise,) = reports.noise_reduction(run.stage.alerts, run.stage.unique, run.stage.signals).collect()
    assert noise.reduction_vs_all == 77.8
