"""The correlation run: alerts to signals, edges and incidents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertweave import model
from alertweave.operators import candidates, dedup, edges, entities, incidents, signals
from alertweave.session import configure, cut_lineage, cut_packed


@dataclass
class SignalStage:
    alerts: DataFrame
    unique: DataFrame
    signals: DataFrame
    entities: DataFrame
    linkable: DataFrame


@dataclass
class Correlation:
    stage: SignalStage
    edges: DataFrame
    incidents: DataFrame
    members: DataFrame
    decisions: DataFrame


def signal_stage(alerts: DataFrame, policy: model.CorrelationPolicy | None = None, rules: dict | None = None,
                 lookup: str = "exact", context: DataFrame | None = None, history: DataFrame | None = None,
                 keep=lambda df: df) -> SignalStage:
    """De-duplicate, fold into signals, gather entities. `unique` carries signal_id.

    Lazy by default; `keep=cut_lineage` stores each table once for plans that read it often.
    """
    configure(alerts.sparkSession)
    policy = policy or model.CorrelationPolicy()
    fresh = dedup.first_deliveries(alerts) if history is None else dedup.new_deliveries(alerts, history)
    # Alerts are stored once, the slot table is small; alerts with their signal_id stay a join of both.
    sigs, attached = signals.attach_signals(keep(fresh), rules, lookup, keep)
    named = keep(entities.signal_entities(attached))
    return SignalStage(alerts, attached, keep(sigs), named, entities.linkable_entities(named, policy, context))


def correlate(alerts: DataFrame, policy: model.CorrelationPolicy | None = None, rules: dict | None = None,
              lookup: str = "exact", context: DataFrame | None = None, old_incidents: DataFrame | None = None,
              old_members: DataFrame | None = None, slab_weight: int = incidents.SLAB_WEIGHT) -> Correlation:
    """One full run over a table of alerts (all tenants at once; nothing crosses a tenant)."""
    policy = policy or model.CorrelationPolicy()
    stage = signal_stage(alerts, policy, rules, lookup, context, keep=cut_lineage)
    links = edges.build_edges(stage.signals, stage.linkable, policy, keep=cut_packed)
    decisions = cut_lineage(
        incidents.decide(stage.signals, links, stage.linkable, policy, old_incidents, old_members, slab_weight)
    )
    members = incidents.memberships(decisions, links, old_members)
    rows = incidents.incident_rows(decisions, stage.signals, stage.linkable, policy, old_incidents)
    return Correlation(stage, links, rows, members, decisions)


def run_metrics(run: Correlation, policy: model.CorrelationPolicy | None = None) -> DataFrame:
    """One row per tenant: what the run read, dropped, built and linked, and how its candidate sets were.

    candidate_queries counts look-ups, one per signal and primary entity; candidate_rows_evaluated what they found, a
    partner once per shared entity; max_candidate_set_size the partners of the signal that has most;
    candidate_set_truncated whether the policy's limit cut any look-up off.
    """
    policy = policy or model.CorrelationPolicy()

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("tenant_id").agg(F.count(F.lit(1)).alias(name))

    profile = cut_lineage(candidates.profiles(run.stage.signals, run.stage.linkable))
    parts = [
        counted(run.stage.alerts, "alerts_processed"),
        counted(run.stage.unique, "_unique"),
        counted(run.stage.signals, "signals_created"),
        counted(run.edges, "edges_created"),
        counted(run.incidents, "incidents_created"),
        counted(run.members, "incident_memberships_added"),
        counted(candidates.primary_rows(profile, run.stage.linkable, policy), "candidate_queries"),
        candidates.candidate_stats(profile, run.stage.linkable, policy),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, "tenant_id", "full")
    out = out.na.fill(0).na.fill(False)
    return out.withColumn("duplicates_detected", F.col("alerts_processed") - F.col("_unique")).drop("_unique")
