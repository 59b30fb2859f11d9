"""Repeats of one detection folded into signals by a closing gap.

Alerts are first summed up per (rule, key, slot), a slot being as wide as the gap. Two
alerts of one slot are never further apart than the gap, so a slot always belongs to one
signal; the sum is a plain hash aggregation with map-side combine, however hot the key.
Only these few slot rows are then ordered in time to find the gaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertweave import model
from alertweave.functions import columns as C

KEY = ["tenant_id", "rule_id", "rule_version", "aggregation_key"]


def _rule_name(source_type: Column, lookup: str) -> Column:
    """'exact' compares the names as they are; 'casefold' ignores case and knows FIREWALL as fw."""
    if lookup == "exact":
        return source_type
    lower = F.lower(source_type)
    return F.when(lower == "firewall", "fw").otherwise(lower)


def with_rule(alerts: DataFrame, rules: dict | None = None, lookup: str = "exact") -> DataFrame:
    """Add rule_id, rule_version, gap_us and aggregation_key by source type, else the default rule."""
    rules = rules or model.RULES
    name = _rule_name(F.col("source_type"), lookup)
    fallback = rules["default"]

    def choose(make) -> Column:
        expr = None
        for key, rule in rules.items():
            if key != "default":
                expr = F.when(name == key, make(rule)) if expr is None else expr.when(name == key, make(rule))
        return make(fallback) if expr is None else expr.otherwise(make(fallback))

    return (
        alerts.withColumn("aggregation_key", choose(lambda r: C.joined(*[F.col(f) for f in r.fields])))
        .withColumn("rule_id", choose(lambda r: F.lit(r.rule_id)))
        .withColumn("rule_version", choose(lambda r: F.lit(r.rule_version)))
        .withColumn("gap_us", choose(lambda r: F.lit(r.gap_us)))
    )


def _slot(us: str) -> str:
    """SQL of the slot a time falls into: division rounded down, also before 1970."""
    return f"({us} div gap_us - if({us} % gap_us < 0, 1, 0))"


def with_slot(ruled: DataFrame) -> DataFrame:
    return ruled.withColumn("ts_us", C.to_us(F.col("timestamp"))).withColumn(
        "slot", F.expr(_slot("ts_us"))
    )


def slot_sums(slotted: DataFrame) -> DataFrame:
    """One row per (rule, key, slot): the mergeable summary every signal is built from."""
    return slotted.groupBy(*KEY, "gap_us", "slot").agg(
        F.min("ts_us").alias("first_us"),
        F.max("ts_us").alias("last_us"),
        F.count(F.lit(1)).alias("occurrence_count"),
        F.max(C.severity_rank(F.col("severity"))).alias("severity_rank"),
        F.min(F.struct(F.col("ts_us"), F.col("id"))).alias("anchor"),
    )


def tag_signals(intervals: DataFrame) -> DataFrame:
    """Give every interval row the id of the signal it falls into.

    A row opens a new signal when it starts later than the gap after everything before it;
    a distance of exactly the gap still joins. The anchor is the earliest (time, id) alert.
    """
    in_time = Window.partitionBy(*KEY).orderBy("first_us", "last_us")
    before = in_time.rowsBetween(Window.unboundedPreceding, -1)
    running = in_time.rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max("last_us").over(before)
    opened = intervals.withColumn(
        "_opens", F.when(reach.isNull() | (F.col("first_us") - reach > F.col("gap_us")), 1).otherwise(0)
    ).withColumn("_island", F.sum("_opens").over(running))
    whole = Window.partitionBy(*KEY, "_island")
    return (
        opened.withColumn("_anchor", F.min("anchor").over(whole))
        .withColumn(
            "signal_id",
            C.signal_id(F.col("tenant_id"), F.col("rule_id"), F.col("rule_version"), F.col("aggregation_key"),
                        F.col("_anchor.id")),
        )
        .drop("_opens", "_anchor")
    )


def fold(tagged: DataFrame) -> DataFrame:
    """Signals: tagged interval rows summed up per signal."""
    return (
        tagged.groupBy(*KEY, "gap_us", "_island", "signal_id")
        .agg(
            F.min("first_us").alias("first_us"),
            F.max("last_us").alias("last_us"),
            F.sum("occurrence_count").alias("occurrence_count"),
            F.max("severity_rank").alias("severity_rank"),
            F.min("anchor").alias("anchor"),
        )
        .withColumn("severity", C.severity_name(F.col("severity_rank")))
        .withColumn("anchor_alert_id", F.col("anchor.id"))
        .drop("_island")
    )


def attach_signals(alerts: DataFrame, rules: dict | None = None, lookup: str = "exact", keep=lambda df: df):
    """(signals, alerts with signal_id) of unique alerts; `keep` may store the few slot rows.

    Finding an alert's signal is an equi join on its slot, one row per (rule, key, slot).
    """
    slotted = with_slot(with_rule(alerts, rules, lookup))
    tagged = keep(tag_signals(slot_sums(slotted)))
    where = tagged.select(*KEY, "slot", "signal_id")
    return fold(tagged), slotted.join(where, [*KEY, "slot"]).drop("slot")


def build_signals(alerts: DataFrame, rules: dict | None = None, lookup: str = "exact"):
    """(signals, links): signals of unique alerts, and which alert is in which signal."""
    sigs, attached = attach_signals(alerts, rules, lookup)
    return sigs, attached.select("tenant_id", "signal_id", F.col("id").alias("alert_id"))


def signal_intervals(signals: DataFrame) -> DataFrame:
    """Existing signals in the form of interval rows, ready to be merged with new slots."""
    cols = [*KEY, "gap_us", "first_us", "last_us", "occurrence_count", "severity_rank", "anchor"]
    return signals.select(*cols)


def merge_late(signals: DataFrame, late_alerts: DataFrame, rules: dict | None = None, lookup: str = "exact"):
    """Signals after late alerts came in: alerts that bridge several signals merge them."""
    slots = slot_sums(with_slot(with_rule(late_alerts, rules, lookup))).drop("slot")
    return fold(tag_signals(signal_intervals(signals).unionByName(slots)))


def late_matches(signals: DataFrame, late_alerts: DataFrame, rules: dict | None = None, lookup: str = "exact"):
    """(alert_id, signal_id): signals of the same rule and key within the gap of a late alert."""
    late = with_slot(with_rule(late_alerts, rules, lookup))
    # A signal is within reach of the slots it spans and one slot on either side.
    near = signals.withColumn(
        "slot", F.explode(F.sequence(F.expr(_slot("first_us") + " - 1"), F.expr(_slot("last_us") + " + 1")))
    ).select(*KEY, "slot", "signal_id", "first_us", "last_us")
    return (
        late.join(near, [*KEY, "slot"])
        .where("first_us <= ts_us + gap_us and last_us >= ts_us - gap_us")
        .select("tenant_id", F.col("id").alias("alert_id"), "signal_id")
    )


def session_window_signals(alerts: DataFrame, minutes: int = 60, rules: dict | None = None, lookup: str = "exact"):
    """Signals by Spark's own session window (also what the stream uses)."""
    w = F.session_window(F.col("timestamp"), f"{minutes} minutes")
    return (
        with_rule(alerts, rules, lookup)
        .withColumn("ts_us", C.to_us(F.col("timestamp")))
        .groupBy(*KEY, w)
        .agg(
            F.min("ts_us").alias("first_us"),
            F.max("ts_us").alias("last_us"),
            F.count(F.lit(1)).alias("occurrence_count"),
            F.max(C.severity_rank(F.col("severity"))).alias("severity_rank"),
        )
        .withColumn("severity", C.severity_name(F.col("severity_rank")))
        .drop("session_window")
    )
