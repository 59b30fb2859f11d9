"""Entities named by alerts, gathered per signal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertweave import model
from alertweave.functions import columns as C

# Alert column -> entity type.
ENTITY_FIELDS = [
    ("user", "USER"),
    ("host", "DEVICE"),
    ("src_ip", "IP"),
    ("dst_ip", "IP"),
    ("domain", "DOMAIN"),
    ("process_name", "PROCESS"),
    ("file_hash", "HASH"),
]
# Signals with more distinct entities than this are not held as arrays but compared by join.
ARRAY_LIMIT = 256


def alert_entities(alerts: DataFrame, *keep: str) -> DataFrame:
    """One row per entity mention: the kept columns, entity_type, entity_value."""
    mentions = F.array(
        *[
            F.when(F.col(c) != "", F.struct(F.lit(t).alias("entity_type"), C.strip(F.col(c)).alias("entity_value")))
            for c, t in ENTITY_FIELDS
        ]
    )
    return alerts.select(*keep, F.explode(F.array_compact(mentions)).alias("_e")).select(*keep, "_e.*")


def signal_entities(attached: DataFrame) -> DataFrame:
    """Distinct (tenant_id, signal_id, entity_type, entity_value) of alerts that carry a signal_id."""
    return alert_entities(attached, "tenant_id", "signal_id").distinct()


def with_seen(entities: DataFrame, signals: DataFrame) -> DataFrame:
    """Entities with the signal's current first and last time."""
    return entities.join(signals.select("tenant_id", "signal_id", "first_us", "last_us"), ["tenant_id", "signal_id"])


def is_generic_user(value: Column, policy: model.CorrelationPolicy) -> Column:
    if policy.casefold_generic_users:
        return F.upper(value).isin(*[u.upper() for u in policy.generic_users])
    return value.isin(*policy.generic_users)


def linkable_entities(
    entities: DataFrame, policy: model.CorrelationPolicy, context: DataFrame | None = None
) -> DataFrame:
    """The entities that may link signals: no generic users, no shared-infrastructure addresses.

    `context` is the per-tenant list of further generic users and NAT/VPN/proxy addresses.
    """
    useful = entities.where(
        F.col("entity_type").isin(*policy.weights)
        & ~((F.col("entity_type") == "USER") & is_generic_user(F.col("entity_value"), policy))
    )
    if context is None:
        return useful
    barred = context.select(
        "tenant_id",
        F.when(F.col("kind") == "GENERIC_USER", "USER")
        .when(F.col("kind").isin(*model.SHARED_IP_KINDS), "IP").alias("entity_type"),
        F.col("value").alias("entity_value"),
    ).where("entity_type is not null")
    return useful.join(barred, ["tenant_id", "entity_type", "entity_value"], "left_anti")


def entity_sets(linkable: DataFrame) -> DataFrame:
    """Per signal: users, devices, hashes, ips as arrays, or `wide` and no arrays when there are many.

    Partial counts come first, so the arrays that are gathered are bounded by ARRAY_LIMIT.
    """
    sizes = linkable.groupBy("tenant_id", "signal_id").agg(F.count(F.lit(1)).alias("_n"))
    small = linkable.join(sizes.where(F.col("_n") <= ARRAY_LIMIT).drop("_n"), ["tenant_id", "signal_id"])

    def of(kind: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("entity_type") == kind, F.col("entity_value"))))

    gathered = small.groupBy("tenant_id", "signal_id").agg(
        of("USER").alias("users"), of("DEVICE").alias("devices"), of("HASH").alias("hashes"), of("IP").alias("ips"),
        F.lit(False).alias("wide"),
    )
    none = F.lit(None).cast("array<string>")
    large = sizes.where(F.col("_n") > ARRAY_LIMIT).select(
        "tenant_id", "signal_id", none.alias("users"), none.alias("devices"), none.alias("hashes"), none.alias("ips"),
        F.lit(True).alias("wide"),
    )
    return gathered.unionByName(large)


def anchors(linkable: DataFrame) -> DataFrame:
    """Anchor entities of signals as rows: devices, hashes and non-generic users."""
    return linkable.where(F.col("entity_type").isin("DEVICE", "HASH", "USER")).select(
        "tenant_id", "signal_id", F.concat_ws(":", "entity_type", "entity_value").alias("anchor")
    )


def anchor_map(anchor_texts: Column) -> Column:
    """['TYPE:value', ...] as map<type, sorted values>."""
    kinds = F.array_distinct(F.transform(anchor_texts, lambda a: F.substring_index(a, ":", 1)))
    return F.map_from_arrays(
        F.array_sort(kinds),
        F.transform(
            F.array_sort(kinds),
            lambda k: F.array_sort(
                F.transform(
                    F.filter(anchor_texts, lambda a: F.substring_index(a, ":", 1) == k),
                    lambda a: F.substr(a, F.length(k) + 2),
                )
            ),
        ),
    )
