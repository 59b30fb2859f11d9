"""Scored links between candidate signals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertweave import model
from alertweave.functions import columns as C
from alertweave.operators import candidates as K
from alertweave.session import cut_lineage

_SETS = {"HASH": "hashes", "DEVICE": "devices", "USER": "users", "IP": "ips"}
EDGE_COLUMNS = ["edge_id", "tenant_id", "left_signal_id", "right_signal_id", "score", "reasons", "rule_version"]


def gap_us() -> Column:
    """Time between two intervals, 0 when they touch or overlap."""
    return F.greatest(
        F.lit(0), F.col("a_first_us") - F.col("b_last_us"), F.col("b_first_us") - F.col("a_last_us")
    )


def score_and_reasons(shared: dict[str, Column], policy: model.CorrelationPolicy) -> tuple[Column, Column]:
    gap = gap_us()
    near = gap <= policy.near_seconds * 1_000_000
    far = ~near & (gap <= policy.far_seconds * 1_000_000)
    parts = [(shared[t], policy.weights[t], model.REASONS[t]) for t in _SETS]
    parts += [(near, policy.near_score, model.REASONS["NEAR"]), (far, policy.far_score, model.REASONS["FAR"])]
    score = sum((F.when(flag, weight).otherwise(0) for flag, weight, _ in parts), F.lit(0))
    return score.cast("int"), F.array_compact(F.array(*[F.when(flag, label) for flag, _, label in parts]))


def _score(pairs: DataFrame, shared: dict[str, Column], policy: model.CorrelationPolicy) -> DataFrame:
    score, reasons = score_and_reasons(shared, policy)
    return pairs.select(
        "tenant_id",
        F.least("a_signal_id", "b_signal_id").alias("left_signal_id"),
        F.greatest("a_signal_id", "b_signal_id").alias("right_signal_id"),
        score.alias("score"),
        reasons.alias("reasons"),
    )


def _by_arrays() -> dict[str, Column]:
    return {t: F.arrays_overlap(f"a_{c}", f"b_{c}") for t, c in _SETS.items()}


def _wide_scores(pairs: DataFrame, linkable: DataFrame, policy: model.CorrelationPolicy) -> DataFrame:
    """Scores of pairs with a signal too wide for arrays: shared entities found by join."""
    wide = pairs.select("tenant_id", "a_signal_id", "b_signal_id", "a_first_us", "a_last_us", "b_first_us",
                        "b_last_us").dropDuplicates(["tenant_id", "a_signal_id", "b_signal_id"])
    ends = ["tenant_id", "a_signal_id", "b_signal_id"]
    of_a = linkable.withColumnRenamed("signal_id", "a_signal_id")
    of_b = linkable.withColumnRenamed("signal_id", "b_signal_id")
    flags = (
        wide.select(*ends)
        .join(of_a, ["tenant_id", "a_signal_id"])
        .join(of_b, ["tenant_id", "b_signal_id", "entity_type", "entity_value"])
        .groupBy(*ends)
        .agg(*[F.max(F.col("entity_type") == t).alias(f"_{t}") for t in _SETS])
    )
    joined = wide.join(flags, ends, "left")
    return _score(joined, {t: F.coalesce(F.col(f"_{t}"), F.lit(False)) for t in _SETS}, policy)


def scored_pairs(profile: DataFrame, linkable: DataFrame, policy: model.CorrelationPolicy,
                 threshold: int | None = None) -> DataFrame:
    """All candidate pairs with score and reasons, each once; below the threshold dropped early.

    A profile that tells which signals act (`acts`) gives only the pairs in which one does.
    """
    primary = K.primary_rows(profile, linkable, policy)
    calm, busy = K.split_by_load(primary, policy.candidate_limit)
    acts = [c for c in ("acts",) if c in profile.columns]
    ends = ["signal_id", "first_us", "last_us", *_SETS.values(), "wide", *acts]
    cols = ["tenant_id", *[f"{s}_{c}" for s in "ab" for c in ends]]
    either_wide = F.col("a_wide") | F.col("b_wide")
    pairs = K._bucket_pairs(calm, calm, policy.window_us, False)
    if busy is None:
        pairs = pairs.where(either_wide | K.met_first(policy))
    pairs = pairs.select(*cols)
    if busy is not None:
        facts = profile.select("tenant_id", *ends)
        picked = K.unordered(K.busy_pairs(busy.drop(*_SETS.values(), "wide", *acts), policy))
        pairs = pairs.unionByName(
            picked.withColumnsRenamed({"left_signal_id": "a_signal_id", "right_signal_id": "b_signal_id"})
            .join(K._side(facts, "a", ["tenant_id"]), ["tenant_id", "a_signal_id"])
            .join(K._side(facts, "b", ["tenant_id"]), ["tenant_id", "b_signal_id"])
            .select(*cols)
        )
    if acts:
        pairs = pairs.where("a_acts or b_acts")
    scored = _score(pairs.where(~either_wide), _by_arrays(), policy)
    if not profile.where("wide").isEmpty():
        scored = scored.unionByName(_wide_scores(pairs.where(either_wide), linkable, policy))
    if threshold is not None:
        scored = scored.where(F.col("score") >= threshold)
    # Without busy entities every pair has come once: narrow ones where they met first, others from _wide_scores.
    return scored if busy is None else scored.dropDuplicates(["tenant_id", "left_signal_id", "right_signal_id"])


def with_edge_id(scored: DataFrame, policy: model.CorrelationPolicy) -> DataFrame:
    return scored.select(
        C.edge_id(F.col("tenant_id"), policy.rule_version, F.col("left_signal_id"), F.col("right_signal_id"))
        .alias("edge_id"),
        "tenant_id", "left_signal_id", "right_signal_id", "score", "reasons",
        F.lit(policy.rule_version).alias("rule_version"),
    )


def build_edges(signals: DataFrame, linkable: DataFrame, policy: model.CorrelationPolicy,
                keep: Callable[[DataFrame], DataFrame] = lambda df: df, acting: DataFrame | None = None) -> DataFrame:
    """Edges: candidate pairs that reach the threshold, once each, with a stable id.

    With `acting` (signal_id) only edges of these signals, among them or with others.
    With `keep=cut_lineage` the scored pairs are stored; an edge's id, a hash that no codec shortens, is made where it is asked for.
    """
    profile = K.profiles(signals, linkable)
    if acting is not None:
        mark = acting.select("signal_id").distinct().withColumn("acts", F.lit(True))
        profile = profile.join(mark, "signal_id", "left").na.fill(False, ["acts"])
    profile = cut_lineage(profile)
    return with_edge_id(keep(scored_pairs(profile, linkable, policy, policy.edge_threshold)), policy)


def insert_if_absent(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose natural key is not stored yet, each key once."""
    return new.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")
