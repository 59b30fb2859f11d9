"""Which signals may be linked: same primary entity, intervals within the candidate window.

Each signal keeps, per shared entity, its `candidate_limit` most recent partners; a pair
counts when either end keeps the other. Three ways find exactly these pairs, by how many
signals share the entity:

* calm entities (no more signals than the limit, so nothing can be cut off): an equi join on
  (entity, time bucket);
* busy entities, for signals whose time buckets hold no more than the limit: the same join
  with these signals as one side;
* busy entities, for signals in crowded buckets: a look-up in a time tree. Every node of the
  tree holds the most recent signals that began in a power-of-two span of places in time
  order, and "began up to x" is the union of one node per set bit of x. No node passes on more
  than limit + 1 rows, so a crowded entity costs a bounded number of rows per signal (one per
  doubling of the signals that share it), never all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertweave import model
from alertweave.operators import entities as E
from alertweave.operators.numbering import number_within
from alertweave.session import cut_lineage

ENTITY = ["tenant_id", "entity_type", "entity_value"]
SALTS = 32
_TIME = ["first_us", "last_us"]
COLUMNS = {"DEVICE": "devices", "HASH": "hashes", "USER": "users"}
_SETS = ["users", "devices", "hashes", "ips", "wide"]


def profiles(signals: DataFrame, linkable: DataFrame) -> DataFrame:
    """Signals with their linkable entities: the input of candidate search and scoring."""
    return signals.select("tenant_id", "signal_id", *_TIME).join(E.entity_sets(linkable), ["tenant_id", "signal_id"])


def primary_rows(profile: DataFrame, linkable: DataFrame, policy: model.CorrelationPolicy) -> DataFrame:
    """One row per signal and primary entity, with the signal's profile."""
    def typed(kind: str) -> Column:
        return F.transform(
            F.col(COLUMNS[kind]), lambda v: F.struct(F.lit(kind).alias("entity_type"), v.alias("entity_value"))
        )

    pairs = F.concat(*[typed(t) for t in policy.primary_types])
    narrow = profile.where("not wide").withColumn("_e", F.explode(pairs)).select("*", "_e.*").drop("_e")
    wide = profile.where("wide").join(
        linkable.where(F.col("entity_type").isin(*policy.primary_types)), ["tenant_id", "signal_id"]
    )
    return narrow.unionByName(wide)


def _in_buckets(rows: DataFrame, window_us: int) -> DataFrame:
    first, last = F.expr(f"first_us div {window_us}"), F.expr(f"(last_us + {window_us}) div {window_us}")
    return rows.withColumn("bucket", F.explode(F.sequence(first, last)))


def _side(rows: DataFrame, name: str, key: list[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in key]
    return rows.select(*key, *[F.col(c).alias(f"{name}_{c}") for c in rest])


def _meets(window_us: int) -> Column:
    """Intervals within the window, looked at once: in the bucket where the later one begins."""
    return (
        (F.col("b_first_us") <= F.col("a_last_us") + window_us)
        & (F.col("b_last_us") >= F.col("a_first_us") - window_us)
        & (F.expr(f"greatest(a_first_us, b_first_us) div {window_us}") == F.col("bucket"))
    )


def _bucket_pairs(left: DataFrame, right: DataFrame, window_us: int, both_ways: bool) -> DataFrame:
    key = [*ENTITY, "bucket"]
    a = _side(_in_buckets(left, window_us), "a", key)
    b = _side(_in_buckets(right, window_us), "b", key)
    order = F.col("a_signal_id") != F.col("b_signal_id") if both_ways else F.col("a_signal_id") < F.col("b_signal_id")
    return a.join(b, key).where(order & _meets(window_us))


def met_first(policy: model.CorrelationPolicy) -> Column:
    """Whether a pair of narrow signals meets at the first primary entity it shares: true once per pair, so none is gathered twice."""
    first, later = F.lit(False), F.lit(True)
    for kind in policy.primary_types:
        a, b = f"a_{COLUMNS[kind]}", f"b_{COLUMNS[kind]}"
        first |= later & (F.col("entity_type") == kind) & (F.col("entity_value") == F.array_min(F.array_intersect(a, b)))
        later &= ~F.arrays_overlap(a, b)
    return first


def split_by_load(primary: DataFrame, limit: int | None) -> tuple[DataFrame, DataFrame | None]:
    """(calm, busy) rows: an entity is busy when more than limit + 1 signals share it; none is without a limit.

    Counting entities is one small job; where none is busy, busy is None and its plan left out.
    """
    if limit is None:
        return primary, None
    crowd = primary.groupBy(*ENTITY).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit + 1)
    names = crowd.select(*ENTITY)
    if names.isEmpty():
        return primary, None
    names = cut_lineage(names)
    return primary.join(names, ENTITY, "left_anti"), primary.join(names, ENTITY, "left_semi")


def _crowded_targets(busy: DataFrame, policy: model.CorrelationPolicy) -> tuple[DataFrame, DataFrame]:
    """(sparse, dense) rows of busy entities, by an upper bound on their partners in time."""
    cells = _in_buckets(busy.select(*ENTITY, "signal_id", *_TIME), policy.window_us)
    load = cells.groupBy(*ENTITY, "bucket").agg(F.count(F.lit(1)).alias("_n"))
    bound = (
        cells.join(load, [*ENTITY, "bucket"])
        .groupBy(*ENTITY, "signal_id")
        .agg(F.sum("_n").alias("_n"))
    )
    marked = busy.join(bound, [*ENTITY, "signal_id"])
    fits = F.col("_n") <= policy.candidate_limit + 1
    return marked.where(fits).drop("_n"), marked.where(~fits).drop("_n")


def recent_in_tree(dense: DataFrame, busy: DataFrame, policy: model.CorrelationPolicy) -> DataFrame:
    """(entity, a_signal_id, b_signal_id): the most recent partners of signals in crowded buckets."""
    limit, window_us = policy.candidate_limit, policy.window_us
    begins = busy.join(dense.select(*ENTITY).distinct(), ENTITY, "left_semi").select(
        *ENTITY, "signal_id", *_TIME, F.col("first_us").alias("_at"), F.lit(False).alias("_asks")
    )
    asks = dense.select(*ENTITY, "signal_id", *_TIME, (F.col("last_us") + window_us).alias("_at"), F.lit(True).alias("_asks"))
    placed = cut_lineage(number_within(begins.unionByName(asks), ENTITY, ["_at", "_asks"], "_x").withColumn("_x", F.col("_x") - 1))
    # A place has as many bits as the entity's last one, so there are few levels where few signals share it, however long the time.
    span = placed.groupBy(*ENTITY).agg(F.length(F.bin(F.max("_x"))).alias("_top"))
    placed = placed.join(span, ENTITY)
    level = F.sequence(F.lit(0), F.col("_top"))
    began = (
        placed.where("not _asks")
        .withColumn("level", F.explode(level))
        .withColumn("node", F.expr("shiftright(_x, level)"))
        .select(*ENTITY, "level", "node", F.col("signal_id").alias("b_signal_id"), F.col("last_us").alias("b_last_us"))
        .withColumn("_salt", F.pmod(F.xxhash64("b_signal_id"), F.lit(SALTS)))
    )
    recent = [F.desc("b_last_us"), "b_signal_id"]
    node = [*ENTITY, "level", "node"]
    for part in ([*node, "_salt"], node):
        began = (
            began.withColumn("_n", F.row_number().over(Window.partitionBy(*part).orderBy(*recent)))
            .where(F.col("_n") <= limit + 1)
            .drop("_n")
        )
    asked = (
        placed.where("_asks")
        .withColumn("level", F.explode(F.filter(level, lambda i: F.getbit(F.col("_x"), i) == 1)))
        .withColumn("node", F.expr("shiftright(_x, level) - 1"))
        .select(*node, F.col("signal_id").alias("a_signal_id"), F.col("first_us").alias("a_first_us"))
    )
    found = asked.join(began.drop("_salt"), node).where(
        (F.col("a_signal_id") != F.col("b_signal_id")) & (F.col("b_last_us") >= F.col("a_first_us") - window_us)
    )
    w = Window.partitionBy(*ENTITY, "a_signal_id").orderBy(*recent)
    return (
        found.withColumn("_n", F.row_number().over(w))
        .where(F.col("_n") <= limit)
        .select(*ENTITY, "a_signal_id", "b_signal_id")
    )


def busy_pairs(busy: DataFrame, policy: model.CorrelationPolicy) -> DataFrame:
    """Pairs through busy entities, each end's most recent partners only."""
    sparse, dense = _crowded_targets(busy, policy)
    plain = [*ENTITY, "signal_id", *_TIME]
    quiet = _bucket_pairs(sparse.select(*plain), busy.select(*plain), policy.window_us, True)
    return quiet.select(*ENTITY, "a_signal_id", "b_signal_id").unionByName(recent_in_tree(dense, busy, policy))


def unordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(
        "tenant_id",
        F.least("a_signal_id", "b_signal_id").alias("left_signal_id"),
        F.greatest("a_signal_id", "b_signal_id").alias("right_signal_id"),
    ).distinct()


def _directed(profile: DataFrame, linkable: DataFrame, policy: model.CorrelationPolicy, both_ways: bool) -> DataFrame:
    primary = primary_rows(profile, linkable, policy).drop(*_SETS)
    calm, busy = split_by_load(primary, policy.candidate_limit)
    ends = [*ENTITY, "a_signal_id", "b_signal_id"]
    pairs = _bucket_pairs(calm, calm, policy.window_us, both_ways).select(*ends)
    return pairs if busy is None else pairs.unionByName(busy_pairs(busy, policy))


def candidate_pairs(profile: DataFrame, linkable: DataFrame, policy: model.CorrelationPolicy) -> DataFrame:
    """Distinct unordered candidate pairs (tenant_id, left_signal_id, right_signal_id)."""
    if policy.candidate_limit is not None:
        return unordered(_directed(profile, linkable, policy, False))
    primary = primary_rows(profile, linkable, policy).drop("ips")
    pairs = _bucket_pairs(primary, primary, policy.window_us, False)
    either_wide = F.col("a_wide") | F.col("b_wide")
    once = pairs.where(~either_wide & met_first(policy)).select(
        "tenant_id", F.col("a_signal_id").alias("left_signal_id"), F.col("b_signal_id").alias("right_signal_id")
    )
    if profile.where("wide").isEmpty():
        return once
    return once.unionByName(unordered(pairs.where(either_wide)))


def kept_candidates(profile: DataFrame, linkable: DataFrame, policy: model.CorrelationPolicy) -> DataFrame:
    """Directed: per signal, the candidates it keeps (tenant_id, a_signal_id, b_signal_id), distinct."""
    return _directed(profile, linkable, policy, True).select("tenant_id", "a_signal_id", "b_signal_id").distinct()


def candidate_stats(profile: DataFrame, linkable: DataFrame, policy: model.CorrelationPolicy) -> DataFrame:
    """Per tenant: the largest candidate set of a signal, the rows found for all, and whether any entity reached the limit."""
    rows = cut_lineage(_directed(profile, linkable, policy, True))
    per_entity = rows.groupBy(*ENTITY, "a_signal_id").agg(F.count(F.lit(1)).alias("_n"))
    per_signal = rows.select("tenant_id", "a_signal_id", "b_signal_id").distinct().groupBy("tenant_id", "a_signal_id").count()
    limit = policy.candidate_limit
    truncated = F.max("_n") >= limit if limit is not None else F.max("_n") < 0
    return (
        per_signal.groupBy("tenant_id").agg(F.max("count").alias("max_candidate_set_size"))
        .join(
            per_entity.groupBy("tenant_id").agg(truncated.alias("candidate_set_truncated"), F.sum("_n").alias("candidate_rows_evaluated")),
            "tenant_id",
        )
    )
