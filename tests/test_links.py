"""Candidate search and scoring against brute force, with crowded entities and ties."""

import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from alertweave import model
from alertweave.operators import candidates, components, edges, entities, hot, link_classes
from alertweave.session import Scratch, cut_lineage

HOUR = 3_600_000_000


def make(seed, n, devices, spread_hours, users=5, long=False):
    rng = random.Random(seed)
    signals, ents = [], []
    for i in range(n):
        first = int(rng.random() * spread_hours * 60) * 60_000_000
        last = first + (rng.choice([0, 0, 60_000_000, 5 * HOUR, 40 * HOUR]) if long else rng.choice([0, 60_000_000]))
        sid = f"s{i:04d}"
        signals.append(("t", sid, first, last))
        ents.append(("t", sid, "DEVICE", f"d{rng.randrange(devices)}"))
        if rng.random() < 0.7:
            ents.append(("t", sid, "USER", f"u{rng.randrange(users)}"))
        ents += [("t", sid, "IP", ip) for ip in {f"i{rng.randrange(6)}" for _ in range(rng.randrange(3))}]
        if rng.random() < 0.3:
            ents.append(("t", sid, "HASH", f"h{rng.randrange(4)}"))
    return signals, ents


def frames(spark, signals, ents):
    s = spark.createDataFrame(signals, "tenant_id string, signal_id string, first_us bigint, last_us bigint")
    e = spark.createDataFrame(ents, "tenant_id string, signal_id string, entity_type string, entity_value string")
    return s, e


def brute_kept(signals, ents, policy):
    """Directed pairs: per signal and shared primary entity the most recent ones, then their union."""
    by_entity = {}
    info = {s[1]: s for s in signals}
    for _, sid, kind, value in ents:
        if kind in policy.primary_types:
            by_entity.setdefault((kind, value), []).append(sid)
    kept = set()
    for members in by_entity.values():
        for a in members:
            near = [
                b for b in members
                if b != a and info[b][2] <= info[a][3] + policy.window_us and info[b][3] >= info[a][2] - policy.window_us
            ]
            near.sort(key=lambda b: (-info[b][3], b))
            kept |= {(a, b) for b in near[: policy.candidate_limit]}
    return kept


def brute_scores(signals, ents, policy):
    info = {s[1]: s for s in signals}
    sets = {}
    for _, sid, kind, value in ents:
        sets.setdefault((sid, kind), set()).add(value)
    out = {}
    for a, b in {tuple(sorted(p)) for p in brute_kept(signals, ents, policy)}:
        score = sum(w for k, w in policy.weights.items() if sets.get((a, k), set()) & sets.get((b, k), set()))
        gap = max(0, info[a][2] - info[b][3], info[b][2] - info[a][3])
        score += policy.near_score if gap <= 300e6 else policy.far_score if gap <= 3600e6 else 0
        out[a, b] = score
    return out


CASES = [
    # (limit, n, devices, spread hours, long-lasting): calm, busy but sparse in time, crowded, crowded with long signals
    (1000, 120, 8, 30, False),
    (12, 150, 1, 300, False),
    (4, 150, 2, 8, False),
    (3, 150, 2, 30, True),
    (5, 120, 1, 0, False),
]


@pytest.mark.parametrize(("limit", "n", "devices", "spread", "long"), CASES)
def test_candidates_and_scores_equal_brute_force(spark, limit, n, devices, spread, long):
    policy = model.CorrelationPolicy(candidate_limit=limit)
    signals, ents = make(limit * 7 + n, n, devices, spread, long=long)
    s, e = frames(spark, signals, ents)
    profile = candidates.profiles(s, e)
    kept = {(r.a_signal_id, r.b_signal_id) for r in candidates.kept_candidates(profile, e, policy).collect()}
    want = brute_kept(signals, ents, policy)
    assert kept == want
    scored = {(r.left_signal_id, r.right_signal_id): r.score for r in edges.scored_pairs(profile, e, policy).collect()}
    assert scored == brute_scores(signals, ents, policy)


def test_dense_entity_keeps_the_most_recent(spark):
    """1 005 signals, one hash, one second apart: everyone keeps 1 000, the flagship limit."""
    signals = [("t", f"s{i:04d}", i * 1_000_000, i * 1_000_000) for i in range(1005)]
    ents = [("t", sid, "HASH", "h") for _, sid, _, _ in signals]
    s, e = frames(spark, signals, ents)
    policy = model.CorrelationPolicy(candidate_limit=1000)
    kept = candidates.kept_candidates(candidates.profiles(s, e), e, policy)
    per = kept.groupBy("a_signal_id").agg(F.count(F.lit(1)).alias("n"), F.min("b_signal_id").alias("oldest"))
    rows = {r.a_signal_id: (r.n, r.oldest) for r in per.collect()}
    assert {n for n, _ in rows.values()} == {1000}
    assert rows["s1004"] == (1000, "s0004")
    assert rows["s0000"] == (1000, "s0005")


@pytest.mark.parametrize(("n", "devices", "spread", "long", "cell"), [(120, 8, 30, False, 300), (150, 1, 9, False, 300), (120, 2, 20, True, 300), (100, 1, 0, False, 60), (90, 2, 4, True, 3000)])
def test_class_links_equal_brute_force(spark, n, devices, spread, long, cell):
    """Counts by class and score, and the pairs behind them, against all pairs; few values, so that classes are large."""
    policy = model.CorrelationPolicy()
    signals, ents = make(n + devices, n, devices, spread, users=2, long=long)
    ents = [e for e in ents if e[2] != "IP"] + [("t", sid, "DEVICE", f"own-{sid}") for _, sid, _, _ in signals]
    s, e = frames(spark, signals, ents)
    found = link_classes.class_links(s, e, policy, cell_us=cell * 1_000_000)
    want = brute_scores(signals, ents, policy)
    rows = found.links.collect()
    assert sum(r.n_links for r in rows) == len(want)
    pairs = link_classes.expand(found, found.links, policy).collect()
    assert len(pairs) == len(want) and {(r.left_signal_id, r.right_signal_id): r.score for r in pairs} == want
    of = {r.signal_id: r.class_id for r in found.members.collect()}
    assert all(of[r.class_id] == r.class_id for r in found.classes.collect())
    counts = {}
    for (a, b), score in want.items():
        key = (*sorted((of[a], of[b])), score)
        counts[key] = counts.get(key, 0) + 1
    assert {(r.left_class_id, r.right_class_id, r.score): r.n_links for r in rows} == counts
    best = {(r.left_signal_id, r.right_signal_id): set(r.reasons) for r in edges.scored_pairs(candidates.profiles(s, e), e, policy, 50).collect()}
    kept = link_classes.class_links(s, e, policy, 50, cell * 1_000_000)
    assert {(r.left_signal_id, r.right_signal_id): set(r.reasons) for r in link_classes.expand(kept, kept.links, policy).collect()} == best


def test_class_links_of_wide_signals(spark, monkeypatch):
    policy = model.CorrelationPolicy()
    signals, ents = make(3, 60, 4, 6)
    s, e = frames(spark, signals, ents)
    want = brute_scores(signals, ents, policy)
    monkeypatch.setattr(entities, "ARRAY_LIMIT", 2)
    found = link_classes.class_links(s, e, policy)
    assert {(r.left_signal_id, r.right_signal_id): r.score for r in link_classes.expand(found, found.links, policy).collect()} == want


def test_crowded_entity_in_one_window(spark):
    """100 000 signals share one hash within two hours, and nobody's device: 5 billion pairs, a few hundred rows."""
    n = 100_000
    s = spark.range(0, n, 1, 8).selectExpr("'t' as tenant_id", "format_string('s%06d', id) as signal_id", "id * 72000 as first_us", "id * 72000 as last_us")
    e = s.selectExpr("tenant_id", "signal_id", "'HASH' as entity_type", "'h' as entity_value").unionByName(
        s.selectExpr("tenant_id", "signal_id", "'DEVICE' as entity_type", "signal_id as entity_value"))
    found = link_classes.class_links(s, e, model.CorrelationPolicy())
    links = found.links.groupBy("score").agg(F.sum("n_links").alias("n"), F.count(F.lit(1)).alias("rows"))
    near, far = 300_000_000 // 72_000, 3_600_000_000 // 72_000
    within = lambda d: d * n - d * (d + 1) // 2
    assert {r.score: r.n for r in links.collect()} == {65: within(near), 55: within(far) - within(near), 50: n * (n - 1) // 2 - within(far)}
    assert found.classes.count() == 24 and found.links.count() < 1000


def test_wide_signals_score_like_narrow_ones(spark, monkeypatch):
    policy = model.CorrelationPolicy()
    signals, ents = make(3, 60, 4, 6)
    s, e = frames(spark, signals, ents)
    want = brute_scores(signals, ents, policy)
    monkeypatch.setattr(entities, "ARRAY_LIMIT", 2)
    got = {(r.left_signal_id, r.right_signal_id): r.score for r in edges.scored_pairs(candidates.profiles(s, e), e, policy).collect()}
    assert got == want


def test_no_cross_join_and_no_single_partition(spark):
    signals, ents = make(1, 40, 4, 6)
    s, e = frames(spark, signals, ents)
    plan = edges.build_edges(s, e, model.CorrelationPolicy())._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "SinglePartition" not in plan


def brute_components(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    groups = {}
    for x in list(parent):
        groups.setdefault(find(x), []).append(x)
    return {x: min(g) for g in groups.values() for x in g}


@pytest.mark.parametrize("shape", ["random", "path", "star", "empty"])
def test_components(spark, shape):
    rng = random.Random(5)
    ids = [f"n{rng.randrange(10**6):06d}" for _ in range(120)]
    pairs = {
        "random": [tuple(sorted(rng.sample(ids, 2))) for _ in range(90)],
        "path": list(itertools.pairwise(ids)),
        "star": [(ids[0], i) for i in ids[1:]],
        "empty": [],
    }[shape]
    df = spark.createDataFrame(pairs, "left_signal_id string, right_signal_id string")
    got = {r.signal_id: r.component for r in components.connected_components(df).collect()}
    assert got == brute_components(pairs)


@pytest.mark.parametrize("shape", ["random", "star", "two stars"])
def test_components_with_hubs_left_in_place(spark, monkeypatch, shape):
    monkeypatch.setattr(hot, "HOT_ROWS", 3)
    monkeypatch.setattr(hot, "HOT_KEYS", 20)
    rng = random.Random(6)
    ids = [f"n{rng.randrange(10**6):06d}" for _ in range(150)]
    pairs = {
        "random": [tuple(sorted(rng.sample(ids, 2))) for _ in range(110)],
        "star": [(ids[0], i) for i in ids[1:]],
        "two stars": [(ids[k % 2], i) for k, i in enumerate(ids[2:100])] + [(ids[50], ids[51]), (ids[120], ids[121])],
    }[shape]
    df = spark.createDataFrame(pairs, "left_signal_id string, right_signal_id string")
    got = {r.signal_id: r.component for r in components.connected_components(df).collect()}
    assert got == brute_components(pairs)


def test_rows_of_a_hub_are_not_gathered(spark):
    """Half of 80 000 rows belong to one vertex: after the join no task holds much more than the others."""
    rows = spark.range(0, 80_000, 1, 8).selectExpr("if(id % 2 = 0, 'hub', concat('v', id)) as v", "concat('w', id) as to")
    least = rows.groupBy("v").agg(F.min("to").alias("_least"), F.count(F.lit(1)).alias("_n"))
    joined = hot.join_in_place(rows, least, ["v"], 80_000)
    assert joined.count() == 80_000 and joined.where("v = 'hub'").select("_least").distinct().count() == 1
    held = joined.groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in held) < 0.35 * 80_000
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftAnti" in plan


def test_no_candidate_limit_by_default(spark):
    signals = [("t", f"s{i:04d}", i * 1_000_000, i * 1_000_000) for i in range(1005)]
    s, e = frames(spark, signals, [("t", sid, "HASH", "h") for _, sid, _, _ in signals])
    policy = model.CorrelationPolicy()
    (row,) = candidates.candidate_stats(candidates.profiles(s, e), e, policy).collect()
    assert (row.max_candidate_set_size, row.candidate_set_truncated) == (1004, False)


def test_slots_round_down_before_1970(spark):
    from alertweave.operators.signals import _slot

    rows = spark.range(-7, 8).selectExpr("id as ts_us", "3L as gap_us").selectExpr("ts_us", f"{_slot('ts_us')} as slot").collect()
    assert all(r.slot == r.ts_us // 3 for r in rows)


def test_rows_without_fingerprint_go_around_the_join(spark):
    from alertweave.operators import dedup

    alerts = spark.createDataFrame(
        [("t", "XDR", "v", "p", None if i % 10 else "same", i, i) for i in range(100)],
        "tenant_id string, source_type string, source_vendor string, source_product string, source_event_id string, ingested_at long, id long",
    )
    history = spark.createDataFrame([], "tenant_id string, dedup_fingerprint string, id long")
    marked = dedup.mark_duplicates(alerts, history)
    assert marked.count() == 100 and marked.where("duplicate_of_alert_id is not null").count() == 9
    assert dedup.new_deliveries(alerts, history).count() == 91
    known = dedup.first_deliveries(alerts).where("dedup_fingerprint is not null").select("tenant_id", "dedup_fingerprint", "id")
    assert dedup.new_deliveries(alerts, known).count() == 90


def test_partners_of_whole_classes_are_not_listed(spark, monkeypatch):
    """Counts equal those of the listed pairs; a class of which all pairs are in one band is counted by rank."""
    from alertweave.operators import link_classes

    rng = random.Random(5)
    rows = [(f"s{i:03d}", rng.randrange(900) * 1_000_000, rng.choice([0, 700])) for i in range(150)]
    s = spark.createDataFrame([("t", i, a, a + d * 1_000_000) for i, a, d in rows], "tenant_id string, signal_id string, first_us bigint, last_us bigint")
    e = spark.createDataFrame([("t", i, "HASH", "h") for i, _, _ in rows], "tenant_id string, signal_id string, entity_type string, entity_value string")
    policy = model.CorrelationPolicy()
    listing = link_classes.expand
    for cell in (300_000_000, 7_200_000_000):
        found = link_classes.class_links(s, e, policy, cell_us=cell)
        for links in (found.links, found.links.where("left_class_id = right_class_id")):
            want = listing(found, links, policy).groupBy("left_signal_id", "score").count()
            got = link_classes.partners(found, links, policy).select("left_signal_id", "score", "partners")
            assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}
        if cell == 300_000_000:
            seen = []
            monkeypatch.setattr(link_classes, "expand", lambda f, rows, p: seen.append(rows.count()) or listing(f, rows, p))
            link_classes.partners(found, found.links.where("left_class_id = right_class_id"), policy)
            monkeypatch.undo()
            assert seen == [0]


def test_pairs_come_once_without_gathering_them(spark):
    """F28-F31: two signals that share device, user and hash are one pair, and no pair is shuffled to find that out."""
    policy = model.CorrelationPolicy()
    signals = [("t", sid, k * HOUR, k * HOUR) for k, sid in enumerate("abc")]
    ents = [("t", sid, kind, "x") for sid in "abc" for kind in ("DEVICE", "USER", "HASH")] + [("t", "b", "DEVICE", "a"), ("t", "c", "DEVICE", "a")]
    s, e = frames(spark, signals, ents)
    profile = candidates.profiles(s, e)
    for found in (candidates.candidate_pairs(profile, e, policy), edges.scored_pairs(profile, e, policy)):
        assert sorted((r.left_signal_id, r.right_signal_id) for r in found.collect()) == [("a", "b"), ("a", "c"), ("b", "c")]
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert not any("Aggregate" in line and "left_signal_id" in line for line in plan.splitlines())


def test_tree_is_as_deep_as_signals_are_many(spark, monkeypatch):
    """F1, F22: 40 signals within ten years need levels for 80 places, not for the microseconds between them."""
    policy = model.CorrelationPolicy(candidate_limit=2, window_seconds=86400 * 4000)
    signals = [("t", f"s{i:02d}", i * 90 * 24 * HOUR, i * 90 * 24 * HOUR) for i in range(40)]
    ents = [("t", sid, "HASH", "h") for _, sid, _, _ in signals]
    s, e = frames(spark, signals, ents)
    stored, store = [], candidates.cut_lineage
    monkeypatch.setattr(candidates, "cut_lineage", lambda df: stored.append(store(df)) or stored[-1])
    kept = {(r.a_signal_id, r.b_signal_id) for r in candidates.kept_candidates(candidates.profiles(s, e), e, policy).collect()}
    assert kept == brute_kept(signals, ents, policy)
    (placed,) = [df for df in stored if "_x" in df.columns]
    assert placed.agg(F.max("_x")).first()[0] == 79


def test_rounds_of_components_see_a_row_per_vertex(spark, monkeypatch):
    """F23, F3-F11: all 1 770 links of 60 signals are read to hook them and to find links between trees, not in every round."""
    pairs = list(itertools.combinations([f"n{i:02d}" for i in range(60)], 2))
    df = spark.createDataFrame(pairs, "left_signal_id string, right_signal_id string")
    rows, stored = [], components._stored
    monkeypatch.setattr(components, "_stored", lambda stars: (lambda got: rows.append(got[1]["rows"]) or got)(stored(stars)))
    got = {r.signal_id: r.component for r in components.connected_components(df).collect()}
    assert got == dict.fromkeys({x for p in pairs for x in p}, "n00")
    assert max(rows) <= 60


def test_components_pass_no_table_through_the_driver(spark):
    """Pipeline, F21: rounds of the contraction merge, also where a table is small enough to be broadcast."""
    rows = spark.range(3).selectExpr("concat('v', id) as v", "concat('w', id) as to")
    facts = rows.groupBy("v").agg(F.min("to").alias("_least"), F.count(F.lit(1)).alias("_n"))
    assert "Broadcast" not in hot.join_in_place(rows, facts, ["v"], 2)._jdf.queryExecution().executedPlan().toString()


def test_shuffle_files_go_when_a_table_is_stored(spark):
    """Pipeline, check_h: files of small shuffles, of which one takes a block of disk however few rows it holds, don't wait for the driver's garbage collector."""
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    named = lambda: {name for name in str(blocks.getAllBlocks()).replace(")", ",").replace("(", ",").split(",") if "shuffle_" in name}
    before = named()
    stored = cut_lineage(spark.range(0, 10_000, 1, 8).groupBy((F.col("id") % 100).alias("k")).count().join(spark.range(100).withColumnRenamed("id", "k").hint("merge"), "k"))
    assert stored.count() == 100
    late = time.time() + 20
    while (left := named() - before) and time.time() < late:
        time.sleep(0.2)
    assert not left


def test_rounds_of_components_leave_no_tables(spark):
    """Pipeline, check_h: of the tables of all rounds only the last one of each contraction stays."""
    rng = random.Random(7)
    ids = [f"n{rng.randrange(10**6):06d}" for _ in range(150)]
    df = spark.createDataFrame(list(itertools.pairwise(ids)), "left_signal_id string, right_signal_id string")
    with Scratch() as scratch:
        got = components.connected_components(df)
    assert {r.component for r in got.collect()} == {min(ids)}
    assert len(scratch.folders) <= 5 and got.count() == len(set(ids))
    with Scratch() as scratch:  # stored links are not copied
        components.connected_components(df, keep=lambda rows: rows)
    assert len(scratch.folders) <= 4
