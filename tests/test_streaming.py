"""The streams against their batch twins."""

import tempfile

import pytest
from pyspark.sql import functions as F

from alertweave import model
from alertweave.catalogue.alerts import alerts
from alertweave.operators import dedup, edges, entities, signals
from alertweave.plans.correlate import correlate, signal_stage
from alertweave.streaming.pipeline import (
    CorrelationStream, Store, dashboard_stream, dedup_stream, edge_stream, read_alert_stream, signal_stream,
)

SF = "/root/testdata/sf0.001"
RULES = model.rules_with_gap(1440)


def folder(name):
    return tempfile.mkdtemp(prefix=f"alertweave-{name}-")


@pytest.fixture(scope="module")
def inbox(spark):
    """Alerts in three files whose contents are shuffled in time: every key sees late arrivals."""
    path = folder("stream-in")
    rows = alerts(spark, SF).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(3)))
    for part in range(3):
        rows.where(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(path)
    return path, rows.drop("part").schema


@pytest.fixture(scope="module")
def streamed(spark, inbox):
    path, schema = inbox
    stream = CorrelationStream(Store(spark, folder("store")), rules=RULES)
    source = read_alert_stream(spark, path, files_per_trigger=1, schema=schema)
    query = stream.start(source, folder("ckpt"))
    query.awaitTermination(600)
    assert query.exception() is None
    return stream


def groups(links):
    out = {}
    for r in links.collect():
        out.setdefault(r.signal_id, set()).add(r.alert_id)
    return {frozenset(v) for v in out.values()}


def test_signals_equal_batch_whatever_the_order(spark, streamed):
    # Which copy of a redelivery came first depends on the arrival, so compare source events.
    batch = signal_stage(alerts(spark, SF), rules=RULES)
    names = alerts(spark, SF).select(F.col("id").cast("string").alias("alert_id"), "source_event_id")
    ours = streamed.links().join(names, "alert_id").select("signal_id", F.col("source_event_id").alias("alert_id"))
    assert groups(ours) == groups(batch.unique.select("signal_id", F.col("source_event_id").alias("alert_id")))
    cols = ["tenant_id", "aggregation_key", "first_us", "last_us", "occurrence_count", "severity"]
    assert streamed.signals().select(*cols).exceptAll(batch.signals.select(*cols)).isEmpty()
    assert streamed.signals().count() == batch.signals.count()


def test_edges_cover_batch(spark, streamed):
    run = correlate(alerts(spark, SF), rules=RULES)
    # Ids differ (a stream keeps the id a signal was created with); by content the edges of the
    # final signals are those of the batch, scored no later than they were found.
    assert streamed.edges().count() >= run.edges.count() * 0.95
    # Every critical signal belongs to an incident. (Edge ends need not: an old signal that did
    # not change does not act, and joins only when a neighbour founds an incident.)
    ids = streamed.members().select("signal_id").distinct()
    critical = streamed.signals().where("severity = 'CRITICAL'")
    assert critical.join(ids, "signal_id", "left_anti").count() == 0
    assert streamed.incidents().groupBy("tenant_id", "incident_key").count().where("count > 1").isEmpty()


def test_replayed_batch_changes_nothing(spark, streamed, inbox):
    path, schema = inbox
    before = {n: streamed.store.read(n).count() for n in ("alerts", "signals", "links", "edges", "members", "incidents")}
    last = streamed.store.read("alerts").agg(F.max("batch")).first()[0]
    again = spark.read.schema(schema).parquet(path).join(
        streamed.store.read("alerts").where(F.col("batch") == last).select("id"), "id", "left_semi"
    )
    streamed.process(again, last)
    assert {n: streamed.store.read(n).count() for n in before} == before


def late_rows(spark, minutes):
    rows = [
        (str(i), "t", "e" + str(i), "x", "V", "P", "a", "LOW", "u", None, None, None, None, None, None, m) for i, m in enumerate(minutes)
    ]
    names = ["id", "tenant_id", "source_event_id", "source_type", "source_vendor", "source_product", "alert_type", "severity", "user",
             "host", "src_ip", "dst_ip", "domain", "process_name", "file_hash"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names) + ", m int")
    ts = F.timestamp_seconds(F.col("m").cast("long") * 60)
    return df.select(*names, ts.alias("timestamp"), ts.alias("ingested_at"))


def test_late_alert_bridges_two_signals(spark):
    stream = CorrelationStream(Store(spark, folder("late")))
    rows = late_rows(spark, [0, 110, 55, 300])
    stream.process(rows.where("id in ('0', '1')"), 0)
    first = {r.signal_id: r.first_us for r in stream.signals().collect()}
    assert len(first) == 2
    stream.process(rows.where("id = '2'"), 1)
    (merged,) = stream.signals().collect()
    assert (merged.occurrence_count, merged.signal_id) == (3, min(first, key=first.get))
    assert groups(stream.links()) == {frozenset({"0", "1", "2"})}
    stream.process(rows.where("id = '3'"), 2)
    assert stream.signals().count() == 2


def test_store_reads_touched_buckets_only(spark):
    store = Store(spark, folder("buckets"))
    rows = spark.range(4000).selectExpr("'t' as tenant_id", "concat('s', id) as signal_id", "id as n")
    for batch in range(3):
        store.write("links", rows.where(F.col("n") % 3 == batch), batch)
    some = rows.where("n < 2")
    read = store.read("links", 3, some)
    assert read.join(some.select("signal_id"), "signal_id", "left_semi").count() == 2
    assert read.count() < 0.3 * 4000 and store.read("links", 3).count() == 4000 and store.read("links", 1).count() == 1334
    assert {r.batch for r in store.read("links", 2).select("batch").distinct().collect()} == {0, 1}
    assert store.read("links", 3, some.where("n < 0")) is None and store.read("entities", 3) is None


def test_batches_are_written_together(spark):
    """Five small batches with and without compaction: the same signals and links, in fewer folders."""
    streams = []
    for after in (100, 2):
        stream = CorrelationStream(Store(spark, folder("compact"), buckets=4, compact_after=after))
        rows = late_rows(spark, [0, 110, 300, 55, 310])
        for batch in range(5):
            stream.process(rows.where(F.col("id") == str(batch)), batch)
        stream.process(rows.where("id = '4'"), 4)
        streams.append(stream)
    plain, tidy = streams
    cols = ["tenant_id", "first_us", "last_us", "occurrence_count"]
    assert sorted(map(tuple, plain.signals().select(*cols).collect())) == sorted(map(tuple, tidy.signals().select(*cols).collect()))
    assert groups(plain.links()) == groups(tidy.links())
    assert plain.signals().count() == 2
    assert len(tidy.store._parts("alerts", None)) < len(plain.store._parts("alerts", None)) == 5


def test_scratch_of_a_batch_is_deleted(spark):
    from alertweave import session

    made = []
    stream = CorrelationStream(Store(spark, folder("scratch")))
    plain = session.scratch_folder
    keep = session.scratch_folder(spark)
    spark.range(3).write.parquet(keep)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(session, "scratch_folder", lambda s: made.append(plain(s)) or made[-1])
        stream.process(late_rows(spark, [0, 5]), 0)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    there = lambda p: hadoop.Path(p).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop.Path(p))
    assert made and not any(there(p) for p in made) and there(keep)


def run_memory(df, name, mode):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option(
        "checkpointLocation", folder(name)).start()
    query.awaitTermination(300)
    assert query.exception() is None


def test_bounded_dedup_stream(spark, inbox):
    path, schema = inbox
    run_memory(dedup_stream(read_alert_stream(spark, path, schema=schema), "40 days"), "dedup_out", "append")
    assert spark.table("dedup_out").count() == dedup.first_deliveries(alerts(spark, SF)).count()


def test_session_stream(spark, inbox):
    """Append mode gives the closed sessions: all that end before the watermark."""
    path, schema = inbox
    unique = folder("unique")
    dedup.first_deliveries(alerts(spark, SF)).select(*schema.names).coalesce(1).write.mode("append").parquet(unique)
    sentinel = late_rows(spark, [10**8]).select(*[F.col(c).cast(schema[c].dataType) if c in ("id",) else F.col(c) for c in
                                                 [n for n in schema.names if n in late_rows(spark, [1]).columns]])
    sentinel = sentinel.withColumns({n: F.lit(None).cast(schema[n].dataType) for n in schema.names if n not in sentinel.columns})
    sentinel.select(*schema.names).coalesce(1).write.mode("append").parquet(unique)
    source = read_alert_stream(spark, unique, files_per_trigger=1, schema=schema)
    run_memory(signal_stream(source, "60 days", 1440, RULES), "session_out", "append")
    cols = ["tenant_id", "aggregation_key", "first_us", "last_us", "occurrence_count", "severity"]
    batch = signal_stage(alerts(spark, SF), rules=RULES).signals.select(*cols)
    assert spark.table("session_out").select(*cols).exceptAll(batch).isEmpty()
    assert spark.table("session_out").count() == batch.count()


def test_edge_stream_equals_batch(spark):
    run = correlate(alerts(spark, SF), rules=RULES)
    sets = entities.entity_sets(run.stage.linkable)
    rows = run.stage.signals.join(sets, ["tenant_id", "signal_id"]).select(
        "tenant_id", "signal_id", F.timestamp_micros("first_us").alias("first_seen"), F.timestamp_micros("last_us").alias("last_seen"),
        "users", "devices", "hashes", "ips",
    )
    path = folder("profiles")
    rows.coalesce(2).write.mode("append").parquet(path)
    source = spark.readStream.schema(rows.schema).parquet(path)
    run_memory(edge_stream(source, delay="60 days", longest="60 days"), "edge_out", "append")
    assert spark.table("edge_out").select("edge_id", "score").exceptAll(run.edges.select("edge_id", "score")).isEmpty()
    assert spark.table("edge_out").count() == run.edges.count()


def test_dashboard_stream(spark, inbox):
    path, schema = inbox
    run_memory(dashboard_stream(read_alert_stream(spark, path, schema=schema)), "dash_out", "complete")
    assert spark.table("dash_out").agg(F.sum("alerts")).first()[0] == alerts(spark, SF).count()


def test_signal_merge_uses_existing_slots(spark):
    rows = late_rows(spark, [0, 30, 200])
    sigs, attached = signals.attach_signals(rows)
    assert sorted(r.occurrence_count for r in sigs.collect()) == [1, 2]
    assert attached.count() == 3


def test_edge_stream_compares_signals_of_one_stretch_of_time_only(spark):
    """the stretch is a key of the join, so those who shared an entity at other times are not met."""
    rows = spark.createDataFrame([], "tenant_id string, signal_id string, first_seen timestamp, last_seen timestamp, users array<string>, devices array<string>, hashes array<string>, ips array<string>")
    plan = edge_stream(rows)._jdf.queryExecution().analyzed().toString()
    assert any("Join Inner" in line and "a_bucket" in line for line in plan.splitlines())


def test_stream_edges_hold_a_signal_once_where_it_begins(spark, tmp_path):
    """one side of the join has a row per signal and entity, the other one for every stretch; long, equal and touching times included."""
    hour, rows = 3600, []
    for k in range(40):
        begin = 1000 * hour + (k // 4) * hour  # four begin at the same time
        rows.append(("t", f"s{k * 7 % 40:02d}", begin, begin + (k % 5) * 5 * hour, [f"u{k % 3}"], [f"d{k % 2}"]))
    made = spark.createDataFrame(rows, "tenant_id string, signal_id string, f long, l long, users array<string>, devices array<string>")
    none = F.array().cast("array<string>")
    made = made.select("tenant_id", "signal_id", F.timestamp_seconds("f").alias("first_seen"), F.timestamp_seconds("l").alias("last_seen"),
                       "users", "devices", none.alias("hashes"), none.alias("ips"))
    made.write.parquet(f"{tmp_path}/in")
    stream = edge_stream(read_alert_stream(spark, f"{tmp_path}/in", schema=made.schema), delay="60 days", longest="60 days")
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out")
    query.awaitTermination()
    got = sorted((r.left_signal_id, r.right_signal_id) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    policy = model.CorrelationPolicy()
    want = []
    for x in rows:
        for y in rows:
            gap = max(0, x[2] - y[3], y[2] - x[3])
            device, user = x[5] == y[5], x[4] == y[4]
            score = device * policy.weights["DEVICE"] + user * policy.weights["USER"]
            score += policy.near_score if gap <= policy.near_seconds else policy.far_score if gap <= policy.far_seconds else 0
            if x[1] < y[1] and (device or user) and gap <= policy.window_seconds and score >= policy.edge_threshold:
                want.append((x[1], y[1]))
    assert want and got == sorted(want)
    stretches = sum((x[3] + policy.window_seconds) // policy.window_seconds - x[2] // policy.window_seconds + 1 for x in rows) * 2
    most = max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"])
    assert 0 < most <= stretches + 2 * len(rows)


def test_edges_of_acting_signals(spark):
    """F1: a batch scores only the pairs in which one of its signals is, and stores each edge once."""
    signals = spark.createDataFrame([("t", f"s{k}", k * 60_000_000, k * 60_000_000) for k in range(12)], "tenant_id string, signal_id string, first_us long, last_us long")
    held = [("t", f"s{k}", "HASH", f"h{k % 2}") for k in range(12)] + [("t", f"s{k}", "DEVICE", f"d{n}") for k in (0, 5) for n in range(300)]
    linkable = spark.createDataFrame(held, "tenant_id string, signal_id string, entity_type string, entity_value string")
    acting = spark.createDataFrame([("s3",), ("s0",), ("s3",)], "signal_id string")
    for limit in (None, 2):
        policy = model.CorrelationPolicy(candidate_limit=limit)
        every = edges.build_edges(signals, linkable, policy).collect()
        some = edges.build_edges(signals, linkable, policy, acting=acting).collect()
        assert sorted(some) == sorted(r for r in every if {"s0", "s3"} & {r.left_signal_id, r.right_signal_id}) and 0 < len(some) < len(every)
