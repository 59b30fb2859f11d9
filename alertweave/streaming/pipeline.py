"""The correlation as a stream: micro-batches over append-only tables, and native stateful queries.

The micro-batch form accepts alerts of any lateness. Each batch appends to tables under one
root folder, in a folder named after the batch, which a retry of that batch overwrites; what
a batch reads of the past excludes itself and later batches. So a batch may run any number
of times with one effect.

A signal keeps the id it was created with. A late alert that bridges several signals merges
them into the earliest one; the others get a row saying they are gone. Readers take the last
row of each id.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alertweave import model
from alertweave.functions import columns as C
from alertweave.operators import candidates, dedup, edges, entities, incidents, signals
from alertweave.session import Scratch, configure, cut_lineage, delete_folder

SIGNAL_COLUMNS = [*signals.KEY, "gap_us", "signal_id", "first_us", "last_us", "occurrence_count", "severity_rank", "anchor",
                  "severity", "anchor_alert_id"]


#: Parts a table is dealt into by the hash of its key, and batches after which they are written together.
BUCKETS = 16
COMPACT_AFTER = 8
# What each table is looked up by.
KEYS = {
    "alerts": ["tenant_id", "dedup_fingerprint"], "signals": signals.KEY, "links": ["tenant_id", "signal_id"],
    "entities": ["tenant_id", "signal_id"], "edges": ["edge_id"], "members": ["tenant_id", "signal_id"],
    "incidents": ["tenant_id", "incident_key"],
}
# Tables in which a later row replaces an earlier one.
REPLACED = {"signals": ["tenant_id", "signal_id"], "incidents": ["tenant_id", "incident_key"]}


@dataclass
class Store:
    """Append-only tables under one folder.

    A batch writes `name/batch=N/bucket=K`, which a repetition of the batch overwrites. Batches that can no longer be repeated
    are written together into `name/upto=N/bucket=K` now and then, without the rows that later ones have replaced. A
    reader that knows the keys it wants reads only their buckets, and one that knows the times it wants only
    the row groups whose least and greatest times reach there, as the files' footers tell.
    """

    spark: SparkSession
    root: str
    buckets: int = BUCKETS
    compact_after: int = COMPACT_AFTER

    def _files(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _found(self, pattern: str) -> list[str]:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{pattern}")
        return [status.getPath().toString() for status in self._files().globStatus(path) or []]

    def _bucket(self, name: str):
        return F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in KEYS[name]]), F.lit(self.buckets)).cast("int")

    def _parts(self, name: str, before: int | None) -> list[str]:
        """Folders to be read: the last compaction and the batches after it."""
        number = lambda path: int(path.rsplit("=", 1)[1])
        whole = [p.rsplit("/", 1)[0] for p in self._found(f"{name}/upto=*/_SUCCESS")]
        whole = [p for p in whole if before is None or number(p) < before]
        last = max(whole, key=number, default=None)
        after = -1 if last is None else number(last)
        batches = [p for p in self._found(f"{name}/batch=*") if number(p) > after and (before is None or number(p) < before)]
        return [*([last] if last else []), *sorted(batches, key=number)]

    def write(self, name: str, df: DataFrame, batch: int) -> DataFrame:
        path = f"{self.root}/{name}/batch={batch}"
        rows = df.withColumn("batch", F.lit(batch)).withColumn("bucket", self._bucket(name))
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path).drop("batch", "bucket")

    def read(self, name: str, before: int | None = None, touched: DataFrame | None = None) -> DataFrame | None:
        """All rows written by earlier batches (before=None: by all), with their batch number.

        `touched` has the table's key columns; then only the buckets of these keys are read, which hold other keys too.
        """
        parts = self._parts(name, before)
        names = "*"
        if touched is not None and parts:
            wanted = touched.select(self._bucket(name).alias("b")).distinct().collect()  # at most `buckets` rows
            names = "{" + ",".join(str(row.b) for row in wanted) + "}"
            if not wanted:
                return None
        paths = [p for part in parts for p in self._found(f"{part.removeprefix(self._qualified())}/bucket={names}")]
        return self.spark.read.parquet(*paths) if paths else None

    def _qualified(self) -> str:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        return self._files().makeQualified(path).toString() + "/"

    def compact(self, batch: int) -> list[str]:
        """Write the batches before the last one together, once there are enough of them; the tables it did so for.

        `batch` is the one at hand: it and the one before may still be repeated or read by a repetition.
        """
        done = []
        for name in KEYS:
            parts = [p for p in self._parts(name, batch - 1) if "/batch=" in p]
            if len(parts) < self.compact_after:
                continue
            upto = batch - 2
            rows = self.read(name, batch - 1)
            if rows is None:
                continue
            if name in REPLACED:
                newest = Window.partitionBy(*REPLACED[name]).orderBy(F.desc("batch"))
                rows = rows.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")
                if name == "signals":
                    rows = rows.where("not gone")
            path = f"{self.root}/{name}/upto={upto}"
            rows.withColumn("bucket", self._bucket(name)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
            older = [p for p in self._found(f"{name}/upto=*") if int(p.rsplit("=", 1)[1]) < upto]
            for old in [*older, *parts]:
                delete_folder(self.spark, old)
            done.append(name)
        return done


def last_rows(df: DataFrame, *key: str) -> DataFrame:
    """Per key, the row of the latest batch."""
    w = Window.partitionBy(*key).orderBy(F.desc("batch"))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "batch")


def current_signals(rows: DataFrame) -> DataFrame:
    return last_rows(rows, "tenant_id", "signal_id").where("not gone").drop("gone")


@dataclass
class CorrelationStream:
    """State and steps of the micro-batch correlation. Use `process` as a foreachBatch function."""

    store: Store
    policy: model.CorrelationPolicy = field(default_factory=model.CorrelationPolicy)
    rules: dict | None = None
    lookup: str = "exact"
    context: DataFrame | None = None

    def signals(self, before: int | None = None) -> DataFrame | None:
        rows = self.store.read("signals", before)
        return None if rows is None else current_signals(rows)

    def _alive(self, name: str, before: int | None, alive: DataFrame) -> DataFrame | None:
        """Rows of a table that belongs to signals, of signals that still are."""
        rows = self.store.read(name, before, alive)
        return None if rows is None else rows.drop("batch").join(alive.select("signal_id"), "signal_id", "left_semi").distinct()

    def links(self, before: int | None = None) -> DataFrame | None:
        now = self.signals(before)
        return None if now is None else self._alive("links", before, now)

    def edges(self, before: int | None = None) -> DataFrame | None:
        now, rows = self.signals(before), self.store.read("edges", before)
        if now is None or rows is None:
            return None
        ids = now.select("signal_id")
        for end in ("left_signal_id", "right_signal_id"):
            rows = rows.join(ids.withColumnRenamed("signal_id", end), end, "left_semi")
        return rows.drop("batch")

    def incidents(self, before: int | None = None) -> DataFrame | None:
        rows = self.store.read("incidents", before)
        return None if rows is None else last_rows(rows, "tenant_id", "incident_key")

    def members(self, before: int | None = None) -> DataFrame | None:
        now = self.signals(before)
        return None if now is None else self._alive("members", before, now)

    # -- one batch ---------------------------------------------------------------------------
    def _fresh(self, alerts: DataFrame, batch: int) -> DataFrame:
        """New alerts of this batch, tagged with rule, key and slot; kept for the history."""
        seen = self.store.read("alerts", batch, dedup.with_fingerprint(alerts))
        new = dedup.first_deliveries(alerts) if seen is None else dedup.new_deliveries(alerts, seen)
        return self.store.write("alerts", signals.with_slot(signals.with_rule(new, self.rules, self.lookup)), batch)

    def _fold(self, fresh: DataFrame, batch: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(changed signals, moved, slot -> signal): the batch folded into the signals of its keys.

        moved has key, signal_id and into_id of signals that were merged away.
        """
        slots = signals.slot_sums(fresh).withColumn("_old_id", F.lit(None).cast("string"))
        stored = self.store.read("signals", batch, fresh)
        rows = slots
        if stored is not None:
            # Only the rows of touched keys are looked at; those of signals gone carry their key too.
            touched = current_signals(stored.join(fresh.select(*signals.KEY).distinct(), signals.KEY, "left_semi"))
            old = touched.select("signal_id", *signals.KEY, "gap_us", "first_us", "last_us", "occurrence_count",
                                 "severity_rank", "anchor", F.lit(None).cast("bigint").alias("slot"))
            rows = slots.unionByName(old.withColumnRenamed("signal_id", "_old_id"))
        tagged = signals.tag_signals(rows)
        island = Window.partitionBy(*signals.KEY, "_island")
        oldest = F.min(F.when(F.col("_old_id").isNotNull(), F.struct("first_us", F.col("anchor.id").alias("a"), "_old_id")))
        keeper = oldest.over(island)["_old_id"]
        tagged = cut_lineage(
            tagged.withColumn("_touched", F.max(F.col("slot").isNotNull()).over(island))
            .withColumn("signal_id", F.coalesce(keeper, F.col("signal_id")))
            .where("_touched").drop("_touched")
        )
        changed = signals.fold(tagged).select(*SIGNAL_COLUMNS)
        moved = tagged.where("_old_id is not null and _old_id <> signal_id").select(
            *signals.KEY, F.col("_old_id").alias("signal_id"), F.col("signal_id").alias("into_id")
        )
        return changed, moved, tagged.where("slot is not null").select(*signals.KEY, "slot", "signal_id")

    def _carry(self, name: str, new: DataFrame, moved: DataFrame, batch: int) -> DataFrame:
        """Write rows of this batch, and again, under the new id, the rows of merged signals."""
        past = self.store.read(name, batch, moved)
        if past is not None:
            into = moved.select("tenant_id", "signal_id", "into_id")
            again = past.drop("batch").join(into, ["tenant_id", "signal_id"]).withColumn("signal_id", F.col("into_id"))
            new = new.unionByName(again.drop("into_id")).distinct()
        return self.store.write(name, new, batch)

    def process(self, alerts: DataFrame, batch: int) -> None:
        """One batch: what it stores on the way is deleted at its end, old batches are written together now and then."""
        configure(self.store.spark)
        with Scratch() as scratch:
            self._process(alerts, batch)
        scratch.drop(self.store.spark)
        self.store.compact(batch)

    def _process(self, alerts: DataFrame, batch: int) -> None:
        fresh = self._fresh(alerts, batch)
        if fresh.isEmpty():
            return
        changed, moved, where = self._fold(fresh, batch)
        gone = moved.select(*signals.KEY, "signal_id").distinct()
        kept = {*signals.KEY, "signal_id"}
        blank = {c: F.lit(None).cast(changed.schema[c].dataType) for c in SIGNAL_COLUMNS if c not in kept}
        rows = changed.withColumn("gone", F.lit(False)).unionByName(
            gone.withColumns(blank).withColumn("gone", F.lit(True)).select(*SIGNAL_COLUMNS, "gone")
        )
        self.store.write("signals", rows, batch)

        attached = fresh.join(where, [*signals.KEY, "slot"])
        self._carry("links", attached.select("tenant_id", "signal_id", F.col("id").cast("string").alias("alert_id")), moved, batch)
        self._carry("entities", entities.signal_entities(attached), moved, batch)
        self._correlate(cut_lineage(changed.select("tenant_id", "signal_id", "first_us", "last_us")), batch)

    def _surroundings(self, acting: DataFrame, batch: int) -> DataFrame:
        """Current signals close enough in time to the changed ones to matter.

        A signal's span only grows, so rows out of reach can go before the latest is picked.
        """
        window = self.policy.window_us
        span = acting.groupBy("tenant_id").agg(
            (F.min("first_us") - window).alias("_lo"), (F.max("last_us") + window).alias("_hi")
        )
        reach = acting.agg(F.min("first_us") - window, F.max("last_us") + window).first()
        # As plain numbers the bounds reach the files' footers; the join then looks at each tenant's own.
        rows = self.store.read("signals", batch + 1).where(f"gone or (last_us >= {reach[0]} and first_us <= {reach[1]})").join(span, "tenant_id").where("gone or (last_us >= _lo and first_us <= _hi)")
        return cut_lineage(current_signals(rows.drop("_lo", "_hi")))

    def _past_incidents(self, near: DataFrame, batch: int) -> tuple[DataFrame | None, DataFrame | None]:
        """(incidents, members) of earlier batches that hold any of the given signals."""
        members = self.store.read("members", batch, near)
        if members is None:
            return None, None
        members = cut_lineage(members.drop("batch").join(near.select("signal_id"), "signal_id", "left_semi").distinct())
        key = ["tenant_id", "incident_key"]
        rows = self.store.read("incidents", batch, members)
        if rows is None:
            return None, None
        return last_rows(rows.join(members.select(*key).distinct(), key, "left_semi"), *key), members

    def _correlate(self, acting: DataFrame, batch: int) -> None:
        near = self._surroundings(acting, batch)
        named = self._alive("entities", batch + 1, near)
        linkable = cut_lineage(entities.linkable_entities(named, self.policy, self.context))
        ids = acting.select("signal_id")
        ours = cut_lineage(edges.build_edges(near, linkable, self.policy, acting=ids))
        stored = self.store.read("edges", batch, ours)
        new = ours if stored is None else edges.insert_if_absent(ours, stored, ["edge_id"])
        self.store.write("edges", new.select(*edges.EDGE_COLUMNS), batch)

        old, old_members = self._past_incidents(near, batch)
        decisions = cut_lineage(
            incidents.decide(near, ours, linkable, self.policy, old, old_members, acting=ids)
        )
        touched = incidents.incident_rows(decisions, near, linkable, self.policy, old).join(
            decisions.select("tenant_id", "incident_key").distinct(), ["tenant_id", "incident_key"], "left_semi"
        )
        members = incidents.memberships(decisions, ours)
        self.store.write("members", members, batch)
        self.store.write("incidents", touched, batch)

    def start(self, stream: DataFrame, checkpoint: str, **trigger):
        """Run over a stream of alerts. Default trigger: everything there is, then stop."""
        return (
            stream.writeStream.foreachBatch(self.process)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )


# ---- native streaming queries -----------------------------------------------------------------------
def read_alert_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None, schema=model.ALERT_SCHEMA) -> DataFrame:
    """Alerts from a folder of Parquet files, each file once."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def dedup_stream(alerts: DataFrame, delay: str = "1 day") -> DataFrame:
    """First deliveries with state bounded by a watermark: copies later than the delay pass."""
    return (
        dedup.with_fingerprint(alerts)
        .withColumn("_key", F.coalesce("dedup_fingerprint", F.concat(F.lit("row:"), F.col("id").cast("string"))))
        .withWatermark("timestamp", delay)
        .dropDuplicatesWithinWatermark(["tenant_id", "_key"])
        .drop("_key")
    )


def signal_stream(alerts: DataFrame, delay: str = "1 hour", minutes: int = 60, rules: dict | None = None,
                  lookup: str = "exact") -> DataFrame:
    """Signals that are closed for good once the watermark has passed them (append mode)."""
    return signals.session_window_signals(alerts.withWatermark("timestamp", delay), minutes, rules, lookup)


def edge_stream(profiles: DataFrame, policy: model.CorrelationPolicy | None = None, delay: str = "1 hour",
                longest: str = "7 days") -> DataFrame:
    """Edges between closed signals: a stream-stream interval join with bounded state.

    `profiles` is a stream of signals: tenant_id, signal_id, first_seen, last_seen and the arrays
    users, devices, hashes, ips of linkable entities. Each pair comes out once, for the first
    primary entity it shares. `longest` is the longest a signal may last (a proven bound of the
    feed): it lets the join forget; longer signals belong to the micro-batch form.
    """
    policy = policy or model.CorrelationPolicy()
    window = F.expr(f"interval {policy.window_seconds} seconds")

    def typed(kind: str, column: str):
        return F.transform(F.col(column), lambda v: F.concat(F.lit(f"{kind}:"), v))

    tagged = (
        profiles.withColumn("primary", F.concat(typed("DEVICE", "devices"), typed("HASH", "hashes"), typed("USER", "users")))
        .withColumn("entity", F.explode("primary"))
        .withColumn("first_us", C.to_us(F.col("first_seen"))).withColumn("last_us", C.to_us(F.col("last_seen")))
    )
    # Met in stretches of time as long as the window, so a signal is not compared with all that ever shared its entity: where
    # the later one begins. So one side holds a signal once an entity, only the other one in all stretches it reaches.
    reaching = candidates._in_buckets(tagged, policy.window_us)
    beginning = tagged.withColumn("bucket", F.expr(f"first_us div {policy.window_us}"))

    def side(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(*[F.col(c).alias(f"{name}_{c}") for c in rows.columns]).withWatermark(f"{name}_last_seen", delay)

    later = (F.col("b_first_us") > F.col("a_first_us")) | ((F.col("b_first_us") == F.col("a_first_us")) & (F.col("b_signal_id") > F.col("a_signal_id")))
    joined = side(reaching, "a").join(
        side(beginning, "b"),
        (F.col("a_tenant_id") == F.col("b_tenant_id")) & (F.col("a_entity") == F.col("b_entity")) & (F.col("a_bucket") == F.col("b_bucket"))
        & (F.col("a_signal_id") != F.col("b_signal_id")) & later
        & (F.col("b_first_seen") <= F.col("a_last_seen") + window)
        & (F.col("b_last_seen") >= F.col("a_first_seen") - window)
        & (F.col("b_last_seen") <= F.col("a_last_seen") + window + F.expr(f"interval {longest}"))
        & (F.col("b_last_seen") >= F.col("a_last_seen") - window - F.expr(f"interval {longest}")),
    )
    once = joined.where(F.col("a_entity") == F.array_min(F.array_intersect("a_primary", "b_primary")))
    scored = edges._score(once.withColumn("tenant_id", F.col("a_tenant_id")), edges._by_arrays(), policy)
    return edges.with_edge_id(scored.where(F.col("score") >= policy.edge_threshold), policy)


def dashboard_stream(alerts: DataFrame) -> DataFrame:
    """Running alert counts per tenant, product and severity (complete or update mode)."""
    return alerts.groupBy("tenant_id", "source_product", "severity").agg(F.count(F.lit(1)).alias("alerts"))
