"""Further inputs derived from the driver's tables: payloads, jobs, incidents, packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertweave.catalogue.alerts import alerts, table


def text(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def iso(ts: Column) -> Column:
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))


#: Pieces that `spread` deals rows into, for each core.
PIECES_A_CORE = 2


def spread(df: DataFrame) -> DataFrame:
    """`df` dealt out over all cores: a Parquet file is read by as many tasks as it has row groups, which may be one."""
    return df.repartition(PIECES_A_CORE * df.sparkSession.sparkContext.defaultParallelism)


def envelopes(spark: SparkSession, sf_dir: str, source_type: str, dealt: bool = False) -> DataFrame:
    """Every event as one vendor payload of the given source, with untidy values; `dealt` out over all cores for costly work on them."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    e = spread(e) if dealt else e
    i, u, kind, value = F.col("event_id"), F.col("user_id"), F.col("event_type"), F.col("value")
    when = iso(F.col("ts").cast("timestamp"))
    some = lambda n, c: F.when(i % n != 0, c)
    untidy_user = F.concat(F.lit("  User_"), text(u), F.lit("\t"))
    ip = F.concat(F.lit("10.0."), text(u % 7), F.lit("."), text(u % 50))
    level = F.when(value >= 150, "critical").when(value >= 80, "High").when(value >= 40, "medium").otherwise("x")
    fields = {
        "XDR": {
            "event_id": F.concat(F.lit("x-"), text(i)), "detected_at": some(11, when), "username": some(3, untidy_user),
            "hostname": F.concat(F.lit("HOST-"), text(F.expr("user_id div 3")), F.lit(" ")), "severity": level,
            "detection_name": some(5, kind), "process_name": F.when(i % 4 == 0, "").otherwise(F.lit("cmd.exe")),
            "process_path": F.lit("/bin/sh"), "cmdline": F.concat(F.lit("run "), text(i)), "src_ip": ip,
            "sha256": F.when(kind == "error", F.sha2(text(u), 256)),
        },
        "IAM": {
            "log_id": some(13, F.concat(F.lit("l-"), text(i))), "time": when,
            "actor_email": F.concat(untidy_user, F.lit("@Corp.example")), "source_ip": F.concat(F.lit(" "), ip),
            "action": F.when(i % 4 == 0, "login_failed").when(i % 4 == 1, "login"), "auth_method": some(2, F.lit("mfa")),
        },
        "FIREWALL": {
            "fw_rule_id": F.concat(F.lit("fw-"), text(i)), "timestamp": when, "src": ip,
            "dst": some(3, F.concat(F.lit("203.0.113."), text(i % 200))),
            "dns_query": F.when(i % 2 == 0, F.concat(F.lit("Evil-"), text(u), F.lit(".COM"))),
            "action": F.when(i % 3 == 0, "DENY").when(i % 3 == 1, "ALLOW"),
        },
        "CANONICAL": {
            "source_event_id": some(17, F.concat(F.lit("c-"), text(i))), "timestamp": when,
            "vendor": some(2, F.lit("Acme")), "product": some(3, F.lit("Sensor")),
            "category": F.when(i % 3 == 0, "network_activity").when(i % 3 == 1, "nonsense"),
            "class_name": F.when(i % 2 == 0, "User_Session"), "severity": level, "alert_type": some(5, kind),
            "user": untidy_user, "file_hash_algorithm": F.when(i % 3 == 0, "sha1").when(i % 3 == 1, "crc"),
            "file_hash": F.when(kind == "error", F.md5(text(u))),
        },
    }[source_type]
    payload = F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))
    return e.select(
        text(i).alias("raw_event_id"), F.concat(F.lit("tenant_"), text(u % 4)).alias("tenant_id"),
        F.lit(source_type.lower()).alias("source_type"), F.lit("Vendor").alias("source_vendor"),
        F.lit("Product").alias("source_product"), payload.alias("payload"),
    )


def crowded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(signals, entities): every event a signal of one tenant within two hours, one hash for all, a device of its own, one of three users."""
    e = table(spark, sf_dir, "events")
    first = F.expr("event_id * 7919 % 7200000000 + event_id % 7200 * 1000000")
    s = e.select(
        F.lit("t").alias("tenant_id"), F.col("event_id").alias("signal_id"), (first % 7_200_000_000).alias("first_us"),
        (first % 7_200_000_000 + F.when(F.col("event_id") % 10 == 0, 60_000_000).otherwise(0)).alias("last_us"), (F.col("user_id") % 3).alias("_u"),
    )
    held = F.array(*[F.struct(F.lit(t).alias("entity_type"), v.alias("entity_value")) for t, v in (
        ("HASH", F.lit("h")), ("DEVICE", F.concat(F.lit("d"), text("signal_id"))), ("USER", F.concat(F.lit("u"), text("_u"))))])
    entities = s.select("tenant_id", "signal_id", F.explode(held).alias("_e")).select("tenant_id", "signal_id", "_e.*")
    return s.drop("_u"), entities


def time_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event times written in eight ways, good and bad."""
    e = table(spark, sf_dir, "events")
    ts, i = F.col("ts").cast("timestamp"), F.col("event_id")
    day = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    written = (
        F.when(i % 8 == 0, F.concat(day, F.lit("Z")))
        .when(i % 8 == 1, F.concat(day, F.lit("+02:00")))
        .when(i % 8 == 2, F.concat(day, F.lit("-0530")))
        .when(i % 8 == 3, day)
        .when(i % 8 == 4, F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm"), F.lit(":60Z")))
        .when(i % 8 == 5, F.concat(F.lit("at "), day))
        .when(i % 8 == 6, text(F.unix_seconds(ts)))
    )
    return e.select("event_id", written.alias("written"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Investigation jobs out of orders: the customer plays the incident."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("job_id"), F.concat(F.lit("tenant_"), text(F.col("o_custkey") % 4)).alias("tenant_id"),
        text("o_custkey").alias("incident_key"), (F.col("o_orderkey") % 3 + 1).alias("incident_version"),
        F.concat(F.lit("fp_"), text(F.col("o_orderkey") % 2)).alias("package_fingerprint"),
        F.when(F.col("o_orderstatus") == "F", "SUCCEEDED").when(F.col("o_orderstatus") == "O", "PENDING")
        .when(F.col("o_orderkey") % 2 == 0, "RUNNING").otherwise("FAILED").alias("status"),
        F.col("o_orderdate").alias("created_at"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of those jobs out of lineitem."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("run_id"), F.col("l_orderkey").alias("job_id"),
        F.concat(F.lit("model_"), F.col("l_returnflag")).alias("provider"),
        F.when(F.col("l_linestatus") == "F", "SUCCESS").otherwise("FAILED_TIMEOUT").alias("status"),
    )


def order_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents out of orders, for counts at a larger volume."""
    o = table(spark, sf_dir, "orders")
    priority = F.substring("o_orderpriority", 1, 1)
    return o.select(
        F.concat(F.lit("tenant_"), text(F.col("o_custkey") % 4)).alias("tenant_id"),
        F.sha2(text("o_orderkey"), 256).alias("incident_key"),
        F.when(F.col("o_orderstatus") == "O", "OPEN").when(F.col("o_orderstatus") == "P", "INVESTIGATING")
        .otherwise("CLOSED").alias("status"),
        F.when(priority == "1", "CRITICAL").when(priority == "2", "HIGH").when(priority == "3", "MEDIUM")
        .when(priority == "4", "LOW").otherwise("INFO").alias("severity"),
        F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("first_us"),
        (F.unix_micros(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") * 1_000_000).alias("last_us"),
        (F.col("o_orderkey") % 3 + 1).alias("version"),
        text("o_custkey").alias("job_of"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as packages: the turn is the position, addresses are added to the text."""
    c = table(spark, sf_dir, "conversations")
    conv, turn = F.col("conv_id"), F.col("turn")
    added = F.concat(
        F.lit(" ask Agent"), text(turn % 3), F.lit("@Example.com or user_"), text((conv + turn) % 4),
        F.lit("@corp.example.org at 10.1."), text(turn % 2), F.lit("."), text(conv % 9), F.lit(" via 8.8.8.8"),
    )
    command = F.when(turn % 2 == 0, F.concat(
        F.lit("curl -u admin:pw"), text(turn), F.lit(" http://192.168.0."), text(turn % 4), F.lit("/x --token t"), text(conv),
        F.when((conv + turn) % 5 == 0, F.lit(" UNRECOGNIZED_SECRET_FORMAT_x1")).otherwise(F.lit("")),
    ))
    return c.select(
        conv.alias("package_id"), (turn + 1).alias("item_no"), F.concat(F.lit("tenant_"), text(conv % 4)).alias("tenant_id"),
        (conv * 1000 + turn).alias("id"), text(conv * 1000 + turn).alias("source_event_id"),
        F.timestamp_seconds(turn).alias("timestamp"), F.lit("XDR").alias("source_type"), F.lit("Message").alias("alert_type"),
        F.lit("LOW").alias("severity"),
        F.when(turn % 3 != 2, F.concat(F.lit(" USER_"), text((conv + turn) % 4), F.lit("@corp.example.org "))).alias("user"),
        F.when(turn % 2 == 1, F.concat(F.lit("Host"), text(turn % 4))).alias("host"),
        F.concat(F.lit("192.168.0."), text(turn % 4)).alias("src_ip"),
        F.when(turn % 2 == 0, F.lit("8.8.8.8")).otherwise(F.lit("203.0.113.9")).alias("dst_ip"),
        command.alias("command_line"), F.concat(F.col("text"), added).alias("message"), F.lit("").alias("file_hash"),
        F.col("text").alias("plain_text"),
    )


def alert_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All alerts of a user as one package, not numbered yet."""
    none = F.lit(None).cast("string")
    return alerts(spark, sf_dir).select(
        "*", F.concat_ws("/", "tenant_id", "src_ip").alias("package_id"), none.alias("command_line"), none.alias("message")
    )


def assessment_outputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(outputs, packages): model outputs in ten kinds, good and bad, one per event."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    ref = F.concat(F.lit("EVIDENCE_00"), text(i % 3 + 1))

    def body(ref_col: Column = ref, action: str = " isolate_host", disposition: str = "UNCERTAIN", confidence: str = "70"):
        return F.concat(
            F.lit('{"primary_hypothesis": "h'), text(i), F.lit('", "recommended_disposition": "' + disposition),
            F.lit('", "recommended_priority": "HIGH", "confidence": ' + confidence + ', "supporting_evidence": [{"evidence_ref": "'),
            ref_col, F.lit('", "reason": "r"}], "next_best_actions": [{"action_type": "' + action + '", "reason": "r", '),
            F.lit('"supporting_evidence_refs": ["EVIDENCE_001"]}]}'),
        )

    raw = (
        F.when(i % 10 == 0, body())
        .when(i % 10 == 1, F.concat(F.lit(" ```json\n"), body(), F.lit("\n``` ")))
        .when(i % 10 == 2, body(F.lit("EVIDENCE_999")))
        .when(i % 10 == 3, body(F.lit("123e4567-E89b-12d3-a456-426614174000")))
        .when(i % 10 == 4, F.lit("I think it is benign"))
        .when(i % 10 == 5, body(action="REBOOT"))
        .when(i % 10 == 6, body(confidence="101"))
        .when(i % 10 == 7, body(disposition="MAYBE"))
        .when(i % 10 == 8, F.lit("[1, 2]"))
        .otherwise(F.lit('{"primary_hypothesis": 5}'))
    )
    outputs = e.select(i.alias("package_id"), raw.alias("raw_json"))
    packages = e.select(
        i.alias("package_id"), F.array(F.lit("EVIDENCE_001"), F.lit("EVIDENCE_002"), F.lit("EVIDENCE_003")).alias("refs")
    )
    return outputs, packages
