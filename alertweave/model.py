"""Fixed vocabulary, thresholds and table schemas shared by every stage."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# Enumerations of the alert schema.
SEVERITIES = ["INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL"]
SOURCE_TYPES = ["XDR", "IAM", "FIREWALL", "CANONICAL", "UNKNOWN"]
CATEGORIES = ["AUTHENTICATION", "NETWORK_ACTIVITY", "ENDPOINT_ACTIVITY", "SYSTEM_ACTIVITY"]
CLASSES = ["PROCESS_ACTIVITY", "USER_SESSION", "NETWORK_FLOW", "SYSTEM_LOG", "UNKNOWN"]
HASH_ALGORITHMS = ["MD5", "SHA1", "SHA256", "SHA512", "UNKNOWN"]
ENTITY_TYPES = ["USER", "DEVICE", "IP", "DOMAIN", "PROCESS", "FILE", "HASH"]
ACTIVE_STATUSES = ["OPEN", "INVESTIGATING"]
JOB_STATES = ["PENDING", "RUNNING", "SUCCEEDED", "FAILED", "STALE", "CANCELLED"]
RUN_STATES = ["SUCCESS", "FAILED_VALIDATION", "FAILED_TIMEOUT", "FAILED"]

# Limits.
ENVELOPE_BATCH_LIMIT = 1000
IMPORT_EXTENSIONS = ["csv", "json", "jsonl", "ndjson"]
IMPORT_MAX_BYTES = 50 * 1024 * 1024
CURSOR_BATCH = 5000
EVIDENCE_LIMIT = 50
FINGERPRINT_VERSION = "exact-v1"
SCHEMA_VERSION = "1.0"

# Privacy class -> action of the strict external profile.
PRIVACY_PROFILE = "STRICT_EXTERNAL"
PRIVACY_ACTIONS = {
    "SECRET": "REDACT",
    "DIRECT_IDENTIFIER": "TOKENIZE",
    "INTERNAL_ASSET_IDENTIFIER": "TOKENIZE",
    "QUASI_IDENTIFIER": "GENERALIZE",
    "PUBLIC_SECURITY_INDICATOR": "ALLOW",
    "SECURITY_SEMANTIC": "ALLOW",
    "SECURITY_CONTEXT": "ALLOW",
    "SAFE_METADATA": "ALLOW",
    "UNCLASSIFIED_FREE_TEXT": "LOCAL_ONLY",
}
PRIVACY_DEFAULT_ACTION = "REDACT"

# Pipeline stages in order.
STAGES = [
    "RECEIVING_TELEMETRY",
    "NORMALIZING_EVIDENCE",
    "CORRELATION",
    "PRIVACY_PREPARATION",
    "INVESTIGATION",
    "COMPLETE",
]


@dataclass(frozen=True)
class AggregationRule:
    """Which columns make two alerts 'the same detection', and the closing gap."""

    rule_id: str
    rule_version: str
    fields: tuple[str, ...]
    window_minutes: int = 60

    @property
    def gap_us(self) -> int:
        return self.window_minutes * 60_000_000


# The rule table.
RULES = {
    "xdr": AggregationRule(
        "agg-xdr-v1", "v1", ("tenant_id", "alert_type", "host", "user", "process_name", "file_hash")
    ),
    "iam": AggregationRule("agg-iam-v1", "v1", ("tenant_id", "alert_type", "user", "src_ip")),
    "fw": AggregationRule("agg-fw-v1", "v1", ("tenant_id", "alert_type", "src_ip", "dst_ip", "domain")),
    "default": AggregationRule(
        "agg-default-v1",
        "v1",
        ("tenant_id", "alert_type", "user", "host", "src_ip", "domain", "process_name", "file_hash"),
    ),
}


def rules_with_gap(minutes: int) -> dict[str, AggregationRule]:
    """The standard rules with another closing gap."""
    return {
        name: AggregationRule(r.rule_id, r.rule_version, r.fields, minutes) for name, r in RULES.items()
    }


@dataclass(frozen=True)
class CorrelationPolicy:
    """Scores and limits of the pair correlation. Defaults are fixed values."""

    rule_version: str = "corr-v2"
    window_seconds: int = 7200
    edge_threshold: int = 50
    candidate_limit: int | None = None
    weights: dict[str, int] = field(
        default_factory=lambda: {"HASH": 50, "DEVICE": 40, "USER": 25, "IP": 15}
    )
    near_seconds: int = 300
    near_score: int = 15
    far_seconds: int = 3600
    far_score: int = 5
    primary_types: tuple[str, ...] = ("DEVICE", "HASH", "USER")
    generic_users: tuple[str, ...] = (
        "SYSTEM",
        "LOCAL SYSTEM",
        "NETWORK SERVICE",
        "LOCAL SERVICE",
        "AUTHORITY\\SYSTEM",
    )
    casefold_generic_users: bool = False

    @property
    def window_us(self) -> int:
        return self.window_seconds * 1_000_000


# Reason labels, in reporting order.
REASONS = {
    "HASH": "SAME_UNIQUE_HASH",
    "DEVICE": "SAME_DEVICE",
    "USER": "SAME_USER",
    "IP": "SAME_IP",
    "NEAR": "TIME_PROXIMITY_5M",
    "FAR": "TIME_PROXIMITY_60M",
}

ALERT_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("raw_event_id", T.StringType()),
        T.StructField("tenant_id", T.StringType()),
        T.StructField("source_event_id", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("ingested_at", T.TimestampType()),
        T.StructField("source_type", T.StringType()),
        T.StructField("source_vendor", T.StringType()),
        T.StructField("source_product", T.StringType()),
        T.StructField("category_name", T.StringType()),
        T.StructField("class_name", T.StringType()),
        T.StructField("alert_type", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("user", T.StringType()),
        T.StructField("host", T.StringType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("dst_ip", T.StringType()),
        T.StructField("domain", T.StringType()),
        T.StructField("process_name", T.StringType()),
        T.StructField("command_line", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("file_hash", T.StringType()),
        T.StructField("file_hash_algorithm", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("schema_version", T.StringType()),
    ]
)

ENVELOPE_SCHEMA = T.StructType(
    [
        T.StructField("tenant_id", T.StringType()),
        T.StructField("source_type", T.StringType()),
        T.StructField("source_vendor", T.StringType()),
        T.StructField("source_product", T.StringType()),
        T.StructField("payload", T.StringType()),
    ]
)

# Small per-tenant reference data: kind is GENERIC_USER, NAT_IP, VPN_IP or PROXY_IP.
TENANT_CONTEXT_SCHEMA = T.StructType(
    [
        T.StructField("tenant_id", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("value", T.StringType()),
    ]
)
SHARED_IP_KINDS = ["NAT_IP", "VPN_IP", "PROXY_IP"]

# State an earlier run left behind, read back by the next one.
INCIDENT_STATE_SCHEMA = T.StructType(
    [
        T.StructField("tenant_id", T.StringType()),
        T.StructField("incident_key", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("incident_type", T.StringType()),
        T.StructField("first_us", T.LongType()),
        T.StructField("last_us", T.LongType()),
        T.StructField("severity", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("anchors", T.ArrayType(T.StringType())),
        T.StructField("rule_version", T.StringType()),
        T.StructField("version", T.LongType()),
    ]
)
MEMBER_STATE_SCHEMA = T.StructType(
    [
        T.StructField("tenant_id", T.StringType()),
        T.StructField("incident_key", T.StringType()),
        T.StructField("signal_id", T.StringType()),
    ]
)
