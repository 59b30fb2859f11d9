"""Vendor payloads to the one alert schema, with a safe error text instead of a bad row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertweave import model
from alertweave.functions import columns as C

# Offset-aware ISO-8601 text, and the text of a number.
AWARE_TIME = (
    r"^(\d{4}-\d{2}-\d{2})[Tt _](\d{2}:\d{2})(:\d{2})?(?:[.,](\d{1,6})\d*)?\s*(Z|z|[+-]\d{2}:?\d{2})$"
)
NAIVE_TIME = r"^\d{4}-\d{2}-\d{2}([Tt _]\d{2}:\d{2}(:\d{2}([.,]\d+)?)?)?$"
NUMBER_TEXT = r"^[+-]?\d+(\.\d+)?$"
MILLISECOND_WATERSHED = 2e10

NOT_A_STRING = "Input should be a valid string"
NOT_A_TIME = "Input should be a valid datetime"
UNPARSABLE_TIME = "Input should be a valid datetime or date"
NO_OFFSET = "Input should have timezone info"

_OBSERVABLES = ["user", "host", "src_ip", "dst_ip", "domain", "process_name", "command_line", "file_path",
                "file_hash", "message"]


class Payload:
    """Accessors for one parsed JSON payload column."""

    def __init__(self, variant: Column):
        self.variant = variant

    def raw(self, name: str) -> Column:
        return F.try_variant_get(self.variant, f"$['{name}']", "variant")

    def has(self, name: str) -> Column:
        """The key is there, be it with a null value."""
        return self.raw(name).isNotNull()

    def text(self, name: str) -> Column:
        return F.try_variant_get(self.variant, f"$['{name}']", "string")

    def text_or(self, name: str, default: str) -> Column:
        """The default stands in for an absent key only; an explicit null stays null."""
        return F.when(self.has(name), self.text(name)).otherwise(F.lit(default))

    def kind(self, name: str) -> Column:
        return F.when(self.has(name), F.schema_of_variant(self.raw(name)))

    def is_text(self, name: str) -> Column:
        return F.coalesce(self.kind(name) == "STRING", F.lit(False))

    def not_text(self, name: str) -> Column:
        """A value that is neither null nor a string."""
        return F.coalesce(~self.kind(name).isin("STRING", "VOID"), F.lit(False))

    def truthy_not_text(self, name: str) -> Column:
        return self.not_text(name) & ~F.coalesce(self.text(name).isin("0", "0.0", "false", "{}", "[]"), F.lit(False))


def parse_time(text: Column) -> Column:
    """Offset-aware ISO-8601 text or a Unix time to a timestamp; null for anything else."""
    part = [F.regexp_extract(text, AWARE_TIME, i) for i in range(6)]
    seconds = F.when(part[3] == "", ":00").otherwise(part[3])
    fraction = F.when(part[4] == "", "").otherwise(F.concat(F.lit("."), part[4]))
    offset = F.when(F.lower(part[5]) == "z", "+00:00").otherwise(
        F.concat(F.substring(part[5], 1, 3), F.lit(":"), F.substring(part[5], -2, 2))
    )
    iso = F.try_to_timestamp(F.concat(part[1], F.lit(" "), part[2], seconds, fraction, offset))
    number = text.try_cast("double")
    epoch = F.when(F.abs(number) > MILLISECOND_WATERSHED, number / 1000).otherwise(number)
    return F.when(text.rlike(AWARE_TIME), iso).when(
        text.rlike(NUMBER_TEXT), F.timestamp_micros((epoch * 1_000_000).cast("long"))
    )


def time_problem(text: Column, parsed: Column) -> Column:
    """Why a time is refused, or null; `parsed` is what parse_time made of it."""
    return (
        F.when(text.isNull(), NOT_A_TIME)
        .when(parsed.isNotNull(), F.lit(None))
        .when(text.rlike(NAIVE_TIME) & F.try_to_timestamp(F.regexp_replace(text, "[Tt_]", " ")).isNotNull(),
              NO_OFFSET)
        .otherwise(UNPARSABLE_TIME)
    )


def _worked_out(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns through a one-row generator.

    The optimiser copies a projected expression into every later use of it; a generator it
    leaves alone, so these are worked out once per row and the plan stays small.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _literal(value: str | None) -> Column:
    return F.lit(value).cast("string")


def xdr_fields(p: Payload) -> dict[str, Column]:
    severity = F.upper(F.coalesce(p.text("severity"), F.lit("")))
    digest = C.none_if_empty(p.text("sha256"))
    return {
        "source_event_id": p.text("event_id"),
        "time_text": p.text("detected_at"),
        "source_type": _literal("XDR"),
        "category_name": _literal("ENDPOINT_ACTIVITY"),
        "class_name": _literal("PROCESS_ACTIVITY"),
        "alert_type": p.text_or("detection_name", "Unknown XDR Event"),
        "severity": F.when(severity.isin("HIGH", "CRITICAL"), severity).otherwise("INFO"),
        "user": C.clean_lower(p.text("username")),
        "host": C.clean_lower(p.text("hostname")),
        "process_name": F.coalesce(C.none_if_empty(p.text("process_name")), p.text("process_path")),
        "command_line": p.text("cmdline"),
        "src_ip": p.text("src_ip"),
        "dst_ip": p.text("dst_ip"),
        "file_hash": digest,
        "file_hash_algorithm": F.when(digest.isNotNull(), "SHA256"),
        "message": p.text("description"),
        "fault": F.when(p.truthy_not_text("username") | p.truthy_not_text("hostname"), "field is not text"),
        "not_text": F.array_compact(
            F.array(
                F.when(~p.is_text("event_id"), "source_event_id"),
                F.when(p.has("detection_name") & ~p.is_text("detection_name"), "alert_type"),
                *[F.when(p.not_text(k), name) for name, k in
                  [("src_ip", "src_ip"), ("dst_ip", "dst_ip"), ("process_name", "process_name"),
                   ("command_line", "cmdline"), ("file_hash", "sha256"), ("message", "description")]],
            )
        ),
    }


def iam_fields(p: Payload) -> dict[str, Column]:
    action = p.text_or("action", "unknown_action")
    return {
        "source_event_id": p.text("log_id"),
        "time_text": p.text("time"),
        "source_type": _literal("IAM"),
        "category_name": _literal("AUTHENTICATION"),
        "class_name": _literal("USER_SESSION"),
        "alert_type": action,
        "severity": F.when(action == "login_failed", "MEDIUM").otherwise("INFO"),
        "user": C.clean_lower(p.text("actor_email")),
        "src_ip": C.clean_lower(p.text("source_ip")),
        "message": F.concat(
            F.lit("Authentication event: "), F.coalesce(action, F.lit("None")), F.lit(" via "),
            F.coalesce(p.text_or("auth_method", "unknown"), F.lit("None")),
        ),
        "fault": F.when(p.truthy_not_text("actor_email") | p.truthy_not_text("source_ip"), "field is not text"),
        "not_text": F.array_compact(
            F.array(
                F.when(~p.is_text("log_id"), "source_event_id"),
                F.when(p.has("action") & ~p.is_text("action"), "alert_type"),
            )
        ),
    }


def firewall_fields(p: Payload) -> dict[str, Column]:
    action = F.coalesce(p.text_or("action", ""), F.lit("None"))
    src, dst = C.clean_lower(p.text("src")), C.clean_lower(p.text("dst"))
    return {
        "source_event_id": p.text("fw_rule_id"),
        "time_text": p.text("timestamp"),
        "source_type": _literal("FIREWALL"),
        "category_name": _literal("NETWORK_ACTIVITY"),
        "class_name": _literal("NETWORK_FLOW"),
        "alert_type": F.concat(F.lit("Network Connection "), action),
        "severity": F.when(action == "DENY", "LOW").otherwise("INFO"),
        "src_ip": src,
        "dst_ip": dst,
        "domain": C.clean_lower(p.text("dns_query")),
        "message": F.concat(
            F.lit("Traffic "), action, F.lit(" from "), F.coalesce(src, F.lit("None")), F.lit(" to "),
            F.coalesce(dst, F.lit("None")),
        ),
        "fault": F.when(
            p.truthy_not_text("src") | p.truthy_not_text("dst") | p.truthy_not_text("dns_query"),
            "field is not text",
        ),
        "not_text": F.array_compact(F.array(F.when(~p.is_text("fw_rule_id"), "source_event_id"))),
    }


def canonical_fields(p: Payload) -> dict[str, Column]:
    event_id = C.none_if_empty(p.text("source_event_id"))
    coded = ["category", "class_name", "severity"]
    bad_code = F.lit(False)
    for name in coded:
        bad_code = bad_code | (p.has(name) & ~p.is_text(name))
    return {
        "source_event_id": event_id,
        "time_text": p.text("timestamp"),
        "source_type": _literal("CANONICAL"),
        "source_vendor": p.text_or("vendor", "UnknownVendor"),
        "source_product": p.text_or("product", "UnknownProduct"),
        "category_name": C.one_of(p.text("category"), model.CATEGORIES, "SYSTEM_ACTIVITY"),
        "class_name": C.one_of(p.text("class_name"), model.CLASSES, "UNKNOWN"),
        "alert_type": p.text_or("alert_type", "Canonical Event"),
        "severity": C.one_of(p.text("severity"), model.SEVERITIES, "INFO"),
        **{name: p.text(name) for name in _OBSERVABLES},
        "file_hash_algorithm": C.one_of(p.text("file_hash_algorithm"), model.HASH_ALGORITHMS, None),
        "fault": F.when(event_id.isNull(), "source_event_id is required in canonical format").when(
            bad_code, "field is not text"
        ),
        "not_text": F.array_compact(
            F.array(
                *[F.when(p.has(k) & ~p.is_text(k), name) for name, k in
                  [("source_vendor", "vendor"), ("source_product", "product"), ("alert_type", "alert_type")]],
                *[F.when(p.not_text(k), k) for k in _OBSERVABLES],
            )
        ),
    }


Normalizer = Callable[[Payload], dict[str, Column]]
NORMALIZERS: dict[str, Normalizer] = {
    "XDR": xdr_fields,
    "IAM": iam_fields,
    "FIREWALL": firewall_fields,
    "CANONICAL": canonical_fields,
}


def route(source_type: Column) -> Column:
    """Normaliser name for a source type; null when none fits. '<vendor>_CANONICAL' is canonical too."""
    upper = F.upper(source_type)
    return (
        F.when(upper.isin("XDR", "IAM", "FIREWALL"), upper)
        .when(upper == "FW", "FIREWALL")
        .when(upper.rlike("^([A-Z0-9]+_)?CANONICAL$"), "CANONICAL")
    )


def normalize(envelopes: DataFrame, normalizers: dict[str, Normalizer] | None = None) -> DataFrame:
    """Add status, normalization_error and the struct `alert` to envelopes.

    Needs columns tenant_id, source_type, source_vendor, source_product, payload (JSON text);
    raw_event_id and received_at are used where present. One projection, no shuffle.
    """
    normalizers = normalizers or NORMALIZERS
    have = set(envelopes.columns)
    raw_id = F.col("raw_event_id") if "raw_event_id" in have else F.lit(None).cast("string")
    received = F.col("received_at") if "received_at" in have else F.lit(None).cast("timestamp")

    parsed = envelopes.withColumn("_v", F.try_parse_json("payload")).withColumn("_route", route(F.col("source_type")))
    p = Payload(F.col("_v"))
    per_source = {name: make(p) for name, make in normalizers.items()}

    def pick(field: str) -> Column:
        chosen = F.lit(None)
        for name, fields in per_source.items():
            if field in fields:
                chosen = F.when(F.col("_route") == name, fields[field]).otherwise(chosen)
        return chosen

    names = ["source_event_id", "time_text", "source_type", "category_name", "class_name", "alert_type",
             "severity", *_OBSERVABLES, "file_hash_algorithm", "fault"]
    canonical = F.col("_route") == "CANONICAL"
    mapped = _worked_out(
        parsed,
        **{f"_m_{n}": pick(n).cast("string") for n in names},
        _m_not_text=pick("not_text").cast("array<string>"),
        **{f"_m_{n}": F.when(canonical, pick(n).cast("string")).otherwise(F.col(n)) for n in ("source_vendor", "source_product")},
    )
    time_text = F.col("_m_time_text")
    timed = _worked_out(mapped, _time=parse_time(time_text))
    problem = time_problem(time_text, F.col("_time"))

    def complaint(field: Column, reason: Column) -> Column:
        return F.concat(F.lit("field='"), field, F.lit("' reason='"), reason, F.lit("'"))

    def wrong_kind(first: bool) -> Column:
        wanted = F.filter("_m_not_text", lambda n: (n == "source_event_id") == F.lit(first))
        return F.transform(wanted, lambda n: complaint(n, F.lit(NOT_A_STRING)))

    complaints = F.array_join(
        F.concat(wrong_kind(True), F.array_compact(F.array(complaint(F.lit("timestamp"), problem))), wrong_kind(False)), " | "
    )

    def unclassified(reason: Column) -> Column:
        return F.concat(
            F.lit("error_code=UNKNOWN_NORMALIZATION_FAILURE reason='Unclassified error during normalization: "),
            reason, F.lit("'"),
        )

    judged = _worked_out(timed, _complaints=C.none_if_empty(complaints))
    error = (
        F.when(F.col("_v").isNull(), unclassified(F.lit("payload is not JSON")))
        .when(~F.ltrim("payload").startswith("{") & ~F.col("payload").rlike(r"^\s*\{"),
              unclassified(F.lit("payload is not an object")))
        .when(F.col("_route").isNull(),
              unclassified(F.concat(F.lit("No normalizer found for source_type: "),
                                    F.coalesce(F.col("source_type"), F.lit("None")))))
        .when(F.col("_m_fault").isNotNull(), unclassified(F.col("_m_fault")))
        .otherwise(F.col("_complaints"))
    )
    done = _worked_out(judged, normalization_error=error)
    fields = {n: F.col(f"_m_{n}") for n in [*names, "source_vendor", "source_product"]} | {
        "id": C.uuid_of(C.joined(F.lit("alert"), raw_id)),
        "raw_event_id": raw_id,
        "tenant_id": F.col("tenant_id"),
        "timestamp": F.col("_time"),
        "ingested_at": received,
        "schema_version": F.lit(model.SCHEMA_VERSION),
    }
    alert = F.struct(*[fields[f.name].cast(f.dataType).alias(f.name) for f in model.ALERT_SCHEMA])
    passed = F.col("normalization_error").isNull()
    return done.select(
        *envelopes.columns, "normalization_error",
        F.when(passed, "NORMALIZED").otherwise("NORMALIZATION_FAILED").alias("processing_status"),
        F.when(passed, alert).alias("alert"),
    )


def alerts_of(normalized: DataFrame) -> DataFrame:
    """The rows that passed, flat, in the alert schema."""
    return normalized.where("processing_status = 'NORMALIZED'").select("alert.*")


def quarantine_of(normalized: DataFrame) -> DataFrame:
    """The rows that failed: raw evidence and the safe error text."""
    keep = [c for c in normalized.columns if c != "alert"]
    return normalized.where("processing_status <> 'NORMALIZED'").select(*keep)
