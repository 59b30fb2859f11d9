"""Column expressions: text clean-up, ids, severity order, display text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from alertweave import model


def strip(c: Column) -> Column:
    """Remove surrounding white space of any kind (SQL trim removes blanks only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def none_if_empty(c: Column) -> Column:
    return F.when(c != "", c)


def clean_lower(c: Column) -> Column:
    """Stripped and lower-cased; empty input counts as missing."""
    return F.when(c != "", F.lower(strip(c)))


def one_of(c: Column, allowed: Sequence[str], default: str | None) -> Column:
    """Upper-cased value when it is in the list, else the default."""
    return F.when(F.upper(c).isin(*allowed), F.upper(c)).otherwise(F.lit(default))


def to_us(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def from_us(c: Column) -> Column:
    return F.timestamp_micros(c)


def uuid_of(text: Column) -> Column:
    """The first 16 bytes of the SHA-256 of a text, written as a UUID."""
    h = F.sha2(text, 256)
    cut = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(h, start, size) for start, size in cut])


def joined(*cols: Column) -> Column:
    """Colon-joined text in which a missing part stays as an empty part."""
    return F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])


def severity_rank(c: Column) -> Column:
    """INFO=1 ... CRITICAL=5, anything else 0."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, model.SEVERITIES)), F.upper(c)), F.lit(0)).cast(
        "int"
    )


def severity_name(rank: Column) -> Column:
    return F.when(rank > 0, F.element_at(F.array(*map(F.lit, model.SEVERITIES)), F.greatest(rank, F.lit(1))))


def duration_text(first_us: Column, last_us: Column) -> Column:
    seconds = F.greatest(F.lit(0), F.floor((last_us - first_us) / 1_000_000))
    minutes = F.floor(seconds / 60)
    return (
        F.when(first_us.isNull() | last_us.isNull(), F.lit("N/A"))
        .when(seconds < 60, F.concat(F.greatest(F.lit(1), seconds).cast("string"), F.lit("s")))
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min")))
        .otherwise(
            F.concat(
                F.floor(minutes / 60).cast("string"),
                F.lit("h "),
                (minutes % 60).cast("string"),
                F.lit("m"),
            )
        )
    )


def soc_priority(severity: Column) -> Column:
    upper = F.upper(F.coalesce(severity, F.lit("")))
    return (
        F.when(upper == "CRITICAL", "URGENT").when(upper.isin("HIGH", "MEDIUM"), upper).otherwise(F.lit("LOW"))
    )


def display_reference(incident_id: Column) -> Column:
    return F.concat(F.lit("INC-"), F.upper(F.substring(incident_id, 1, 4)))


def source_label(vendor: Column, product: Column) -> Column:
    """'vendor product', or null when neither is given."""
    label = F.trim(F.concat_ws(" ", F.coalesce(vendor, F.lit("")), F.coalesce(product, F.lit(""))))
    return F.when((F.coalesce(vendor, F.lit("")) != "") | (F.coalesce(product, F.lit("")) != ""), label)


def signal_id(tenant: Column, rule_id: Column, version: Column, key: Column, anchor_id: Column) -> Column:
    return uuid_of(joined(tenant, rule_id, version, key, anchor_id))


def edge_id(tenant: Column, rule_version: str, a: Column, b: Column) -> Column:
    """Id of an undirected link: the order of the ends does not matter."""
    return uuid_of(joined(tenant, F.lit(rule_version), F.least(a, b), F.greatest(a, b)))


def incident_key(tenant: Column, rule_version: str, anchor_signal: Column) -> Column:
    return F.sha2(joined(tenant, F.lit(rule_version), anchor_signal), 256)


def fingerprint(tenant: Column, source_type: Column, vendor: Column, product: Column, event_id: Column) -> Column:
    """Exact-delivery fingerprint; alerts without a vendor event id have none."""
    return F.when(
        event_id != "",
        F.concat(
            F.lit(model.FINGERPRINT_VERSION + ":"),
            F.sha2(joined(tenant, source_type, vendor, product, event_id), 256),
        ),
    )


def payload_hash(payload: Column) -> Column:
    """SHA-256 of the payload with object keys sorted at every level; null for invalid JSON."""
    return F.sha2(F.to_json(F.try_parse_json(payload)), 256)
