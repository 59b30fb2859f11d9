"""Attack scenarios as vendor events, and the adapter that turns them into envelopes."""

import json

DAY = "2025-03-04T"


def event(source, event_id, at, received=None, tenant="tenant-1", **payload):
    return {
        "tenant": tenant, "source": source, "id": event_id, "received": DAY + (received or at) + ":00Z",
        "payload": {"timestamp": DAY + at + ":00Z", **payload},
    }


def repeated(n, make):
    return [make(k) for k in range(n)]


SCENARIOS = {
    # A log-in, a script, a connection and a theft of passwords, each too far from the next one to link.
    "A": [
        event("iam", "login/17", "07:02", event="login_from_new_place", user="mira", src_ip="10.20.0.8", severity="medium"),
        event("xdr", "proc/51", "07:06", event="script_from_mail", user="mira", host="LEDGER-3", process="wscript.exe", severity="high"),
        event("fw", "flow/4", "07:13", event="rare_destination", src_ip="10.20.0.8", dst_ip="192.0.2.77", domain="drop.example", severity="high"),
        event("xdr", "proc/68", "07:21", event="credential_dumping", user="SYSTEM", host="LEDGER-3", process="dump64.exe", severity="critical"),
    ],
    # One alert delivered twice.
    "B": [
        event("xdr", "file/9", "09:40", got, event="malware_detected", user="noor", host="KIOSK-7", file_hash="5e0c" * 16, severity="high")
        for got in ("09:40", "09:52")
    ],
    # A burst.
    "C": repeated(10, lambda k: event("xdr", f"proc/{200 + k}", f"11:{2 * k:02d}", event="credential_dumping", user="noor", host="KIOSK-7", process="dump64.exe", severity="critical")),
    # Nothing in common.
    "D": [
        event("xdr", "file/31", "12:10", event="malware_detected", user="oleg", host="DESK-20", severity="medium"),
        event("xdr", "proc/32", "12:12", event="script_from_mail", user="pia", host="DESK-21", severity="medium"),
    ],
    # Harmless.
    "E": [event("xdr", "proc/77", "13:30", event="process_execution", user="admin", host="TAPE-1", process="nightly.cmd", severity="low")],
    # The same in two tenants.
    "F": repeated(2, lambda k: event("xdr", f"file/{90 + k}", "14:25", tenant=f"tenant-{k + 1}", event="malware_detected", user="quin", host="CART-5", src_ip="10.20.9.9", severity="high")),
    # One address, two users.
    "G": [event("iam", f"login/{40 + k}", f"15:{3 * k:02d}", event="failed_login", user=user, src_ip="198.51.100.61", severity="medium") for k, user in enumerate(("rosa", "sami"))],
    # Two that link, one of them and a third reported late.
    "H": [
        event("xdr", "proc/81", "16:30", event="script_from_mail", user="tove", host="SHOP-2", severity="high"),
        event("xdr", "proc/84", "16:34", "16:47", event="credential_dumping", user="SYSTEM", host="SHOP-2", severity="critical"),
        event("fw", "flow/19", "16:31", "20:05", event="rare_destination", src_ip="10.20.0.31", dst_ip="192.0.2.78", domain="drop.example", severity="high"),
    ],
}

RENAMES = {
    "xdr": {"timestamp": "detected_at", "process": "process_name", "user": "username", "host": "hostname",
            "event": "detection_name", "file_hash": "sha256"},
    "iam": {"timestamp": "time", "user": "actor_email", "src_ip": "source_ip"},
    "fw": {"src_ip": "src", "dst_ip": "dst", "domain": "dns_query"},
}
ID_FIELD = {"xdr": "event_id", "iam": "log_id", "fw": "fw_rule_id"}


def envelope(e, tenant=None):
    kind = e["source"]
    payload = dict(e["payload"])
    payload |= {new: payload[old] for old, new in RENAMES[kind].items() if old in payload}
    payload[ID_FIELD[kind]] = e["id"]
    if kind == "fw":
        payload["action"] = "ALLOW" if payload["severity"] == "info" else "DENY"
    return (tenant or e["tenant"], kind, "Vendor", "Product", json.dumps(payload), e["received"], f"{e['id']}/{e['received']}")


COLUMNS = "tenant_id string, source_type string, source_vendor string, source_product string, payload string, received_at string, raw_event_id string"


def demo_chain():
    """A small incident as three vendors tell it: 22 rows, 4 of them with seconds that do not exist."""
    start, user, inner, outer = "2025-03-05T08", "uma_ops", "172.20.4.4", "203.0.113.200"
    rows = [("IAM", {"time": f"{start}:00:30Z", "log_id": "entry", "actor_email": user, "source_ip": outer, "action": "login"})]

    def seen(kind, field, at, **more):
        rows.append((kind, {field: f"{start}:{at}Z", **more}))

    def host_alert(at, event_id, severity, name):
        seen("XDR", "detected_at", at, event_id=event_id, username=user, src_ip=inner, severity=severity, detection_name=name, cmdline="tool.exe /q")

    for k, second in enumerate((3, 11, 19, 27, 42, 61, 75, 99)):  # three of them impossible
        host_alert(f"20:{second:02d}", f"script {k}", "HIGH", "Odd script")
    for k in (0, 1):  # other events, not redeliveries: the id differs
        host_alert("20:03", f"script {k} again", "HIGH", "Odd script")
    for k, second in enumerate((5, 20, 35, 50, 60)):  # one impossible
        host_alert(f"24:{second:02d}", f"secrets {k}", "CRITICAL", "Secrets read")
    for k in range(6):
        seen("FIREWALL", "timestamp", f"27:{9 * k:02d}", fw_rule_id=f"flow {k}", src=inner, dst=outer, action="ALLOW")
    return [("tenant-demo", kind, "V", "P", json.dumps(p), f"2025-03-05T09:30:{n:02d}Z", f"row {n}") for n, (kind, p) in enumerate(rows)]
