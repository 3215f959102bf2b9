"""System audit lines: logins, commits and configuration changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netfabric.functions.net import ipv4_or_null
from netfabric.sources import redact
from netfabric.sources.logins import sshd_login
from netfabric.sources.syslog import (
    escaped_param, event_rows, ext_map, keep_if, known_device, param, parse_syslog_header, structured_data_map,
)

# Message ids with their category, action and outcome.
AUDIT_EVENTS = {
    "SSHD_LOGIN_FAILED": ("authentication", "auth_failure", "failure"),
    "SSHD_LOGIN_ATTEMPTS_THRESHOLD": ("authentication", "auth_attempts_threshold", "failure"),
    "UI_LOGIN_EVENT": ("authentication", "auth_login", "success"),
    "UI_LOGOUT_EVENT": ("authentication", "auth_logout", "success"),
    "UI_AUTH_EVENT": ("authentication", "auth_event", "success"),
    "UI_COMMIT": ("configuration", "configuration_commit", "success"),
    "UI_COMMIT_COMPLETED": ("configuration", "configuration_commit_completed", "success"),
    "UI_COMMIT_NOT_CONFIRMED": ("configuration", "configuration_commit_rollback", "failure"),
    "UI_ROLLBACK_EVENT": ("configuration", "configuration_rollback", "success"),
    "UI_CFG_AUDIT_SET": ("configuration", "configuration_change", "success"),
    "UI_CFG_AUDIT_SET_SECRET": ("configuration", "configuration_change", "success"),
    "UI_CFG_AUDIT_OTHER": ("configuration", "configuration_change", "success"),
}
# Kept as well, without a meaning of their own.
OTHER_KEPT = ("LOGIN_FAILED", "LOGIN_INFORMATION")
HASHED_USER = ("SSHD_LOGIN_FAILED", "SSHD_LOGIN_ATTEMPTS_THRESHOLD")
PLAIN_USER = (
    "UI_LOGIN_EVENT", "UI_LOGOUT_EVENT", "UI_AUTH_EVENT", "UI_COMMIT", "UI_ROLLBACK_EVENT", "UI_CFG_AUDIT_SET",
    "UI_CFG_AUDIT_SET_SECRET", "UI_CFG_AUDIT_OTHER",
)
CHANGES = ("UI_CFG_AUDIT_SET", "UI_CFG_AUDIT_SET_SECRET", "UI_CFG_AUDIT_OTHER")


def audit_gate() -> Column:
    """Login and configuration records; progress chatter and reads are dropped."""
    accepted = F.lower(F.coalesce("appname", F.lit(""))).startswith("sshd") & F.coalesce(F.col("body").startswith("Accepted "), F.lit(False))
    return F.col("parsed") & (F.coalesce(F.col("msgid").isin(*AUDIT_EVENTS, *OTHER_KEPT), F.lit(False)) | accepted)


def normalise_junos_audit(raw: DataFrame, hash_key: bytes, devices: tuple[str, ...] | None = None) -> DataFrame:
    """Audit lines to events, with secrets and failed users taken out of every field and of the line."""
    df = parse_syslog_header(raw)
    line = F.col("message")
    df = keep_if(df, audit_gate()).withColumns({
        "app": F.lower(F.coalesce("appname", F.lit(""))), "id": F.coalesce("msgid", F.lit("")),
        "f": structured_data_map(F.coalesce("structured_data", "message")),
    })
    f = F.col("f")
    change_id = F.col("id").isin(*CHANGES)
    df = df.withColumns({
        "user": param(f, "username"), "path0": F.when(change_id, param(f, "pathname")),
        "old_value": F.when(F.col("id") == "UI_CFG_AUDIT_SET", escaped_param(f, "data")),
        "new_value": F.when(F.col("id").isin("UI_CFG_AUDIT_SET", "UI_CFG_AUDIT_OTHER"), escaped_param(f, "value")),
    }).withColumn("community", F.when(F.col("path0").contains("community"), redact.community_name(F.col("path0"))))
    df = df.withColumn("path", redact.scrub_secret(F.col("path0"), F.col("community")))
    df = df.withColumns({
        "hide_old": redact.is_secret(F.col("path"), F.col("old_value")), "hide_new": redact.is_secret(F.col("path"), F.col("new_value")),
    })
    ident, body = F.col("id"), F.coalesce("body", F.lit(""))
    # The two failure ids are tested before the free-form "Accepted" line.
    ssh_ok = ~ident.isin(*HASHED_USER) & F.col("app").startswith("sshd") & body.startswith("Accepted ")
    login = sshd_login(body, "Accepted")
    matched = ssh_ok & login.matched

    category, action, outcome = F.when(matched, "authentication"), F.when(matched, "auth_success"), F.when(matched, "success")
    for msgid, (cat, act, out) in AUDIT_EVENTS.items():
        hit = ~ssh_ok & (ident == msgid)
        category, action, outcome = category.when(hit, cat), action.when(hit, act), outcome.when(hit, out)

    failed_user = F.when(ident.isin(*HASHED_USER), F.col("user"))
    user = F.when(matched, login.user).when(ident.isin(*HASHED_USER), redact.hash_user(failed_user, hash_key)).when(
        ident.isin(*PLAIN_USER), F.col("user")
    )
    path, old, new = F.col("path"), F.col("old_value"), F.col("new_value")
    clean = redact.scrub_user(line, failed_user)
    clean = redact.scrub_secret(clean, F.col("community"))
    clean = redact.scrub_secret(clean, F.when(F.col("hide_old"), old))
    clean = redact.scrub_secret(clean, F.when(F.col("hide_new"), new))
    clean = redact.redact_leftovers(clean)

    host = F.split_part(F.coalesce("hostname", F.lit("")), F.lit("."), F.lit(1))
    commit = ident == "UI_COMMIT"
    pairs = [
        ("junos.sys.appname", F.col("app")), ("junos.sys.msgid", F.col("msgid")),
        ("junos.sys.limit", F.when(ident == "SSHD_LOGIN_ATTEMPTS_THRESHOLD", param(f, "limit"))),
        ("junos.sys.commit_message", F.when(commit, param(f, "message"))), ("junos.sys.command", F.when(commit, param(f, "command"))),
        ("junos.sys.pathname", path), ("junos.sys.data", F.when(F.col("hide_old"), redact.REDACTED).otherwise(old)),
        ("junos.sys.value", F.when(F.col("hide_new"), redact.REDACTED).otherwise(new)),
        ("junos.sys.action", F.when(ident.isin("UI_CFG_AUDIT_SET", "UI_CFG_AUDIT_SET_SECRET"), param(f, "action"))),
        ("junos.sys.secret", F.when(ident == "UI_CFG_AUDIT_SET_SECRET", "true")),
    ]
    peer = F.when(matched, login.address).when(ident == "SSHD_LOGIN_FAILED", param(f, "source-address"))
    return event_rows(
        df, "junos_sys", "juniper", timestamp=F.coalesce("header_ts", "received_at"),
        event_category=F.array(F.coalesce(category, F.lit("host"))), event_action=action, event_outcome=outcome,
        source_ip=ipv4_or_null(peer), source_port=F.when(matched, login.port),
        observer_hostname=known_device(host, devices), user_name=user, ext=ext_map(*pairs), raw=clean,
    )
