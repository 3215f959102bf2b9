"""Hypervisor logins and task records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netfabric.functions.net import ipv4_or_null
from netfabric.sources.logins import sshd_login, word_after
from netfabric.sources.redact import hash_user, scrub_user
from netfabric.sources.syslog import event_rows, ext_map, found, keep_if, parse_syslog_header

# Programs and message marks that are kept.
APPS = ("pvedaemon", "pveproxy", "pct", "qm", "pvesh")
CONTAINS = ("successful auth for user", "authentication failure; rhost=", "starting task UPID:", "end task UPID:")
STARTS = ("Accepted ", "Failed password for ")
TASK_MARK = " task UPID:"
# A task id is UPID:node:pid:start:time:type:id:user: and may be followed by more.
TASK_TYPE, TASK_GUEST, TASK_USER, TASK_FIELDS = 5, 6, 7, 8
WEB_OK_MARK = "successful auth for user "


def proxmox_gate() -> Column:
    """Login and task lines of the known programs; the rest is noise."""
    app, body = F.lower(F.coalesce("appname", F.lit(""))), F.coalesce("body", F.lit(""))
    known = app.isin(*APPS) | app.startswith("sshd")
    wanted = F.lit(False)
    for mark in CONTAINS:
        wanted = wanted | body.contains(mark)
    for mark in STARTS:
        wanted = wanted | body.startswith(mark)
    return F.col("parsed") & known & wanted


def normalise_proxmox(raw: DataFrame, hash_key: bytes) -> DataFrame:
    """Kept lines to events; the user of a failed login is hashed and scrubbed from the line."""
    df = parse_syslog_header(raw)
    df = keep_if(df, proxmox_gate()).withColumns({
        "app": F.lower("appname"), "msg": F.rtrim(F.coalesce("body", F.lit("")), F.lit(" \r\n")),
    })
    msg, sshd = F.col("msg"), F.col("app").startswith("sshd")
    accepted, failed = sshd_login(msg, "Accepted"), sshd_login(msg, "Failed", "password")
    task_id, phase = word_after(msg, TASK_MARK), F.element_at(F.split(F.split_part(msg, F.lit(TASK_MARK), F.lit(1)), " "), -1)
    rhost, web_name = word_after(msg, "authentication failure; rhost="), word_after(msg, " user=")
    df = df.withColumns({
        "ok_ssh": sshd & accepted.matched, "bad_ssh": sshd & failed.matched, "phase": phase,
        "task": ~sshd & msg.contains(TASK_MARK) & phase.isin("starting", "end") & task_id.isNotNull(),
    }).withColumns({
        "upid": F.when(F.col("task"), F.concat(F.lit("UPID:"), task_id)),
        "bad_web": ~sshd & ~F.col("task") & F.coalesce(rhost.isNotNull() & web_name.isNotNull(), F.lit(False)),
    }).withColumn("ok_web", ~sshd & ~F.col("task") & ~F.col("bad_web") & msg.contains(WEB_OK_MARK))
    ok_ssh, bad_ssh, task = F.col("ok_ssh"), F.col("bad_ssh"), F.col("task")
    bad_web, ok_web, upid = F.col("bad_web"), F.col("ok_web"), F.col("upid")

    fields = F.split(upid, ":")
    of_task = lambda at: F.when(F.size(fields) > TASK_FIELDS, F.nullif(F.get(fields, F.lit(at)), F.lit("")))
    failed_user = F.when(bad_ssh, failed.user).when(bad_web, web_name)
    web_user = F.replace(F.trim(F.split_part(msg, F.lit(WEB_OK_MARK), F.lit(2))), F.lit("'"), F.lit(""))
    user = F.coalesce(
        F.when(ok_ssh, accepted.user).when(task, of_task(TASK_USER)).when(ok_web, web_user),
        hash_user(failed_user, hash_key), F.lit(""),
    )
    peer = F.when(ok_ssh, accepted.address).when(bad_ssh, failed.address).when(bad_web, rhost)
    ended = task & (F.col("phase") == "end")
    finished_ok = ended & msg.contains(" OK")
    task_type = F.coalesce(of_task(TASK_TYPE), F.lit(""))
    action = (
        F.when(ok_ssh | ok_web, "auth_success").when(bad_ssh | bad_web, "auth_failure")
        .when(ended, F.concat(F.lit("task_end_"), task_type)).when(task, F.concat(F.lit("task_"), task_type))
    )
    outcome = F.when(ok_ssh | ok_web | finished_ok, "success").when(bad_ssh | bad_web | ended, "failure")
    categories = F.when(ok_ssh | ok_web | bad_ssh | bad_web, F.array(F.lit("authentication"))).when(
        task, F.array(F.lit("configuration"))
    ).otherwise(F.array(F.lit("host")))
    # A hashed name has no realm; the plain one does.
    realm = F.when(~bad_ssh & ~bad_web & user.contains("@"), found(user, r"@(\S+)$"))
    pairs = [
        ("proxmox.appname", F.col("app")), ("proxmox.node", F.col("hostname")),
        ("proxmox.source_addr", F.when(ipv4_or_null(peer).isNull(), peer)),
        ("proxmox.invalid_user", F.when(bad_ssh & failed.unknown_user, "true")),
        ("proxmox.upid", F.when(task, upid)), ("proxmox.task_type", F.when(task, task_type)),
        ("proxmox.vmid", F.when(task, of_task(TASK_GUEST))),
        ("proxmox.task_status", F.when(finished_ok, "OK").when(ended, F.nullif(F.substring(F.split_part(msg, upid, F.lit(2)), 2, 1 << 20), F.lit("")))), ("proxmox.realm", realm),
    ]
    return event_rows(
        df, "proxmox", "proxmox", timestamp=F.coalesce("header_ts", "received_at"), event_category=categories,
        event_action=action, event_outcome=outcome, source_ip=ipv4_or_null(peer),
        source_port=F.when(ok_ssh, accepted.port).when(bad_ssh, failed.port),
        user_name=user, ext=ext_map(*pairs), raw=scrub_user(F.col("message"), failed_user),
    )
