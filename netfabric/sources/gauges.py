"""Health gauges and alarms from device snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netfabric import schemas
from netfabric.functions.ids import DEFAULT_TENANT, text
from netfabric.sources.snapshots import complete, lines_of, unwrap, xml_entries

# Labels of the health outputs.
MEMORY_LABEL, IDLE_LABEL, TEMPERATURE_CLASS = "memory utilization", "idle", "temp"
TOP_MEMORY_LABEL = "mib mem"
ALARM_BANNERS = ("alarms currently active", "no alarms")
ALARM_COMMANDS = ("show system alarms", "show chassis alarms")


def percent(value: Column) -> Column:
    """Clamped to 0..100; a missing value stays missing (``least`` alone would make it 0)."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(0.0)), F.lit(100.0)))


def _gauge(metric_class: str, name: str, value: Column, unit: str, raw: Column, sensor: Column | None = None) -> Column:
    return F.struct(
        F.lit(metric_class).alias("metric_class"), (F.lit("") if sensor is None else sensor).alias("sensor"), F.lit(name).alias("metric_name"),
        value.cast("double").alias("metric_value"), F.lit(unit).alias("unit"), raw.alias("raw"),
    )


def _rows(df: DataFrame, scope: str, gauges: Column, device: Column | None = None) -> DataFrame:
    """Canonical gauge rows from an array of gauge structs; gauges without a value are dropped."""
    each = df.select(
        F.col("collected_at").alias("timestamp"), F.lit(DEFAULT_TENANT).alias("tenant_id"), "provider",
        (F.col("device") if device is None else device).alias("device"), F.lit(scope).alias("scope"), F.explode(gauges).alias("g"),
    ).select("timestamp", "tenant_id", "provider", "device", "scope", "g.*").filter(F.col("metric_value").isNotNull())
    return each.select(*[f.name for f in schemas.GAUGES.fields])


def _first_line(body: Column, wanted) -> Column:
    """The first line, trimmed, that meets a condition."""
    lines = F.transform(F.split(body, "\n"), lambda line: F.trim(line, F.lit(" \t\r")))
    return F.get(F.filter(lines, wanted), F.lit(0))


def _words(line: Column) -> Column:
    return F.split(F.trim(line, F.lit(" \t\r")), r"\s+")


def _labelled_percent(body: Column, label: str) -> tuple[Column, Column]:
    """``(value, line)`` of ``<label> <number> percent``."""
    n = len(label.split())
    line = _first_line(body, lambda line: F.lower(line).startswith(label) & (F.lower(F.get(_words(line), F.lit(n + 1))) == "percent"))
    return F.get(_words(line), F.lit(n)).try_cast("double"), line


def routing_engine(snapshots: DataFrame) -> DataFrame:
    memory, memory_line = _labelled_percent(F.col("body"), MEMORY_LABEL)
    idle, idle_line = _labelled_percent(F.col("body"), IDLE_LABEL)
    return _rows(snapshots, "device", F.array(
        _gauge("memory", "mem_util_pct", memory, "percent", memory_line), _gauge("cpu", "cpu_util_pct", percent(100.0 - idle), "percent", idle_line),
    ))


def chassis_environment(snapshots: DataFrame) -> DataFrame:
    """Rows ``Temp <sensor> <status> <n> degrees C / ...``."""
    words = _words(F.col("trimmed"))
    # The cheap test comes first, so that only rows of the class are split.
    of_class = lines_of(snapshots).filter(F.lower(F.substring("trimmed", 1, len(TEMPERATURE_CLASS))) == TEMPERATURE_CLASS)
    rows = of_class.withColumns({"words": words, "at": F.array_position(F.transform(words, F.lower), "degrees").cast("int")})
    value = F.get("words", F.col("at") - 2).try_cast("double")
    shaped = (F.lower(F.get("words", F.lit(0))) == TEMPERATURE_CLASS) & (F.col("at") >= 5) & (F.lower(F.get("words", F.col("at"))) == "c")
    sensor = F.array_join(F.slice("words", F.lit(2), F.greatest(F.lit(0), F.col("at") - 4)), " ")
    return _rows(rows.filter(shaped & value.isNotNull()), "device", F.array(
        _gauge("temperature", "temp_celsius", value, "celsius", F.col("trimmed"), sensor)
    ))


def system_resources(snapshots: DataFrame) -> DataFrame:
    """The idle share and the memory line of ``top``: values before their labels, between commas."""
    body = unwrap(F.col("body"))
    items = F.transform(F.split(body, "[,:\n]"), lambda item: F.trim(item, F.lit(" \t\r")))
    number = lambda item, label: F.trim(F.replace(F.lower(item), F.lit(label), F.lit(""))).try_cast("double")
    idle = F.get(F.filter(items, lambda item: F.lower(item).endswith("id") & number(item, "id").isNotNull()), F.lit(0))
    memory = _first_line(body, lambda line: F.lower(line).contains(TOP_MEMORY_LABEL))
    parts = F.split(F.split_part(memory, F.lit(":"), F.lit(2)), ",")
    part = lambda label: number(F.get(F.filter(parts, lambda p: F.lower(p).contains(label)), F.lit(0)), label)
    total, used = part("total"), part("used")
    return _rows(snapshots, "device", F.array(
        _gauge("cpu", "cpu_util_pct", percent(100.0 - number(idle, "id")), "percent", idle),
        _gauge("memory", "mem_util_pct", F.when(total > 0, percent(used / total * 100.0)), "percent", memory),
    ))


def environmentals(snapshots: DataFrame) -> DataFrame:
    rows = xml_entries(snapshots, "DegreesC string, description string")
    deg = F.trim(text("e.DegreesC"))
    return _rows(rows, "device", F.array(
        _gauge("temperature", "temp_celsius", deg.try_cast("double"), "celsius", deg, F.trim(text("e.description")))
    ))


def _stanzas(snapshots: DataFrame) -> DataFrame:
    rows = snapshots.select("*", F.explode(F.split("body", r"\n\s*\n")).alias("block")).withColumn("block", F.trim(F.regexp_replace("block", r"^\s+|\s+\z", "")))
    header = F.trim(F.split_part("block", F.lit("\n"), F.lit(1)))
    untagged = F.when(header.startswith("["), F.ltrim(F.get(F.split(header, "]", 2), F.lit(1)))).otherwise(header)
    bare = F.when(untagged.startswith("Node:"), F.substring(untagged, 6, 1_000_000)).otherwise(untagged)
    name = F.when(bare.endswith(")"), F.split_part(bare, F.lit("(ID:"), F.lit(1))).otherwise(bare)
    return rows.withColumns({"name": F.trim(name), "status": F.upper(F.regexp_extract("block", r"Status:\s*(\S+)", 1))}).filter(F.col("name") != "")


def _usage(with_cpu: bool) -> Column:
    block = F.col("block")
    cpu_line = _first_line(block, lambda line: F.regexp_replace(line, "^-\\s*", "").startswith("CPU:"))
    mem_line = _first_line(block, lambda line: line.contains("Memory:") & line.contains("%)"))
    cpu = F.trim(F.split_part(F.split_part(cpu_line, F.lit("CPU:"), F.lit(2)), F.lit("%"), F.lit(1)))
    mem = F.trim(F.split_part(F.substring_index(F.split_part(mem_line, F.lit("Memory:"), F.lit(2)), "%)", 1), F.lit("("), F.lit(2)))
    gauges = [_gauge("memory", "mem_util_pct", percent(mem.try_cast("double")), "percent", F.concat(F.lit("mem="), mem.try_cast("double").cast("string"), F.lit("%")))]
    if with_cpu:
        gauges.insert(0, _gauge("cpu", "cpu_util_pct", percent(cpu.try_cast("double")), "percent", F.concat(F.lit("cpu="), cpu.try_cast("double").cast("string"), F.lit("%"))))
    return F.array(*gauges)


def hypervisor_nodes(snapshots: DataFrame) -> DataFrame:
    return _rows(_stanzas(snapshots).filter(F.col("status") == "ONLINE"), "node", _usage(False), F.col("name"))


def hypervisor_guests(snapshots: DataFrame) -> DataFrame:
    return _rows(_stanzas(snapshots).filter(F.col("status") == "RUNNING"), "guest", _usage(True), F.col("name"))


_DEVICE_JSON = "struct<name:string,`system-stats`:struct<cpu:string,mem:string>,temperatures:array<struct<name:string,value:string>>>"


def controller_devices(snapshots: DataFrame) -> DataFrame:
    """One device document per snapshot, possibly inside an envelope."""
    body = F.col("body")
    inner = [F.get_json_object(body, f"$.{key}") for key in ("result", "data", "device", "item")]
    doc = F.from_json(F.coalesce(*[F.when(F.ltrim(i).startswith("{"), i) for i in inner], body), _DEVICE_JSON)
    rows = snapshots.withColumn("d", doc)
    stats = F.col("d.`system-stats`")
    cpu, mem = stats["cpu"], stats["mem"]
    temps = F.transform(
        F.coalesce("d.temperatures", F.array().cast("array<struct<name:string,value:string>>")),
        lambda t: _gauge("temperature", "temp_celsius", t["value"].try_cast("double"), "celsius", F.to_json(t), text(t["name"])),
    )
    gauges = F.concat(F.array(
        _gauge("cpu", "cpu_util_pct", percent(cpu.try_cast("double")), "percent", cpu), _gauge("memory", "mem_util_pct", percent(mem.try_cast("double")), "percent", mem),
    ), temps)
    return _rows(rows, "device", gauges, F.coalesce(F.nullif(F.col("d.name"), F.lit("")), F.col("device")))


def alarms(snapshots: DataFrame) -> DataFrame:
    """Alarms once each across the commands that repeat them, and a count per device.

    The count, a real zero included, exists only when some command answered
    with alarm output: silence is not the absence of alarms.
    """
    keys = ["provider", "device", "collected_at"]
    answered = snapshots.filter(reduce(lambda a, b: a | b, [F.lower("body").contains(banner) for banner in ALARM_BANNERS]))
    rows = lines_of(answered).withColumn("words", _words(F.col("line")))
    # Date, time, a zone in capitals where the device prints one, severity, description.
    zone = F.get("words", F.lit(2))
    skip = F.when((zone == F.upper(zone)) & zone.rlike("^[A-Z]+$"), 3).otherwise(2)
    stamp = F.concat_ws(" ", F.get("words", F.lit(0)), F.get("words", F.lit(1)))
    dated = F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd HH:mm:ss")).isNotNull()
    lines = rows.withColumn("skip", skip).filter(dated & (F.size("words") > F.col("skip") + 1) & ~F.col("line").startswith(" ")).select(
        *keys, F.lower(F.get("words", F.col("skip"))).alias("sensor"),
        F.concat(F.array_join(F.slice("words", F.lit(1), F.col("skip")), " "), F.lit(" | "), F.array_join(
            F.slice("words", F.col("skip") + 2, F.size("words")), " ")).alias("raw"),
    ).distinct()
    each = _rows(lines, "device", F.array(_gauge("alarm", "alarm", F.lit(1.0), "count", F.col("raw"), F.col("sensor"))))
    counts = answered.select(*keys).distinct().join(lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), keys, "left")
    counts = counts.withColumn("n", F.coalesce("n", F.lit(0)))
    total = _rows(counts, "device", F.array(_gauge("alarm", "active_alarm_count", F.col("n"), "count", F.concat(F.col("n").cast("string"), F.lit(" active")))))
    return total.unionByName(each)


GAUGE_PARSERS = {
    ("juniper", "show chassis routing-engine"): routing_engine, ("juniper", "show chassis environment"): chassis_environment,
    ("paloalto", "show system resources"): system_resources, ("paloalto", "show system environmentals"): environmentals,
    ("proxmox", "list nodes"): hypervisor_nodes, ("proxmox", "list vms"): hypervisor_guests, ("proxmox", "list containers"): hypervisor_guests,
    ("unifi", "device"): controller_devices,
}


def gauges_from_snapshots(snapshots: DataFrame) -> DataFrame:
    """Every gauge and alarm in a snapshot table."""
    ok = complete(snapshots)
    parts = [parse(ok.filter((F.col("provider") == p) & (F.col("command") == c))) for (p, c), parse in GAUGE_PARSERS.items()]
    parts.append(alarms(ok.filter((F.col("provider") == "juniper") & F.col("command").isin(*ALARM_COMMANDS))))
    return reduce(DataFrame.unionByName, parts)
