"""Configured rules, hit counters and object books from device snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netfabric.functions.canonical import ascii_json_string
from netfabric.functions.ids import DEFAULT_TENANT, text
from netfabric.functions.net import OCTET
from netfabric.functions.skew import lookup_join
from netfabric.sources.snapshots import lines_of, unwrap
from netfabric.sources.syslog import keep_if

# The words that lead to a rule or an object, NULL for a name; match clauses, actions and application fields.
RULES = ("security", "policies")
ZONE_RULE = ("from-zone", None, "to-zone", None, "policy", None)
GLOBAL_RULE = ("global", "policy", None)
ZONE_BOOK = ("security", "zones", "security-zone", None, "address-book")
NAMED_BOOK = ("security", "address-book", None)
PREDEFINED = ("groups", "junos-defaults", "applications")
CUSTOM = ("applications",)
ACTIONS = {"permit": "allow", "deny": "deny", "reject": "reject"}
MATCH_LISTS = {
    "source-address": "source_addresses", "destination-address": "dest_addresses", "application": "application", "from-zone": "from_zone",
    "to-zone": "to_zone", "source-identity": "source_identity", "dynamic-application": "dynamic_application", "url-category": "url_category",
    "source-end-user-profile": "source_end_user_profile",
}
MATCH_FLAGS = {"source-address-excluded": "source_address_excluded", "destination-address-excluded": "dest_address_excluded"}
UNRESOLVED = ("source_identity", "dynamic_application", "url_category", "source_end_user_profile")
# Columns of a hit-count table: index, from zone, to zone, rule, count, action.
HIT_COLUMNS, HIT_RULE, HIT_COUNT = 6, 3, 4
APPLICATION_FIELDS = ("protocol", "destination-port", "source-port", "inactivity-timeout")
NETWORK = rf"^(?:{OCTET}(?:\.{OCTET}){{3}}(?:/(?:[0-9]|[12][0-9]|3[0-2]))?|[0-9A-Fa-f]*:[0-9A-Fa-f:.]*(?:/(?:[0-9]{{1,2}}|1[01][0-9]|12[0-8]))?)\z"

SNAPSHOT = ("provider", "device", "collected_at")


def _ordered(condition: Column, value: Column) -> Column:
    """Values of the matching lines of a rule, in line order."""
    return F.transform(F.array_sort(F.collect_list(F.when(condition, F.struct("pos", value.alias("v"))))), lambda s: s["v"])


def _leads(words: Column, path: tuple[str | None, ...]) -> Column:
    """Whether a line begins with these words and goes on; NULL stands for any one word."""
    fixed = [F.get(words, F.lit(i)) == w for i, w in enumerate(path) if w is not None]
    return F.coalesce(reduce(Column.__and__, fixed, F.size(words) > len(path)), F.lit(False))


def _after(words: Column, n: int) -> Column:
    return F.slice(words, F.lit(n + 1), F.size(words))


def _is_number(word: Column) -> Column:
    return (word != "") & (F.translate(word, "0123456789", "") == "")


def rules_from_text(snapshots: DataFrame) -> DataFrame:
    """``set security policies`` lines to rules.

    Each line names its rule, so a rule's lines meet in a group; positions
    follow the first line of each rule within its snapshot.  What stands before
    the policy words (a group, a logical system) is passed over.
    """
    rows = lines_of(snapshots).filter(F.col("trimmed").contains(RULES[1])).withColumn("inactive", F.col("trimmed").startswith("inactive:"))
    rows = rows.withColumn("l", F.when(F.col("inactive"), F.split(F.trim(F.substring("trimmed", 10, 1_000_000_000)), r"\s+")).otherwise(F.col("tok")))
    neighbours = F.zip_with("l", _after(F.col("l"), 1), lambda a, b: F.concat_ws(" ", a, b))
    # Each step of the parse is kept by a filter that is not moved, so every line is taken apart once.
    rows = keep_if(rows.withColumn("_at", F.array_position(neighbours, " ".join(RULES)).cast("int")), (F.get("l", F.lit(0)) == "set") & (F.col("_at") > 0))
    rows = rows.withColumn("w", F.slice("l", F.col("_at") + len(RULES), F.size("l")))
    w = F.col("w")
    rows = rows.withColumns({"_zoned": _leads(w, ZONE_RULE), "_global": _leads(w, GLOBAL_RULE)})
    rows = keep_if(rows, F.col("_zoned") | F.col("_global"))
    zoned = F.col("_zoned")
    part = lambda z, g: F.when(zoned, F.get(w, F.lit(z))).otherwise(F.lit("") if g is None else F.get(w, F.lit(g)))
    rows = rows.withColumns({
        "fz": part(1, None), "tz": part(3, None), "rule_name": part(5, 2), "is_global": ~zoned,
        "t": F.when(zoned, _after(w, len(ZONE_RULE))).otherwise(_after(w, len(GLOBAL_RULE))),
    })
    at = lambda i: F.coalesce(F.try_element_at(F.col("t"), F.lit(i)), F.lit(""))
    rows = rows.withColumns({"_head": at(1), "_second": at(2), "_third": at(3), "_n": F.size("t")})
    head, second, third, n = (F.col(c) for c in ("_head", "_second", "_third", "_n"))
    is_match = head == "match"
    listed = is_match & second.isin(*MATCH_LISTS) & (n > 2)
    flagged = is_match & second.isin(*MATCH_FLAGS)
    scheduled = (head == "scheduler-name") & (n > 1)
    acted = (head == "then") & (n > 1)
    quiet = (head == "") | (head == "description")
    unknown = ~(listed | flagged | scheduled | acted | quiet)
    keys = [*SNAPSHOT, "is_global", "fz", "tz", "rule_name"]
    action_map = F.create_map(*[F.lit(x) for p in ACTIONS.items() for x in p])
    grouped = rows.groupBy(*keys).agg(
        F.min("pos").alias("_first"), (~F.max("inactive")).alias("enabled"),
        F.array_sort(F.collect_list(F.when(listed, F.struct("pos", third.alias("v"), second.alias("clause"))))).alias("_listed"),
        *[F.max(flagged & (second == clause)).alias(name) for clause, name in MATCH_FLAGS.items()],
        F.coalesce(F.max_by(F.when(scheduled, second), F.when(scheduled, F.col("pos"))), F.lit("")).alias("scheduler_name"),
        F.coalesce(F.max_by(action_map[second], F.when(acted & second.isin(*ACTIONS), F.col("pos"))), F.lit("")).alias("action"),
        F.max(unknown).alias("_unknown"), _ordered(unknown & is_match, second).alias("unparsed_match"),
    )
    values = lambda clause: F.transform(F.filter("_listed", lambda s: s["clause"] == clause), lambda s: s["v"])
    grouped = grouped.withColumns({f"m_{name}": values(clause) for clause, name in MATCH_LISTS.items()})
    zones = lambda fixed, found: F.when(
        F.col("is_global"), F.when(F.size(found) > 0, F.col(found)).otherwise(F.array(F.lit("any")))
    ).otherwise(F.concat(F.array(fixed), F.col(found)))
    restricted = F.lit(False)
    for name in UNRESOLVED:
        restricted = restricted | (F.size(f"m_{name}") > 0)
    # The window covers the rules of one snapshot, which came from one body.
    order = Window.partitionBy(*SNAPSHOT).orderBy("_first")
    return grouped.select(
        "provider", F.col("device").alias("device_name"), "rule_name", "action", zones("fz", "m_from_zone").alias("from_zone"),
        zones("tz", "m_to_zone").alias("to_zone"), F.col("m_source_addresses").alias("source_addresses"), F.col("m_dest_addresses").alias("dest_addresses"),
        F.col("m_application").alias("application"), F.col("m_application").alias("service"), (F.dense_rank().over(order) - 1).alias("position"),
        "enabled", *MATCH_FLAGS.values(), *[F.col(f"m_{n}").alias(n) for n in UNRESOLVED], "scheduler_name",
        (F.col("_unknown") | restricted | (F.col("scheduler_name") != "")).alias("match_unknown"), "unparsed_match", "collected_at",
    )


_MEMBERS = "struct<member:array<string>>"
_RULE_XML = (
    "entry array<struct<_name:string,_uuid:string,action:string,disabled:string,schedule:string,`negate-source`:string,`negate-destination`:string,"
    + ",".join(f"`{t}`:{_MEMBERS}" for t in (
        "from", "to", "source", "destination", "application", "service", "source-user", "category", "source-hip", "destination-hip"))
    + ">>"
)


def rules_from_xml(snapshots: DataFrame) -> DataFrame:
    """The security rulebase of a configuration document, order kept."""
    xml = unwrap(F.col("body"))
    scoped = F.regexp_extract(xml, r"(?s)<security>.*?(<rules>.*?</rules>)", 1)
    section = F.when(scoped != "", scoped).otherwise(F.regexp_extract(xml, r"(?s)(<rules>.*?</rules>)", 1))
    rows = snapshots.select("*", F.posexplode(F.from_xml(section, _RULE_XML)["entry"]).alias("position", "e"))
    rows = rows.filter(F.trim(text("e._name")) != "")

    def members(tag: str) -> Column:
        trimmed = F.transform(F.coalesce(F.col(f"e.`{tag}`.member"), F.array().cast("array<string>")), lambda m: F.trim(m))
        return F.filter(trimmed, lambda m: m != "")

    def restricts(tag: str) -> Column:
        m = members(tag)
        return (F.size(m) > 0) & ~((F.size(m) == 1) & (F.coalesce(F.try_element_at(m, F.lit(1)), F.lit("")) == "any"))

    yes = lambda tag: F.lower(F.trim(text(f"e.`{tag}`"))) == "yes"
    schedule = F.trim(text("e.schedule"))
    return rows.select(
        "provider", F.col("device").alias("device_name"), F.trim("e._name").alias("rule_name"), F.trim(text("e.action")).alias("action"),
        members("from").alias("from_zone"), members("to").alias("to_zone"), members("source").alias("source_addresses"),
        members("destination").alias("dest_addresses"), members("application").alias("application"), members("service").alias("service"),
        "position", (~yes("disabled")).alias("enabled"), yes("negate-source").alias("negate_source"), yes("negate-destination").alias("negate_destination"),
        schedule.alias("schedule"), members("source-user").alias("source_user"), members("category").alias("url_category"),
        members("source-hip").alias("source_hip"), members("destination-hip").alias("destination_hip"),
        ((schedule != "") | restricts("source-user") | restricts("category") | restricts("source-hip") | restricts("destination-hip")).alias("match_unknown"),
        text("e._uuid").alias("uuid"), "collected_at",
    )


# ---------------------------------------------------------------- counters

def _unambiguous(rows: DataFrame) -> DataFrame:
    """A name seen twice on a device belongs to two rules, so its counter is dropped."""
    counted = rows.groupBy("device", "rule_name", "collected_at").agg(F.count(F.lit(1)).alias("_n"), F.max("hit_count").alias("hit_count"))
    return counted.filter(F.col("_n") == 1).select(
        F.col("device").alias("device_name"), "rule_name", "hit_count", F.col("collected_at").alias("hit_count_collected_at")
    )


def hit_counts_from_text(snapshots: DataFrame) -> DataFrame:
    """Rows of the hit-count table, by its columns."""
    cell = lambda i: F.get("tok", F.lit(i))
    rows = lines_of(snapshots).filter((F.size("tok") == HIT_COLUMNS) & _is_number(cell(0)) & _is_number(cell(HIT_COUNT)))
    return _unambiguous(rows.select("device", "collected_at", cell(HIT_RULE).alias("rule_name"), cell(HIT_COUNT).try_cast("long").alias("hit_count")))


def hit_counts_from_xml(snapshots: DataFrame) -> DataFrame:
    """The counter of each named entry, before any entry inside it or its end.

    The document is cut where entries open, so every piece begins with the
    attributes of one entry; the XML reader takes the name from them.
    """
    pieces = F.split(unwrap(F.col("body")), r"<entry(?=[\s>/])")
    rows = snapshots.select("device", "collected_at", F.explode(_after(pieces, 1)).alias("piece")).filter(F.col("piece").contains("<hit-count>"))
    own = F.split_part("piece", F.lit("</entry"), F.lit(1))
    opening = F.split_part("piece", F.lit(">"), F.lit(1))
    name = F.from_xml(F.concat(F.lit("<entry"), opening, F.lit("><hit-count/></entry>")), "_name string")["_name"]
    count = F.trim(F.split_part(F.split_part(own, F.lit("<hit-count>"), F.lit(2)), F.lit("</hit-count>"), F.lit(1)), F.lit(" \t\r\n"))
    rows = rows.filter(_is_number(count)).select("device", "collected_at", F.trim(text(name)).alias("rule_name"), count.try_cast("long").alias("hit_count"))
    return _unambiguous(rows.filter((F.col("rule_name") != "") & F.col("hit_count").isNotNull()))


def attach_hit_counts(rules: DataFrame, counts: DataFrame) -> DataFrame:
    """Rules with their counter; one that was not collected stays absent."""
    latest = counts.groupBy("device_name", "rule_name").agg(
        F.max_by(F.struct("hit_count", "hit_count_collected_at"), "hit_count_collected_at").alias("_c")
    )
    return lookup_join(rules, latest, ["device_name", "rule_name"], "left").withColumns({
        "hit_count": F.col("_c.hit_count"), "hit_count_collected_at": F.col("_c.hit_count_collected_at"),
    }).drop("_c")


# ---------------------------------------------------------------- object books

def _object(entries: Column) -> Column:
    """``{"k": v, ...}`` with sorted keys from an array of (k, rendered v)."""
    parts = F.transform(F.array_sort(entries), lambda e: F.concat(ascii_json_string(e["k"]), F.lit(": "), e["v"]))
    return F.concat(F.lit("{"), F.array_join(parts, ", "), F.lit("}"))


def _pairs(**values: Column) -> Column:
    """A rendered object of the values that are not NULL."""
    entries = F.array(*[F.struct(F.lit(k).alias("k"), ascii_json_string(v).alias("v"), v.isNotNull().alias("on")) for k, v in values.items()])
    kept = F.transform(F.filter(entries, lambda e: e["on"]), lambda e: F.struct(e["k"], e["v"]))
    return _object(kept)


def _list(values: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(values, ascii_json_string), ", "), F.lit("]"))


def _collect_objects(df: DataFrame, keys: list[str], name: str, value: str) -> DataFrame:
    return df.groupBy(*keys).agg(_object(F.collect_list(F.struct(F.col(name).alias("k"), F.col(value).alias("v")))).alias("_obj"))


def book_objects_from_text(snapshots: DataFrame) -> DataFrame:
    """``(snapshot, section, book, name, spec)`` rows of address books and applications.

    An address that cannot be resolved is marked unknown, and an application
    that any line makes unresolvable stays so.
    """
    rows = lines_of(snapshots).filter(F.get("tok", F.lit(0)) == "set").withColumn("w", _after(F.col("tok"), 1))
    w = F.col("w")
    # First match wins: the words that lead there, the book's name, the family.
    scopes = [
        (ZONE_BOOK, F.concat(F.lit("zone:"), F.get(w, F.lit(3))), "address"), (NAMED_BOOK, F.get(w, F.lit(2)), "address"),
        (PREDEFINED, F.lit("predefined"), "application"), (CUSTOM, F.lit("custom"), "application"),
    ]
    scope = F.coalesce(*[
        F.when(_leads(w, path), F.struct(book.alias("where"), F.lit(family).alias("family"), _after(w, len(path)).alias("t"))) for path, book, family in scopes
    ])
    rows = keep_if(rows.withColumn("_scope", scope), F.col("_scope").isNotNull()).select(*SNAPSHOT, "pos", "_scope.*")
    at = lambda i: F.coalesce(F.try_element_at(F.col("t"), F.lit(i)), F.lit(""))
    rows = rows.withColumns({"_n": F.size("t"), **{f"_w{i}": at(i) for i in range(1, 7)}})
    n, head, name, third, fourth = (F.col(c) for c in ("_n", "_w1", "_w2", "_w3", "_w4"))
    in_book, in_apps = F.col("family") == "address", F.col("family") == "application"
    section = (
        F.when(in_book & (head == "address") & (n >= 3) & (third != "description"), "addresses").when(in_book & (head == "address-set") & (n >= 4), "address_sets")
        .when(in_book & (head == "attach") & (name == "zone") & (n >= 3), "attached_zones")
        .when(in_apps & (head == "application-set") & (n >= 4), "application_sets").when(in_apps & (head == "application") & (n >= 3), "applications")
    )
    rows = keep_if(rows.withColumn("section", section), F.col("section").isNotNull())
    is_address, is_zone, is_app = (F.col("section") == x for x in ("addresses", "attached_zones", "applications"))

    spec = (
        F.when(third == "dns-name", _pairs(kind=F.lit("unknown"), reason=F.lit("dns-name")))
        .when((third == "range-address") & (n >= 5) & (F.col("_w5") == "to"), _pairs(kind=F.lit("range"), low=fourth, high=F.col("_w6")))
        .when((third == "wildcard-address") & (n >= 4), _pairs(kind=F.lit("wildcard"), value=fourth))
        .when(third.rlike(NETWORK), _pairs(kind=F.lit("address"), value=third)).otherwise(_pairs(kind=F.lit("unknown"), reason=F.lit("unparsed")))
    )
    in_set = F.when(F.col("section") == "address_sets", third.isin("address", "address-set")).when(
        F.col("section") == "application_sets", third.isin("application", "application-set"))
    flag = F.when(is_app & (third == "term"), "multi-term").when(is_app & ~third.isin(*APPLICATION_FIELDS), "unrecognized-field")
    fields = {f.replace("-", "_"): F.max_by(F.when(third == f, fourth), F.when(is_app & (third == f), F.col("pos"))) for f in APPLICATION_FIELDS}
    # All sections are reduced in one pass over the lines.
    grouped = rows.groupBy(*SNAPSHOT, "where", "section", F.when(is_zone, "").otherwise(name).alias("name")).agg(
        F.max_by(F.when(is_address, spec), F.when(is_address, F.col("pos"))).alias("_address"),
        _ordered(is_zone | in_set, F.when(is_zone, third).otherwise(fourth)).alias("_listed"),
        F.min_by(flag, F.when(flag.isNotNull(), F.col("pos"))).alias("_flag"), *[v.alias(f"_{k}") for k, v in fields.items()],
    )
    shown = (
        F.when(is_address, F.col("_address")).when(is_zone, _list(F.col("_listed")))
        .when(~is_app, F.concat(F.lit('{"members": '), _list(F.col("_listed")), F.lit("}")))
        .when(F.col("_flag").isNotNull(), _pairs(kind=F.lit("unknown"), reason=F.col("_flag")))
        .otherwise(_pairs(kind=F.lit("application"), **{k: F.col(f"_{k}") for k in fields}))
    )
    return grouped.select(*SNAPSHOT, "where", "section", "name", shown.alias("spec"))


def object_books_from_text(snapshots: DataFrame) -> DataFrame:
    """One canonical JSON object book per device snapshot."""
    objects = book_objects_from_text(snapshots)
    app, custom = F.col("section").isin("applications", "application_sets"), F.col("where") == "custom"
    # Zones are one row for each book, whose spec is the list itself.
    whole = F.when(F.first("section") == "attached_zones", F.max("spec")).otherwise(_object(F.collect_list(F.struct(F.col("name").alias("k"), F.col("spec").alias("v")))))
    sections = objects.groupBy(*SNAPSHOT, "where", "section").agg(whole.alias("_obj"))
    of = lambda name: F.max(F.when(F.col("section") == name, F.col("_obj")))
    names = ("address_sets", "addresses", "attached_zones", "application_sets", "applications")
    books = sections.groupBy(*SNAPSHOT, app.alias("_app"), "where").agg(*[of(name).alias(name) for name in names])
    book = F.concat(
        F.lit('{"address_sets": '), F.coalesce("address_sets", F.lit("{}")), F.lit(', "addresses": '), F.coalesce("addresses", F.lit("{}")),
        F.lit(', "attached_zones": '), F.coalesce("attached_zones", F.lit("[]")), F.lit("}"),
    )
    address_books = _object(F.collect_list(F.when(~F.col("_app"), F.struct(F.col("where").alias("k"), book.alias("v")))))
    apps = lambda name, where: F.coalesce(F.max(F.when(F.col("_app") & where, F.col(name))), F.lit("{}"))
    grouped = books.groupBy(*SNAPSHOT).agg(F.concat(
        F.lit('{"address_books": '), address_books, F.lit(', "application_sets": '), apps("application_sets", custom), F.lit(', "applications": '), apps("applications", custom),
        F.lit(', "predefined_application_sets": '), apps("application_sets", ~custom), F.lit(', "predefined_applications": '), apps("applications", ~custom), F.lit("}"),
    ).alias("object_book"))
    return grouped.select(F.lit(DEFAULT_TENANT).alias("tenant_id"), "provider", F.col("device").alias("device_name"), "collected_at", "object_book")


# The five containers a pass must deliver, by snapshot command.
XML_PARTS = {"address": "addresses", "address-group": "address_groups", "service": "services", "service-group": "service_groups", "schedule": "schedules"}
_OBJECT_XML = (
    "entry array<struct<_name:string,`ip-netmask`:string,`ip-range`:string,`ip-wildcard`:string,fqdn:string,dynamic:struct<filter:string>,"
    f"static:{_MEMBERS},members:{_MEMBERS},protocol:struct<tcp:struct<port:string,`source-port`:string>,udp:struct<port:string,`source-port`:string>>>>"
)


def object_books_from_xml(snapshots: DataFrame) -> DataFrame:
    """One canonical JSON object book per device pass.

    ``command`` names the container.  A part that is missing, cut short or not
    well formed rejects the device's whole pass: an empty book would look like
    a real change.
    """
    xml = unwrap(F.col("body"))
    # The container itself, whatever wraps it.
    root = F.coalesce(F.nullif(F.regexp_extract(
        xml, r"(?s)(<(address|address-group|service|service-group|schedule)>.*</\2>|<(address|address-group|service|service-group|schedule)/>)", 1), F.lit("")), xml)
    parsed = snapshots.filter(F.col("command").isin(*XML_PARTS)).withColumns({
        "x": F.from_xml(root, _OBJECT_XML), "well_formed": F.coalesce(xml.rlike(r"(?s)^\s*<.*>\s*\z"), F.lit(False)),
    })
    check = F.from_xml(root, "_corrupt_record string", {"mode": "PERMISSIVE"})["_corrupt_record"].isNull()
    parsed = parsed.withColumn("ok", F.col("well_formed") & check & ~F.coalesce("truncated", F.lit(False)))
    passes = parsed.groupBy(*SNAPSHOT).agg(F.min("ok").alias("all_ok"), F.count_distinct("command").alias("parts")).filter(
        F.col("all_ok") & (F.col("parts") == len(XML_PARTS))
    ).select(*SNAPSHOT)
    good = parsed.join(passes, list(SNAPSHOT), "left_semi")
    rows = good.select(*SNAPSHOT, "command", F.explode("x.entry").alias("e")).withColumn("name", F.trim(text("e._name"))).filter(F.col("name") != "")
    value = lambda tag: F.nullif(F.trim(text(f"e.`{tag}`")), F.lit(""))
    unknown = lambda why: _pairs(kind=F.lit("unknown"), reason=F.lit(why))
    members = lambda tag: _list(F.filter(F.transform(F.coalesce(F.col(f"e.{tag}.member"), F.array().cast("array<string>")), F.trim), lambda m: m != ""))
    address = F.lit(None).cast("string")
    for tag in ("ip-wildcard", "ip-range", "ip-netmask"):
        address = F.when(value(tag).isNotNull(), _pairs(kind=F.lit(tag), value=value(tag))).otherwise(address)
    address = F.coalesce(address, F.when(value("fqdn").isNotNull(), unknown("fqdn")).otherwise(unknown("unrecognized-address-type")))
    service = F.lit(None).cast("string")
    for proto in ("udp", "tcp"):
        side = F.col(f"e.protocol.{proto}")
        service = F.when(side.isNotNull(), _pairs(
            protocol=F.lit(proto), port=F.trim(text(side["port"])), source_port=F.trim(text(side["source-port"])))).otherwise(service)
    spec = (
        F.when(F.col("command") == "address", address)
        .when(F.col("command") == "address-group", F.when(F.col("e.dynamic").isNotNull(), unknown("dynamic-address-group")).otherwise(
            F.concat(F.lit('{"kind": "static", "members": '), members("static"), F.lit("}"))))
        .when(F.col("command") == "service", F.coalesce(service, unknown("unrecognized-protocol")))
        .when(F.col("command") == "service-group", F.concat(F.lit('{"members": '), members("members"), F.lit("}"))).otherwise("{}")
    )
    sections = _collect_objects(rows.withColumn("spec", spec), [*SNAPSHOT, "command"], "name", "spec")
    whole = F.concat(F.lit("{"), F.concat_ws(", ", *[
        F.concat(F.lit(f'"{part}": '), F.coalesce(F.max(F.when(F.col("command") == command, F.col("_obj"))), F.lit("{}")))
        for command, part in sorted(XML_PARTS.items(), key=lambda p: p[1])
    ]), F.lit("}"))
    # Left join from the passes, so a pass whose containers are all empty keeps its book.
    books = passes.join(sections, list(SNAPSHOT), "left").groupBy(*SNAPSHOT).agg(whole.alias("object_book"))
    return books.select(F.lit(DEFAULT_TENANT).alias("tenant_id"), "provider", F.col("device").alias("device_name"), "collected_at", "object_book")
