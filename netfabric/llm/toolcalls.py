"""Tool calls in conversations: link results, order calls, validate arguments, serialise canonical JSON.

Calls and results are joined by identifier.  A call may follow another; its level
in that forest is found by doubling the distance that each pointer spans, so a
conversation of n calls takes log n rounds and never meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netfabric.session import cut_lineage

#: The JSON Schema type names, and Spark's names for parsed JSON values of each.
TYPES = {
    "string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|DECIMAL.*", "boolean": "BOOLEAN", "object": "OBJECT<.*",
    "array": "ARRAY<.*", "null": "VOID",
}


def order_calls(calls: DataFrame) -> DataFrame:
    """``(conv_id, call_id, level, order_error)``: how many calls a call follows, one after another.

    ``calls`` is ``(conv_id, call_id, follows)``, ids unique in a conversation.  A call that
    follows an unknown id counts from 0 with an error; one that leads into a cycle has no level.
    """
    nodes = calls.select("conv_id", "call_id", "follows")
    known = nodes.select("conv_id", F.col("call_id").alias("follows"), F.lit(True).alias("_there"))
    state = cut_lineage(nodes.join(known, ["conv_id", "follows"], "left").select(
        "conv_id", "call_id", F.when(F.col("_there"), F.col("follows")).alias("at"), F.when(F.col("_there"), F.lit(1)).otherwise(F.lit(0)).cast("long").alias("level"),
        (F.col("follows").isNotNull() & F.col("_there").isNull()).alias("lost")))
    most = state.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    for _ in range(int(most).bit_length()):
        if not state.filter(F.col("at").isNotNull()).take(1):
            break
        ahead = state.select("conv_id", F.col("call_id").alias("at"), F.col("at").alias("_at"), F.col("level").alias("_level"))
        state = cut_lineage(state.join(ahead, ["conv_id", "at"], "left").select(
            "conv_id", "call_id", F.col("_at").alias("at"), (F.col("level") + F.coalesce("_level", F.lit(0))).alias("level"), "lost"))
    cycle = F.col("at").isNotNull()
    return state.select(
        "conv_id", "call_id", F.when(~cycle, F.col("level")).alias("level"),
        F.when(cycle, "cycle").when(F.col("lost"), "follows an unknown call").alias("order_error"))


def argument_errors(arguments: Column, params: Column) -> Column:
    """Sorted faults of an argument object under ``params``, an array of ``(param, type, required)``.

    A whole number is an integer however it is written (1, 1.0, 1e2), as JSON Schema has it.
    """
    def kind_of(v: Column) -> Column:
        kind = F.schema_of_variant(v)
        return F.when(kind.startswith("DECIMAL") | (kind == "DOUBLE"), F.when(F.to_json(v).try_cast("double") % 1 == 0, "BIGINT").otherwise(kind)).otherwise(kind)

    kinds = F.transform_values(F.from_json(arguments, "map<string,variant>"), lambda _, v: kind_of(v))
    want = F.create_map(*[x for k, v in TYPES.items() for x in (F.lit(k), F.lit(f"^({v})$"))])

    def fault(p: Column) -> Column:
        kind = kinds[p["param"]]
        missing = F.when(p["required"], F.concat(F.lit("missing "), p["param"]))
        wrong = F.when(~F.regexp_like(kind, want[p["type"]]), F.concat(F.lit("wrong type of "), p["param"]))
        return F.when(F.map_contains_key(kinds, p["param"]), wrong).otherwise(missing)

    names = F.transform(params, lambda p: p["param"])
    unknown = F.transform(F.array_except(F.map_keys(kinds), names), lambda k: F.concat(F.lit("unknown "), k))
    faults = F.array_sort(F.concat(F.array_compact(F.transform(params, fault)), unknown))
    is_object = F.schema_of_variant(F.try_parse_json(arguments)).startswith("OBJECT<")
    return (
        F.when(F.try_parse_json(arguments).isNull(), F.array(F.lit("arguments are not JSON")))
        .when(~is_object, F.array(F.lit("arguments are not an object")))
        .when(params.isNull(), F.array(F.lit("unknown tool"))).otherwise(faults)
    )


def link_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """``(conv_id, call_id, name, level, status, valid, errors, json)``: one row per call id.

    ``calls`` is ``(conv_id, call_id, name, arguments, follows)``, ``results`` ``(conv_id,
    call_id, content)`` and ``schemas`` ``(name, param, type, required)``.  ``status`` is
    ``linked``, ``no result`` or ``no call``.  A call that repeats counts once, its least
    arguments stay; of several results the least content stays and an error says so.  Rows
    without a conversation or call id are left out.  ``json`` has sorted keys at every depth
    and no blanks; what is null is left out, arguments that are not JSON are kept as a string.
    Long contents stay whole; empty tables give no rows; extra columns are ignored.
    """
    keys = ["conv_id", "call_id"]
    there = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    one_call = calls.filter(there).groupBy(*keys).agg(F.min(F.struct("arguments", "name", "follows")).alias("c"), F.count(F.lit(1)).alias("n_calls"))
    one_call = one_call.select(*keys, F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"), F.col("c.follows").alias("follows"), "n_calls")
    one_call = cut_lineage(one_call)
    answered = results.filter(there).groupBy(*keys).agg(F.min("content").alias("content"), F.count(F.lit(1)).alias("n_results"))
    params = schemas.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("param", "type", "required"))).alias("params"))
    linked = one_call.join(answered, keys, "full").join(order_calls(one_call), keys, "left").join(params, "name", "left")
    is_call, is_result = F.col("n_calls").isNotNull(), F.col("n_results").isNotNull()
    more = F.array_compact(F.array(
        F.col("order_error"), F.when(F.col("n_calls") > 1, "call repeats"), F.when(F.col("n_results") > 1, "result repeats")))
    errors = F.when(is_call, F.concat(argument_errors(F.coalesce("arguments", F.lit("{}")), F.col("params")), more)).otherwise(more)
    parsed = F.try_parse_json("arguments")
    body = lambda value: F.to_json(F.struct(
        value.alias("arguments"), "call_id", "conv_id", "level", "name", F.col("content").alias("result")))
    return linked.select(
        *keys, "name", "level",
        F.when(is_call & is_result, "linked").when(is_call, "no result").otherwise("no call").alias("status"),
        (is_call & (F.size(errors) == 0)).alias("valid"), F.array_join(errors, "; ").alias("errors"),
        F.when(parsed.isNotNull(), body(parsed)).otherwise(body(F.col("arguments"))).alias("json"))


def turns_as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of a table of turns: a user's turn calls the assistant, the turn after it answers.

    A short question calls ``ask``, a longer one ``read``; each follows the call two turns before.
    """
    turns = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    call_id = lambda turn: F.concat(F.lit("call_"), F.lpad(turn.cast("string"), 9, "0"))
    calls = turns.filter("role = 'user'").select(
        "conv_id", call_id(F.col("turn")).alias("call_id"), F.when(F.length("text") < 100, "ask").otherwise("read").alias("name"),
        F.to_json(F.struct("turn", "text")).alias("arguments"), F.when(F.col("turn") >= 2, call_id(F.col("turn") - 2)).alias("follows"))
    results = turns.filter("role = 'assistant'").select("conv_id", call_id(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def default_schemas(spark: SparkSession) -> DataFrame:
    """The arguments of the two tools that ``turns_as_calls`` speaks of."""
    return spark.sql("""SELECT * FROM VALUES ('ask', 'text', 'string', true), ('ask', 'turn', 'integer', true),
        ('read', 'text', 'string', true), ('read', 'turn', 'integer', true), ('read', 'limit', 'integer', false)
        AS t(name, param, type, required)""")


CALLS_SQL = """
WITH RECURSIVE c AS (
  SELECT conv_id, turn, 'call_' || lpad(CAST(turn AS VARCHAR), 9, '0') AS call_id,
    CASE WHEN length(text) < 100 THEN 'ask' ELSE 'read' END AS name, text FROM conversations WHERE role = 'user'
), r AS (
  SELECT conv_id, 'call_' || lpad(CAST(turn - 1 AS VARCHAR), 9, '0') AS call_id, text AS content FROM conversations WHERE role = 'assistant'
), l AS (
  SELECT c.conv_id, c.turn, CAST(0 AS BIGINT) AS level, c.turn >= 2 AS lost FROM c LEFT JOIN c AS p ON p.conv_id = c.conv_id AND p.turn = c.turn - 2
  WHERE p.turn IS NULL
  UNION ALL
  SELECT c.conv_id, c.turn, l.level + 1, false FROM c JOIN l ON l.conv_id = c.conv_id AND c.turn = l.turn + 2
)
SELECT COALESCE(c.conv_id, r.conv_id) AS conv_id, COALESCE(c.call_id, r.call_id) AS call_id, c.name, l.level,
  CASE WHEN c.call_id IS NULL THEN 'no call' WHEN r.call_id IS NULL THEN 'no result' ELSE 'linked' END AS status,
  c.call_id IS NOT NULL AND NOT l.lost AS valid, CASE WHEN l.lost THEN 'follows an unknown call' ELSE '' END AS errors,
  '{' || CASE WHEN c.call_id IS NULL THEN '' ELSE '"arguments":{"text":' || CAST(to_json(c.text) AS VARCHAR) || ',"turn":' || c.turn || '},' END
    || '"call_id":"' || COALESCE(c.call_id, r.call_id) || '","conv_id":' || COALESCE(c.conv_id, r.conv_id)
    || CASE WHEN c.call_id IS NULL THEN '' ELSE ',"level":' || l.level || ',"name":"' || c.name || '"' END
    || CASE WHEN r.content IS NULL THEN '' ELSE ',"result":' || CAST(to_json(r.content) AS VARCHAR) END || '}' AS json
FROM c FULL JOIN r ON c.conv_id = r.conv_id AND c.call_id = r.call_id LEFT JOIN l ON l.conv_id = c.conv_id AND l.turn = c.turn
"""
