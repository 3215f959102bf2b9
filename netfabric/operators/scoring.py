"""Scoring answers against reference results.  Anything missing fails."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netfabric.functions.ids import text

# Tools a public run may use.
PUBLIC_TOOLS = ("metric_timeseries", "top_series", "entity_metric_timeseries")
REDACTED_TIER = "sovereign"


def _set(values: Column) -> Column:
    return F.array_sort(F.array_distinct(F.coalesce(values, F.array().cast("array<string>"))))


def match_exact(agent: Column, reference: Column) -> Column:
    return _set(agent) == _set(reference)


def overlap(agent: Column, reference: Column) -> Column:
    return F.size(F.array_intersect(_set(agent), _set(reference)))


def match_overlap(agent: Column, reference: Column, needed: Column) -> Column:
    return overlap(agent, reference) >= needed


def match_tolerance(agent: Column, reference: Column, tolerance: Column, tolerance_pct: Column) -> Column:
    """|agent - reference| within an absolute bound, else within a share of the reference."""
    allowed = F.coalesce(tolerance, F.abs(reference) * tolerance_pct / F.lit(100.0))
    return F.coalesce(F.abs(agent - reference) <= allowed, F.lit(False))


def _is_list(value: str) -> str:
    return f"startswith(schema_of_variant({value}), 'ARRAY<')"


def _is_object(value: str) -> str:
    return f"startswith(schema_of_variant({value}), 'OBJECT<')"


# SQL text, as one parsed expression is built far faster than hundreds of columns.
#
# How deep the brackets of a text nest, those in strings left out; null where one closes that was not open.
_NESTING = r"""
reduce(split(regexp_replace(regexp_replace(regexp_replace(document, r'(?s)\\.', ''), r'"[^"]*+"', ''), r'[^\[\]{}]++', ''), ''),
  named_struct('now', 0, 'most', 0, 'least', 0),
  (s, c) -> transform(array(s.now + CASE WHEN c IN ('[', '{') THEN 1 WHEN c IN (']', '}') THEN -1 ELSE 0 END),
    now -> named_struct('now', now, 'most', greatest(s.most, now), 'least', least(s.least, now)))[0],
  s -> IF(s.least = 0, s.most, NULL))"""

# The one value of a text.  The parser stops after a value, so the text is read as the only item of a list.
_PARSED = f"""
transform(array(try_variant_get(try_parse_json('[' || document || ']'), '$', 'array<variant>')),
  items -> IF(size(items) = 1 AND ({_NESTING}) IS NOT NULL, items[0], NULL))[0]"""

# A scalar as (none, plain text, literal).  Whole numbers have no point, others are doubles; true and false count as 1 and 0.
_SCALAR = """
transform(array(named_struct('kind', schema_of_variant(v), 'said', to_json(v))), t -> CASE
  WHEN t.kind = 'STRING' THEN named_struct('none', false, 'plain', try_variant_get(v, '$', 'string'), 'literal', t.said)
  ELSE transform(array(CASE
    WHEN t.kind = 'BOOLEAN' THEN IF(t.said = 'true', '1', '0')
    WHEN t.kind = 'BIGINT' THEN t.said
    ELSE coalesce(IF(try_cast(t.said AS DOUBLE) % 1 = 0 AND abs(try_cast(t.said AS DOUBLE)) < 1e38, CAST(try_cast(t.said AS DECIMAL(38, 0)) AS STRING), NULL),
      CAST(try_cast(t.said AS DOUBLE) AS STRING), t.said, 'null') END),
    x -> named_struct('none', x = 'null', 'plain', x, 'literal', x))[0] END)[0]"""

# What a node (path, value, leaf) holds, as nodes; a finished node stays.  Key lengths keep paths apart whatever the keys hold.
_CHILDREN = f"""
CASE WHEN n.leaf IS NOT NULL THEN array(n)
  WHEN {_is_object("n.value")} THEN transform(array(map_entries(try_variant_get(n.value, '$', 'map<string,variant>'))), fields -> IF(size(fields) > 0,
    transform(fields, e -> named_struct('path', concat(n.path, '.', length(e.key), ':', e.key), 'value', e.value, 'leaf', CAST(NULL AS STRING))),
    array(named_struct('path', n.path, 'value', CAST(NULL AS VARIANT), 'leaf', '{{}}'))))[0]
  WHEN {_is_list("n.value")} THEN transform(array(try_variant_get(n.value, '$', 'array<variant>')), items -> IF(
    exists(items, v -> coalesce({_is_list("v")} OR {_is_object("v")}, false)),
    transform(items, (v, i) -> named_struct('path', concat(n.path, '[', i, ']'), 'value', v, 'leaf', CAST(NULL AS STRING))),
    array(named_struct('path', n.path, 'value', CAST(NULL AS VARIANT), 'leaf', '[' || array_join(array_sort(transform(
      transform(items, v -> {_SCALAR}), (r, i) -> named_struct('none', r.none, 'plain', r.plain, 'i', i, 'literal', r.literal))).literal, ',') || ']'))))[0]
  ELSE array(named_struct('path', n.path, 'value', CAST(NULL AS VARIANT), 'leaf', transform(array(n.value), v -> {_SCALAR})[0].literal)) END"""

_LEAVES = f"""
transform(array({_PARSED}), parsed -> IF(parsed IS NULL, NULL, array_sort(transform(
  reduce(sequence(0, {_NESTING}), array(named_struct('path', '', 'value', parsed, 'leaf', CAST(NULL AS STRING))),
    (nodes, _) -> flatten(transform(nodes, n -> {_CHILDREN}))),
  n -> named_struct('path', n.path, 'leaf', n.leaf)))))[0]"""


def _of(document: Column, expression: str) -> Column:
    return F.get(F.call_function("transform", F.array(document), F.expr(f"document -> {expression}")), F.lit(0))


def parsed_json(document: Column) -> Column:
    """The one JSON value of a text; null for other texts, those with anything after the value among them."""
    return _of(document, _PARSED)


def normal_json(document: Column) -> Column:
    """JSON as its sorted leaves, ``array<struct<path, leaf>>``; null where the text is not JSON.

    Equal documents have equal leaves: keys in any order, lists of scalars in any order,
    numbers by value.  A list of scalars and an empty object are one leaf each; lists that
    hold objects or lists keep their order.  A level is opened per round, as many rounds as
    the text is deep, all in one row of the JVM.
    """
    return _of(document, _LEAVES)


def match_json(agent: Column, expected: Column) -> Column:
    return F.coalesce(normal_json(agent) == normal_json(expected), F.lit(False))


def match_refusal(answer: Column) -> Column:
    """The answer is an object whose ``refusal`` is the JSON value true."""
    flag = F.try_variant_get(parsed_json(text(answer)), "$.refusal", "variant")
    return F.coalesce((F.schema_of_variant(flag) == "BOOLEAN") & (F.to_json(flag) == "true"), F.lit(False))


def routing_reason(required: Column, observed: Column, tier: Column, public: Sequence[str] = PUBLIC_TOOLS) -> Column:
    """Why the tool routing fails, or '' when it passes.

    Any one of the required tools is enough; a public run must stay in the public set.
    """
    need = F.coalesce(required, F.array().cast("array<string>"))
    seen = F.coalesce(observed, F.array().cast("array<string>"))
    outside = F.array_except(seen, F.array(*[F.lit(t) for t in public]))
    return (
        F.when((F.size(need) > 0) & ~F.arrays_overlap(need, seen), "none of the accepted tools observed")
        .when((tier == "public") & (F.size(outside) > 0), "non-public tools observed on public run").otherwise("")
    )


def check_tools(questions: DataFrame, observed: DataFrame) -> DataFrame:
    """Routing verdict per question: ``observed(id, tools)``."""
    joined = questions.select("id", "tier", "required_tools").join(observed.select("id", "tools"), "id", "left")
    reason = routing_reason(F.col("required_tools"), F.col("tools"), F.col("tier"))
    return joined.select("id", (reason == "").alias("tools_pass"), reason.alias("tools_reason"))


def score(questions: DataFrame, answers: DataFrame, references: DataFrame, observed: DataFrame) -> DataFrame:
    """Verdict per question.

    ``questions(id, tier, category, difficulty, required_tools, ptype, match,
    min_overlap, tolerance, tolerance_pct, expected)``, ``answers(id, answer,
    values, number, error)``, ``references(id, value)`` with the rows of each
    reference query, ``observed(id, tools)``.  Sets are compared by counts of
    distinct rows, so a reference result may be of any size.
    """
    ref_rows = references.select("id", "value").distinct()
    refs = ref_rows.groupBy("id").agg(F.count(F.lit(1)).alias("ref_n"), F.min("value").alias("ref_first"))
    said = answers.select("id", F.explode("values").alias("value")).distinct()
    agent = said.groupBy("id").agg(F.count(F.lit(1)).alias("agent_n"))
    common = said.join(ref_rows, ["id", "value"]).groupBy("id").agg(F.count(F.lit(1)).alias("common_n"))
    one_answer = answers.groupBy("id").agg(F.min(F.struct("answer", "values", "number", "error")).alias("_a"))
    joined = (
        questions.join(one_answer, "id", "left").join(refs, "id", "left").join(agent, "id", "left").join(common, "id", "left")
        .join(observed.select("id", "tools"), "id", "left")
    )
    agent_n, ref_n, common_n = (F.coalesce(c, F.lit(0)) for c in ("agent_n", "ref_n", "common_n"))
    answer, error = F.col("_a.answer"), F.col("_a.error")
    by_reference = (
        F.when(F.col("match") == "exact", (common_n == agent_n) & (common_n == ref_n))
        .when(F.col("match") == "set_overlap", common_n >= F.col("min_overlap"))
        .when(F.col("match") == "numeric_tolerance", match_tolerance(
            F.col("_a.number"), F.col("ref_first").try_cast("double"), F.col("tolerance"), F.col("tolerance_pct")))
    )
    predicate = F.coalesce(
        F.when(F.col("ptype") == "refusal", match_refusal(answer))
        .when(answer.isNull(), F.lit(False))
        .when(F.col("ptype") == "expected_json", match_json(answer, F.col("expected")))
        .otherwise(by_reference),
        F.lit(False),
    )
    routing = routing_reason(F.col("required_tools"), F.col("tools"), F.col("tier"))
    missing, failed = F.col("_a").isNull(), error.isNotNull()
    reasons = F.filter(F.array(
        F.when(missing, "question not in answers"), F.when(~missing & failed, F.concat(F.lit("runner error: "), error)),
        F.when(~missing & ~failed & ~predicate, "predicate failed"),
        F.when(~missing & ~failed & (routing != ""), F.concat(F.lit("tools: "), routing)),
    ), lambda r: r.isNotNull())
    passed = ~missing & ~failed & predicate & (routing == "")
    return joined.select(
        "id", "tier", "category", "difficulty", F.coalesce(passed, F.lit(False)).alias("pass"), reasons.alias("reasons"),
    )


def rollups(scored: DataFrame) -> DataFrame:
    """Totals by category, difficulty, tier and overall in one pass."""
    dims = ["category", "difficulty", "tier"]
    sets = [[F.col(d)] for d in dims] + [[]]
    grouped = scored.groupingSets(sets, *dims).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("pass").alias("passed"), F.grouping_id().alias("_g")
    )
    # grouping_id has one bit per dimension, set when it is rolled up.
    dim = F.when(F.col("_g") == 3, "category").when(F.col("_g") == 5, "difficulty").when(F.col("_g") == 6, "tier").otherwise("total")
    return grouped.select(dim.alias("dimension"), F.coalesce(*dims, F.lit("")).alias("value"), "total", "passed")


def regressions(history: DataFrame, current: DataFrame) -> DataFrame:
    """``(model, id)`` that ever passed and fails now."""
    ever = history.filter(F.col("pass")).select("model", "id")
    failing = current.filter(~F.col("pass")).select("model", "id")
    return ever.intersect(failing)


def set_digest(values: Column) -> Column:
    return F.sha2(F.array_join(_set(values), "\n"), 256)


def redact_detail(agent: Column, reference: Column) -> Column:
    """Counts and a digest in place of the values."""
    return F.struct(
        F.size(_set(agent)).alias("agent_count"), F.size(_set(reference)).alias("reference_count"),
        overlap(agent, reference).alias("overlap"), set_digest(reference).alias("reference_sha256"),
    )
