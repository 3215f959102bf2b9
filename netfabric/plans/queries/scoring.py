"""Scoring: questions from labelled documents, answers that are right or wrong by label."""

from __future__ import annotations

from pyspark.sql import functions as F

from netfabric.operators import scoring as op
from netfabric.plans import adapter as ad
from netfabric.plans.adapter import DUCK, with_views
from netfabric.plans.queries import REGISTRY

QS = with_views(DUCK, "questions")
EXPECTED = '{"a":[1,2,3],"b":"x"}'


def _questions(spark, sf_dir):
    return ad.view(spark, sf_dir, "questions").withColumn("required_tools", F.array("required_tool")).withColumn(
        "expected", F.when(F.col("ptype") == "expected_json", EXPECTED)
    )


def _digits(start):
    return F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: (start + k).cast("string"))


def _references(q):
    return q.select("id", F.explode(_digits(F.col("n_chars") % 7)).alias("value"))


def _answers(q):
    right = F.col("quality") == 1
    body = (
        F.when(F.col("ptype") == "refusal", F.when(right, '{"refusal": true}').otherwise('{"refusal": "true"}'))
        .when(F.col("ptype") == "expected_json", F.when(right, '{"b":"x","a":[3,1,2]}').otherwise('{"b":"y","a":[3,1,2]}'))
        .otherwise("{}")
    )
    return q.filter(F.col("id") % 11 != 0).select(
        "id", body.alias("answer"), F.reverse(_digits(F.col("n_chars") % 7 + F.when(right, 0).otherwise(F.col("toxic") + 1))).alias("values"),
        (F.col("n_chars") % 7 + 5 * (1 - F.col("quality"))).cast("double").alias("number"), F.when(F.col("id") % 13 == 0, "timeout").alias("error"),
    )


def _observed(q):
    tools = F.when(F.col("id") % 6 == 0, F.array().cast("array<string>")).when(
        F.col("id") % 10 == 0, F.array(F.lit("metric_timeseries"), F.col("required_tool"))
    ).otherwise(F.array("required_tool"))
    return q.select("id", tools.alias("tools"))


SHIFT = "CASE WHEN quality = 1 THEN 0 ELSE toxic + 1 END"
ROUTING = """CASE WHEN id % 6 = 0 THEN 'none of the accepted tools observed' WHEN tier = 'public' THEN 'non-public tools observed on public run' ELSE '' END"""
TOL = "(abs(5 * (1 - quality)) <= coalesce(tolerance, n_chars % 7 * tolerance_pct / 100.0))"
SCORED = f"""{QS}, p AS (SELECT *, {ROUTING} AS routing, CASE WHEN ptype IN ('refusal', 'expected_json') THEN quality = 1
    WHEN match = 'exact' THEN {SHIFT} = 0 WHEN match = 'set_overlap' THEN 3 - {SHIFT} >= min_overlap ELSE {TOL} END AS ok FROM questions),
s AS (SELECT id, tier, category, difficulty, id % 11 <> 0 AND id % 13 <> 0 AND ok AND routing = '' AS pass, concat_ws('; ',
    CASE WHEN id % 11 = 0 THEN 'question not in answers' END, CASE WHEN id % 11 <> 0 AND id % 13 = 0 THEN 'runner error: timeout' END,
    CASE WHEN id % 11 <> 0 AND id % 13 <> 0 AND NOT ok THEN 'predicate failed' END,
    CASE WHEN id % 11 <> 0 AND id % 13 <> 0 AND routing <> '' THEN 'tools: ' || routing END) AS reasons FROM p)"""


def _score(spark, sf_dir):
    q = _questions(spark, sf_dir)
    return op.score(q, _answers(q), _references(q), _observed(q))


def _sets(spark, sf_dir):
    q = _questions(spark, sf_dir)
    refs = _references(q).groupBy("id").agg(F.collect_set("value").alias("ref"))
    return q.select("id", "tolerance", "tolerance_pct", (F.col("n_chars") % 7).cast("double").alias("ref_number")).join(_answers(q), "id").join(refs, "id")


@REGISTRY.add("match_exact", f"{QS} SELECT id, {SHIFT} = 0 AS ok FROM questions WHERE id % 11 <> 0")
def match_exact(spark, sf_dir):
    return _sets(spark, sf_dir).select("id", op.match_exact(F.col("values"), F.col("ref")).alias("ok"))


@REGISTRY.add("match_overlap", f"{QS} SELECT id, CAST(3 - {SHIFT} AS INT) AS overlap, 3 - {SHIFT} >= 2 AS ok FROM questions WHERE id % 11 <> 0")
def match_overlap(spark, sf_dir):
    a, r = F.col("values"), F.col("ref")
    return _sets(spark, sf_dir).select("id", op.overlap(a, r).alias("overlap"), op.match_overlap(a, r, F.lit(2)).alias("ok"))


@REGISTRY.add("match_tolerance", f"{QS} SELECT id, {TOL} AS ok FROM questions WHERE id % 11 <> 0")
def match_tolerance(spark, sf_dir):
    return _sets(spark, sf_dir).select(
        "id", op.match_tolerance(F.col("number"), F.col("ref_number"), F.col("tolerance"), F.col("tolerance_pct")).alias("ok")
    )


@REGISTRY.add("match_json", f"{QS} SELECT id, ptype = 'expected_json' AND quality = 1 AS ok FROM questions WHERE id % 11 <> 0")
def match_json(spark, sf_dir):
    q = _questions(spark, sf_dir)
    return _answers(q).select("id", op.match_json(F.col("answer"), F.lit(EXPECTED)).alias("ok"))


@REGISTRY.add("match_refusal", f"{QS} SELECT id, ptype = 'refusal' AND quality = 1 AS ok FROM questions WHERE id % 11 <> 0")
def match_refusal(spark, sf_dir):
    q = _questions(spark, sf_dir)
    return _answers(q).select("id", op.match_refusal(F.col("answer")).alias("ok"))


@REGISTRY.add("check_tools", f"{QS} SELECT id, {ROUTING} = '' AS tools_pass, {ROUTING} AS tools_reason FROM questions")
def check_tools(spark, sf_dir):
    q = _questions(spark, sf_dir)
    return op.check_tools(q, _observed(q))


@REGISTRY.add("score", f"{SCORED} SELECT * FROM s")
def score(spark, sf_dir):
    return _score(spark, sf_dir).withColumn("reasons", F.array_join("reasons", "; "))


@REGISTRY.add("score_rollups", f"""{SCORED} SELECT CASE WHEN NOT gc THEN 'category' WHEN NOT gd THEN 'difficulty' WHEN NOT gt THEN 'tier' ELSE 'total' END AS dimension,
  coalesce(category, difficulty, tier, '') AS value, total, passed FROM (SELECT category, difficulty, tier, count(*) AS total, count(*) FILTER (WHERE pass) AS passed,
  grouping(category) = 1 AS gc, grouping(difficulty) = 1 AS gd, grouping(tier) = 1 AS gt FROM s GROUP BY GROUPING SETS ((category), (difficulty), (tier), ()))""")
def score_rollups(spark, sf_dir):
    return op.rollups(_score(spark, sf_dir))


@REGISTRY.add("regressions", f"{QS} SELECT DISTINCT category AS model, id FROM questions WHERE toxic = 1 AND quality = 1")
def regressions(spark, sf_dir):
    q = _questions(spark, sf_dir).withColumn("model", F.col("category"))
    history = q.select("model", "id", (F.col("quality") == 1).alias("pass"))
    current = q.select("model", "id", (F.col("toxic") == 0).alias("pass"))
    return op.regressions(history, current)


@REGISTRY.add("redact_detail", f"""{QS} SELECT id, 3 AS agent_count, 3 AS reference_count, CAST(3 - {SHIFT} AS INT) AS overlap,
  sha256(CAST(n_chars % 7 AS VARCHAR) || chr(10) || CAST(n_chars % 7 + 1 AS VARCHAR) || chr(10) || CAST(n_chars % 7 + 2 AS VARCHAR)) AS reference_sha256
FROM questions WHERE id % 11 <> 0""")
def redact_detail(spark, sf_dir):
    return _sets(spark, sf_dir).select("id", op.redact_detail(F.col("values"), F.col("ref")).alias("d")).select("id", "d.*")
