"""The normal form of JSON answers against a plain recursive one."""

import json
import random

from pyspark.sql import functions as F

from netfabric.operators import scoring as sc

SCALARS = [0, 1, -7, 2.5, 1.0, 1e20, 0.1, True, False, None, "", "1", "a", "é\n", 'q"{[', "back\\", "10", 10]


def plain(value):
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if isinstance(value, list):
        items = [plain(v) for v in value]
        if any(isinstance(v, (dict, list)) for v in items):
            return items
        return sorted(items, key=lambda v: (v is None, str(v)))
    if isinstance(value, bool) or isinstance(value, float) and value.is_integer():
        return int(value)
    return value


def made(rng, depth):
    kind = rng.random()
    if depth == 0 or kind < 0.2:
        return rng.choice(SCALARS)
    if kind < 0.6:
        return {rng.choice(["a", "b", "", "a.b", "[0]", "1:a", 'k"']): made(rng, depth - 1) for _ in range(rng.randint(0, 3))}
    return [made(rng, depth - 1 if rng.random() < 0.6 else 0) for _ in range(rng.randint(0, 4))]


def shuffled(rng, value):
    if isinstance(value, dict):
        return {k: shuffled(rng, value[k]) for k in rng.sample(list(value), len(value))}
    if isinstance(value, list):
        items = [shuffled(rng, v) for v in value]
        return rng.sample(items, len(items)) if rng.random() < 0.6 else items
    return int(value) if value is True and rng.random() < 0.5 else value


def same(spark, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "id int, a string, b string")
    out = df.select("id", sc.match_json(F.col("a"), F.col("b")).alias("ok"))
    assert "Python" not in out._jdf.queryExecution().toString()
    return [r.ok for r in out.orderBy("id").collect()]


def test_normal_form_equals_the_recursive_one(spark):
    rng = random.Random(5)
    docs = [made(rng, rng.randint(0, 6)) for _ in range(400)]
    pairs = [(d, shuffled(rng, d)) for d in docs] + [(d, made(rng, 2)) for d in docs]
    want = [plain(json.loads(json.dumps(a))) == plain(json.loads(json.dumps(b))) for a, b in pairs]
    assert 100 < sum(want) < 700
    assert same(spark, [(json.dumps(a), json.dumps(b)) for a, b in pairs]) == want


def test_normal_form_of_odd_texts(spark):
    deep = "[" * 200 + "]" * 200
    long = json.dumps(['x"' * 100_000])
    pairs = [
        (deep, deep, True), (deep, "[" * 199 + "]" * 199, False), (long, long, True), ("", "", False), (None, "{}", False), ("{}", None, False),
        ("{} x", "{} x", False), ("1,2", "1,2", False), ("1],[2", "1],[2", False), ("1.50", "15e-1", True), ("100", "1e2", True), ("-0.0", "0", True), ("{}", "[]", False), ('""', "null", False),
        ("9007199254740993", "9007199254740992", False), ('{"a":{}}', '{"a":[]}', False), ("[[2,1]]", "[[1,2]]", True), ("[[1],[2]]", "[[2],[1]]", False),
    ]
    assert same(spark, [p[:2] for p in pairs]) == [p[2] for p in pairs]


def test_score_has_no_python_in_its_plan(spark):
    q = spark.createDataFrame(
        [(1, "t", "c", "d", ["x"], "expected_json", "", 0, 0.0, 0.0, '{"a":[1,2]}')],
        "id int, tier string, category string, difficulty string, required_tools array<string>, ptype string, match string, min_overlap int, "
        "tolerance double, tolerance_pct double, expected string")
    answers = spark.createDataFrame(
        [(1, '{"a":[2,1.0]}', [], None, None)], "id int, answer string, values array<string>, number double, error string")
    scored = sc.score(q, answers, spark.createDataFrame([], "id int, value string"), spark.createDataFrame([(1, ["x"])], "id int, tools array<string>"))
    assert [r["pass"] for r in scored.collect()] == [True]
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "pandas" not in plan.lower()
