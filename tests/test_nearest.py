"""The nearest candidates against all distances."""

import random

import pytest

import __spark_entry__
from loomframe.operators import candidates

SCHEMA = "question_id long, pos int, chart_category string, chart_type string, dimensions array<string>, measures array<string>, tables_needed array<string>, aggregation string, vis_intent_type string, feature_types array<string>, complexity double"


@pytest.mark.parametrize("k", [1, 4])
def test_nearest_by_brute_force(spark, k):
    rng = random.Random(k)
    some = lambda names, most: rng.sample(names, rng.randint(0, most))
    rows = []
    for q, n, cats in ((1, 60, 8), (2, 25, 1), (3, 3, 3), (4, 1, 1), (5, 40, 40)):
        for p in range(n):
            rows.append((q, p, rng.choice([f"C{rng.randrange(cats)}", f"c{rng.randrange(cats)}", None]), f"t{rng.randrange(30)}", some(["a", "b", "c", "d"], 2), some(["m", "n"], 1), ["t"], rng.choice(["SUM", "sum", "AVG"]), "trend", some(["x", "y"], 2), float(rng.randrange(4))))
        rows += [(q, n + j, *rows[-1][2:]) for j in range(6)]  # one class of many
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    near, looked = candidates.nearest_candidates(df, k)
    got = {}
    for r in near.collect():
        got.setdefault((r.question_id, r.pos), []).append((r.place, round(r.distance, 9), r.other))
    both = {}
    for r in candidates.candidate_distance(df).collect():
        both.setdefault((r.question_id, r.pos_a), []).append((round(r.distance, 9), r.pos_b))
        both.setdefault((r.question_id, r.pos_b), []).append((round(r.distance, 9), r.pos_a))
    assert {x: [(d, o) for _, d, o in sorted(v)] for x, v in got.items()} == {x: sorted(v)[:k] for x, v in both.items()}
    pairs = {r.stage: r.pairs for r in looked.collect()}
    assert pairs.keys() == {"category", "token", "rest"} and sum(pairs.values()) < sum(map(len, both.values()))
    none = candidates.nearest_candidates(df.where("false"), k)
    assert none[0].isEmpty() and sum(r.pairs for r in none[1].collect()) == 0


def test_no_candidates_are_broadcast(spark):
    store = spark._jsparkSession.sharedState().statusStore()
    before = {e.executionId() for e in _executions(store)}
    df = spark.createDataFrame([(q, p, f"C{p % 2}", f"t{p % 3}", ["a"], ["m"], ["t"], "SUM", "trend", ["x"], float(p % 4)) for q in range(3) for p in range(9)], SCHEMA)
    assert candidates.nearest_candidates(df, 2)[0].count() == 54
    plans = [e.physicalPlanDescription() for e in _executions(store) if e.executionId() not in before]
    assert plans and not any("BroadcastExchange" in p for p in plans)


@pytest.mark.parametrize("few", [0, 32, 100])
def test_nearest_of_few_and_by_bounds(spark, few):
    """Questions on either side of the limit, letters in either case, rows without a question."""
    rng = random.Random(few)
    some = lambda names, most: [rng.choice([n, n.upper()]) for n in rng.sample(names, rng.randint(0, most))]
    rows = []
    for q, n in ((1, 60), (2, 32), (3, 33), (4, 1), (5, 2), (None, 5)):
        for p in range(n):
            rows.append((q, p, f"C{p}", f"t{p}", some(["a", "b", "c", "d"], 2), some(["m", "n", "o"], 1), [f"t{p}"], rng.choice(["SUM", "sum"]), "trend", ["x"], 0.0))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    both = {}
    for r in candidates.candidate_distance(df).collect():
        both.setdefault((r.question_id, r.pos_a), []).append((round(r.distance, 9), r.pos_b))
        both.setdefault((r.question_id, r.pos_b), []).append((round(r.distance, 9), r.pos_a))
    near, looked = candidates.nearest_candidates(df, 3, few=few)
    got = {}
    for r in near.collect():
        got.setdefault((r.question_id, r.pos), []).append((r.place, round(r.distance, 9), r.other))
    assert {x: [(d, o) for _, d, o in sorted(v)] for x, v in got.items()} == {x: sorted(v)[:3] for x, v in both.items()}
    pairs = {r.stage: r.pairs for r in looked.collect()}
    assert pairs.keys() == {"category", "token", "rest"} and 0 < sum(pairs.values()) <= sum(map(len, both.values()))


def test_pairs_are_not_written(spark, monkeypatch):
    names, stored = [], candidates._stored
    monkeypatch.setattr(candidates, "_stored", lambda df, name: names.append(name) or stored(df, name))
    df = spark.createDataFrame([(q, p, f"C{p % 2}", f"t{p % 3}", ["a"], ["m"], ["t"], "SUM", "trend", ["x"], float(p % 4)) for q, n in ((1, 9), (2, 40)) for p in range(n)], SCHEMA)
    assert candidates.nearest_candidates(df.where("question_id = 1"), 2)[0].count() == 18
    assert names == ["large"]
    assert candidates.nearest_candidates(df, 2)[0].count() == 98
    assert len(names) > 2 and not any("pairs" in n for n in names)


def test_query_deals_its_rows_once(spark):
    plan = __spark_entry__.queries()["candidate_nearest"](spark, __spark_entry__.SMOKE_DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan


def _executions(store):
    every = store.executionsList()
    return [every.apply(k) for k in range(every.size())]
