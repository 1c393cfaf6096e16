"""Trees as intervals against plain walks, and what is read from them."""

import random

from pyspark.sql import functions as F

from loomframe.operators import traces, trees

KEY = ["sample_id"]


def _walk(parents):
    """(node -> depth, enter, last, first leaf, last leaf) of one tree or forest, by a plain walk; nodes in circles left out."""
    kids = {}
    for n, p in parents.items():
        kids.setdefault(p if p in parents else None, []).append(n)
    out, clock, leaves = {}, 0, 0
    stack = [(n, 0, False) for n in sorted(kids.get(None, []), reverse=True)]
    while stack:
        n, depth, done = stack.pop()
        if done:
            out[n] = (*out[n][:2], clock - 1, out[n][2], leaves - 1)
            continue
        out[n] = (depth, clock, leaves)
        clock += 1
        leaves += n not in kids
        stack.append((n, depth, True))
        stack += [(c, depth + 1, False) for c in sorted(kids.get(n, []), reverse=True)]
    return out


def test_intervals_like_a_walk(spark):
    rng = random.Random(5)
    forest = {1: {n: (rng.randrange(n) if n else None) for n in range(120)}, 2: {n: max(n - 1, 0) if n else None for n in range(90)}, 3: {n: 0 if n else None for n in range(80)}, 4: {7: 99, 3: None, 5: 3}, 5: {1: 2, 2: 3, 3: 1, 9: None, 10: 9}}
    rows = [(s, n, p, "x") for s, tree in forest.items() for n, p in tree.items()]
    nodes = spark.createDataFrame(rows, "sample_id long, node_id long, parent_id long, depth string").repartition(3)
    got = {(r["sample_id"], r["node_id"]): (r["depth"], r["enter"], r["last"], r["first_leaf"], r["last_leaf"]) for r in trees.intervals(nodes, KEY).collect()}
    assert got == {(s, n): v for s, tree in forest.items() for n, v in _walk(tree).items()}
    assert trees.intervals(nodes.where("false"), KEY).isEmpty()


def test_long_chain(spark):
    n = 10_000
    nodes = spark.range(n).select(F.lit(0).cast("long").alias("sample_id"), F.col("id").alias("node_id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"), F.lit("a").alias("action_name"))
    spans = trees.kept(trees.intervals(nodes, KEY))
    assert spans.where(f"depth = node_id and enter = node_id and last = {n - 1} and first_leaf = 0 and last_leaf = 0").count() == n
    assert trees.leaf_paths(spans, KEY).count() == n
    marked = trees.nearest_marked(nodes.withColumn("m", F.col("node_id") % 1000 == 10), KEY, "m")
    assert marked.where("nearest <> node_id - (node_id - 10) % 1000").isEmpty() and marked.count() == n - 10


def test_sums_over_subtrees(spark):
    rng = random.Random(6)
    parents = {n: (rng.randrange(n) if n else None) for n in range(60)}
    nodes = spark.createDataFrame([(1, n, p) for n, p in parents.items()], "sample_id long, node_id long, parent_id long")
    values = [(1, rng.randrange(60), k) for k in range(40)]
    got = {r["node_id"]: (r["n_rows"], r["v"]) for r in trees.subtree_sums(trees.kept(trees.intervals(nodes, KEY)), KEY, spark.createDataFrame(values, "sample_id long, node_id long, v long"), ["v"]).collect()}
    want = {n: [0, 0] for n in parents}
    for _, n, v in values:
        while n is not None:
            want[n][0] += 1
            want[n][1] += v
            n = parents[n]
    assert got == {n: tuple(v) for n, v in want.items()}


def test_best_leaf(spark):
    rows = [
        # scores decide, then the rollout, then the walk; nodes that aren't terminal don't count
        (1, 0, None, False, 9, 9, "c", "ok"), (1, 1, 0, True, 5, 0, None, "ok"), (1, 2, 0, True, 5, 1, None, "render_fail"), (1, 3, 0, True, 5, 1, "c", "ok"), (1, 4, 0, True, None, 7, "c", "ok"),
        # no score: the last that has code and is ok
        (2, 0, None, False, None, 0, "c", "ok"), (2, 1, 0, True, None, 0, "c", "ok"), (2, 2, 0, True, None, 0, "c", "render_fail"), (2, 3, 0, True, None, 0, "", "ok"), (2, 4, 0, None, None, 0, "c", "ok"),
        # neither
        (3, 0, None, False, None, 0, None, "ok"), (3, 1, 0, True, None, 0, None, "ok"),
    ]
    nodes = spark.createDataFrame(rows, "sample_id long, node_id long, parent_id long, is_terminal boolean, user_score int, rollout_id int, code string, internal_status string")
    assert {(r["sample_id"], r["node_id"]) for r in traces.best_leaf(nodes).collect()} == {(1, 2), (2, 1)}


def test_status_looks_at_the_action(spark):
    said = [("execute_sql", "found ERROR", "ok"), ("execute_sql", "SQL ERROR: x", "sql_empty"), ("execute_sql", "Query returned 0 rows.", "sql_empty"), ("execute_altair", "an ERROR", "render_fail"), ("execute_altair", "FAILED", "render_fail"), ("execute_altair", "SQL", "ok"), ("ask_user_text", "ERROR", "ok"), ("finish", None, "ok"), (None, "ERROR", "ok")]
    rows = spark.createDataFrame(said, "a string, o string, want string")
    assert rows.where(traces.status_of(F.col("a"), F.col("o")) != F.col("want")).isEmpty()
    assert rows.where(traces.status_of(F.col("a"), F.col("o"), F.lit(True)) != "code_error").isEmpty()
