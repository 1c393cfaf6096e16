"""Search traces: trees of actions with parents, visits and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from .trees import intervals, kept, leaf_paths, nearest_marked, subtree_sums

KEY = ["sample_id"]


def trace_depth(nodes: DataFrame) -> DataFrame:
    return intervals(nodes, KEY).select(*KEY, "node_id", "depth")


def leaves(nodes: DataFrame) -> DataFrame:
    inner = nodes.where("parent_id is not null").select(*KEY, F.col("parent_id").alias("node_id")).distinct()
    return nodes.join(inner, [*KEY, "node_id"], "left_anti")


#: How much of an action's text a report shows.
SHOWN_CHARS, SHOWN_LINES = 200, 15


def shown_text(text: Column) -> Column:
    """A text as reports show it: its first lines and characters, with dots where something was cut."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    some = F.array_join(F.slice(lines, 1, SHOWN_LINES), "\n")
    cut = (F.size(lines) > SHOWN_LINES) | (F.length(some) > SHOWN_CHARS)
    return F.concat(F.substring(some, 1, SHOWN_CHARS), F.when(cut, "...").otherwise(""))


def trace_paths(nodes: DataFrame, text: str | None = None) -> DataFrame:
    """The actions from the root to each leaf, and, if a column of texts is named, what they say."""
    spans = kept(intervals(nodes, KEY))
    shown = F.lit("") if text is None else shown_text(F.col(text))
    names = nodes.select(*KEY, "node_id", "action_name", shown.alias("shown"))
    steps = leaf_paths(spans.join(names, [*KEY, "node_id"]).withColumn("named", F.struct("node_id", "action_name", "shown")), KEY, "named")
    out = steps.groupBy(*KEY, "leaf").agg(F.array_sort(F.collect_list(F.struct("depth", "named"))).alias("steps"))
    path = F.array_join(F.transform("steps", lambda x: x["named"]["action_name"]), " > ").alias("path")
    texts = F.array_join(F.transform("steps", lambda x: F.concat(x["named"]["action_name"], F.lit(": "), x["named"]["shown"])), "\n").alias("texts")
    return out.select(*KEY, F.element_at("steps", -1)["named"]["node_id"].alias("node_id"), path, *([] if text is None else [texts]))


def trace_tree(nodes: DataFrame, text: str) -> DataFrame:
    """A line for each node of a tree in the order of a walk from the root, children by their number: line (from 0) and
    what it shows, indented by depth."""
    spans = intervals(nodes, KEY).select(*KEY, "node_id", "depth", F.col("enter").cast("int").alias("line"))
    line = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.lit("["), F.col("node_id").cast("string"), F.lit("] "), F.col("action_name"), F.lit(": "), shown_text(F.col(text)))
    return nodes.join(spans, [*KEY, "node_id"]).select(*KEY, "node_id", "line", line.alias("shown"))


def normalize_reward(data: Column, vis: Column, intent: Column, score: Column) -> dict[str, Column]:
    """Parts kept in 1..10, scaled so that their weighted mean is the score, over ten, in 0..1; a score of 0 gives zeros."""
    keep = lambda c: F.greatest(F.least(c.cast("double"), F.lit(10.0)), F.lit(1.0))
    parts = {"data": keep(data), "vis": keep(vis), "intent": keep(intent)}
    mean = sum((parts[k] * w for k, w in fixed.REWARD_WEIGHTS.items()), F.lit(0.0))
    return {k: F.when(score > 0, F.greatest(F.least(p * score / mean / 10, F.lit(1.0)), F.lit(0.0))).otherwise(0.0) for k, p in parts.items()}


def propagate_rewards(nodes: DataFrame, rewards: DataFrame) -> DataFrame:
    """visits and total of every node that a rewarded node is below: each of these visits all its ancestors and adds the part
    that the ancestor's action earns: SQL the data part, charts the vis part, questions the intent part, others nothing."""
    parts = ["data", "vis", "intent"]
    sums = subtree_sums(kept(intervals(nodes, KEY)), KEY, rewards.select(*KEY, "node_id", *parts), parts).where("n_rows > 0")
    part = F.when(F.col("action_name") == "execute_sql", F.col("data")).when(F.col("action_name") == "execute_altair", F.col("vis")).when(F.col("action_name") == "ask_user_text", F.col("intent")).otherwise(0.0)
    return sums.join(nodes.select(*KEY, "node_id", "action_name"), [*KEY, "node_id"]).select(*KEY, "node_id", F.col("n_rows").alias("visits"), part.alias("total"))


def exploration_score(nodes: DataFrame, c: float = 1.4, alpha: float = 0.5, cap: int = 3) -> DataFrame:
    """Mean reward plus c times the root of ln(parent's visits) over visits; infinite for the unvisited; and how many
    children a node may have."""
    parents = nodes.select(*KEY, F.col("node_id").alias("parent_id"), F.col("visits").alias("parent_visits"))
    joined = nodes.join(parents, [*KEY, "parent_id"], "left")
    explore = c * F.sqrt(F.log(F.greatest(F.coalesce("parent_visits", F.lit(1)), F.lit(1)).cast("double")) / F.col("visits"))
    score = F.when(F.col("visits") == 0, F.lit(float("inf"))).otherwise(F.col("total") / F.col("visits") + explore)
    return joined.withColumns({"score": score, "max_children": F.least(F.ceil(c * F.pow(F.col("visits").cast("double"), F.lit(alpha))), F.lit(cap))}).drop("parent_visits")


def best_leaf(nodes: DataFrame) -> DataFrame:
    """The terminal node with the best user score, of equals that of the latest rollout; without any score the last terminal
    node in the order of the walk that has code and is ok. A tree with neither has none.

    Takes is_terminal, user_score, rollout_id, code and internal_status. Of equals in rollout, too, the first in the walk."""
    ended = nodes.where(F.coalesce("is_terminal", F.lit(False)))
    code = (F.coalesce(F.length("code"), F.lit(0)) > 0) & (F.col("internal_status") == "ok")
    placed = ended.join(intervals(nodes, KEY).select(*KEY, "node_id", "enter"), [*KEY, "node_id"])
    scored = F.when(F.col("user_score").isNotNull(), F.struct("user_score", "rollout_id", -F.col("enter"), "node_id"))
    usable = F.when(code, F.struct("enter", "node_id"))
    best = placed.groupBy(*KEY).agg(F.max(scored).alias("scored"), F.max(usable).alias("usable"))
    chosen = best.select(*KEY, F.coalesce("scored.node_id", "usable.node_id").alias("node_id")).where("node_id is not null")
    return nodes.join(chosen, [*KEY, "node_id"], "left_semi")


def last_valid_code(nodes: DataFrame) -> DataFrame:
    """The code of the nearest node on the way to the root that has some and is ok."""
    good = nodes.withColumn("good", F.col("code").isNotNull() & (F.col("internal_status") == "ok"))
    found = nearest_marked(good, KEY, "good")
    return found.join(nodes.select(*KEY, F.col("node_id").alias("nearest"), "code"), [*KEY, "nearest"]).select(*KEY, "node_id", "code")


def duplicate_actions(nodes: DataFrame) -> DataFrame:
    """Nodes that repeat an earlier sibling's action: SQL and questions trimmed in any case, charts by their first 200
    characters, finish always, others by their arguments as JSON."""
    a = F.col("action_args")
    trimmed = F.lower(F.trim(a))
    same = F.when(F.col("action_name").isin("execute_sql", "ask_user_text"), trimmed).when(F.col("action_name") == "execute_altair", F.substring(a, 1, 200)).when(F.col("action_name") == "finish", F.lit("")).otherwise(F.coalesce(F.to_json(F.try_parse_json(a)), a))
    k = F.row_number().over(Window.partitionBy(*KEY, "parent_id", "action_name", same).orderBy("node_id"))
    return nodes.withColumn("__k", k).where((F.col("__k") > 1) & F.col("parent_id").isNotNull()).drop("__k")


def action_transitions(nodes: DataFrame) -> DataFrame:
    """Counts of parent and child actions, and whether the one may follow the other."""
    parents = nodes.select(*KEY, F.col("node_id").alias("parent_id"), F.col("action_name").alias("parent_action"))
    pairs = nodes.join(parents, [*KEY, "parent_id"]).groupBy("parent_action", "action_name").agg(F.count(F.lit(1)).alias("n"))
    allowed = F.create_map(*(x for a, bs in fixed.ACTION_SUCCESSORS.items() for x in (F.lit(a), F.array(*map(F.lit, bs)).cast("array<string>"))))
    return pairs.withColumn("allowed", F.coalesce(F.array_contains(F.try_element_at(allowed, F.col("parent_action")), F.col("action_name")), F.lit(False)))


def token_usage(runs: DataFrame) -> DataFrame:
    """Tokens and questions over all runs. A run that lacks its total has the sum of its prompt and completion tokens."""
    own = lambda c: F.coalesce(F.col(c), F.lit(0)) if c in runs.columns else F.lit(0)
    total = F.coalesce(F.col("total_tokens"), own("prompt_tokens") + own("completion_tokens")) if "total_tokens" in runs.columns else own("prompt_tokens") + own("completion_tokens")
    return runs.agg(
        F.sum(own("prompt_tokens")).alias("prompt_tokens"), F.sum(own("completion_tokens")).alias("completion_tokens"), F.sum(total).alias("total_tokens"), F.percentile("prompt_tokens", 0.5).alias("median_tokens"),
        F.sum(own("text_questions_asked")).alias("questions"), F.sum(own("vis_questions_asked")).alias("vis_questions"), F.count(F.lit(1)).alias("runs"),
    )


def status_of(action: Column, observation: Column, raised: Column | None = None) -> Column:
    """How an action went. SQL is empty by how its observation begins, a chart fails by a word in it, and other actions are
    ok whatever they say; one that raised an error is a code error."""
    o = F.coalesce(observation, F.lit(""))
    empty = o.startswith("SQL ERROR") | o.startswith("Query returned 0 rows")
    failed = o.contains("FAILED") | o.contains("ERROR")
    status = F.when((action == "execute_sql") & empty, "sql_empty").when((action == "execute_altair") & failed, "render_fail").otherwise("ok")
    return status if raised is None else F.when(F.coalesce(raised, F.lit(False)), "code_error").otherwise(status)
