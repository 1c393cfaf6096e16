"""Trees as intervals: every node gets numbers such that its descendants are a range.

A walk about a tree comes to each node twice, on the way down and on the way up, and is a list of 2 n links. Pointer jumping
ranks it: each element knows the element 2^k further on and sums over the stretch up to it, and a round doubles the stretch
by a self-join in which every element is met once. Rounds are the logarithm of the largest tree's size, and each writes a row
an element, whatever the depth; (node, ancestor) pairs are never made. Children are put in order in range parts, so that a
node with most of the rows as children doesn't sit in one task.

Cases: a node whose parent is missing is a root; roots of a key follow one another by id, as children do. Nodes that are
their own ancestors, which no walk from a root comes to, are left out. Repeated (key, id) rows are an error of the input, for
which nothing is promised. An empty table gives an empty result. Names that begin with two underscores are reserved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import state_path
from .ordered import framed, running

#: Leaves whose numbers one row of a range holds.
BLOCK = 4096


def kept(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read again."""
    path = state_path(df.sparkSession, "tree")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _walk(nodes: DataFrame, key: list[str], node: str, parent: str) -> DataFrame:
    """Elements of the walk: key, __el (twice the node's rank of its id's row, one more on the way up) and __next."""
    ids = nodes.select(*key, F.col(node).cast("long").alias("__id"), F.col(parent).cast("long").alias("__up"))
    known = ids.select(*key, F.col("__id").alias("__up"), F.lit(True).alias("__has"))
    ids = ids.join(known, [*key, "__up"], "left").withColumn("__up", F.when(F.col("__has"), F.col("__up"))).drop("__has")
    # with few children a node the window of a parent is small; range parts hold for any number
    ordered = kept(framed(ids, [*key, "__up"], ["__id"], 1, 1, {"__after": lambda w: F.lead("__id").over(w), "__before": lambda w: F.lag("__id").over(w)}))
    first = ordered.where("__before is null and __up is not null").select(*key, F.col("__up").alias("__id"), F.col("__id").alias("__child"))
    ordered = ordered.join(first, [*key, "__id"], "left")
    down, up = F.col("__id") * 2, F.col("__id") * 2 + 1
    steps = F.array(
        F.struct(down.alias("__el"), F.coalesce(F.col("__child") * 2, up).alias("__next"), F.lit(1).alias("__downs"), F.lit(1).alias("__net"), F.col("__child").isNull().cast("int").alias("__leaves")),
        F.struct(up.alias("__el"), F.coalesce(F.col("__after") * 2, F.col("__up") * 2 + 1).alias("__next"), F.lit(0).alias("__downs"), F.lit(-1).alias("__net"), F.lit(0).alias("__leaves")),
    )
    return ordered.select(*key, F.inline(steps))


def intervals(nodes: DataFrame, key: list[str], node: str = "node_id", parent: str = "parent_id") -> DataFrame:
    """key, node, depth, enter, last, first_leaf and last_leaf: nodes are numbered from 0 in the order of the walk, and a
    node's descendants, itself included, have the numbers from enter to last; leaves are numbered likewise."""
    sums = ["__downs", "__net", "__leaves"]
    now = kept(_walk(nodes, key, node, parent).withColumns({c: F.col(c).cast("long") for c in sums}))
    left = -1
    while True:
        open_ = now.where("__next is not null").count()
        # each round ends the elements near an end; without progress the rest go round in circles
        if open_ in (0, left):
            break
        left = open_
        far = now.select(*key, F.col("__el").alias("__next"), F.col("__next").alias("__far"), *(F.col(c).alias(f"{c}_2") for c in sums))
        going, ended = now.where("__next is not null"), now.where("__next is null")
        jumped = going.join(far, [*key, "__next"]).select(*key, "__el", F.col("__far").alias("__next"), *((F.col(c) + F.col(f"{c}_2")).alias(c) for c in sums))
        now = kept(jumped.union(ended))
    # sums run from the element to the end of the walk; what came before is the key's total less these
    done = now.where("__next is null")
    is_down, id_ = F.col("__el") % 2 == 0, F.floor(F.col("__el") / 2).cast("long")
    sides = done.groupBy(*key, id_.alias("__id")).agg(
        *(F.max(F.when(is_down, F.col(c))).alias(f"{c}_in") for c in sums), *(F.max(F.when(~is_down, F.col(c))).alias(f"{c}_out") for c in sums)
    )
    totals = sides.groupBy(*key).agg(F.max("__downs_in").alias("__all"), F.max("__leaves_in").alias("__all_leaves"))
    rows = sides.join(totals, key) if key else sides.crossJoin(F.broadcast(totals))
    enter = F.col("__all") - F.col("__downs_in")
    first_leaf = F.col("__all_leaves") - F.col("__leaves_in")
    return rows.select(
        *key, F.col("__id").alias(node), (-F.col("__net_in")).cast("int").alias("depth"), enter.alias("enter"), (F.col("__all") - F.col("__downs_out") - 1).alias("last"),
        first_leaf.alias("first_leaf"), (F.col("__all_leaves") - F.col("__leaves_out") - 1).alias("last_leaf"),
    )


def subtree_sums(spans: DataFrame, key: list[str], values: DataFrame, sums: list[str], node: str = "node_id") -> DataFrame:
    """key, node and, for each column of values (key, node, sums), its sum over the node's subtree; rows are counted as
    n_rows. A subtree is a range, so its sum is a difference of two running sums."""
    own = values.groupBy(*key, node).agg(F.count("*").alias("n_rows"), *(F.sum(c).alias(c) for c in sums))
    names = ["n_rows", *sums]
    rows = spans.select(*key, node, "enter", "last").join(own, [*key, node], "left").fillna(0, names)
    upto = kept(running(rows, key, ["enter"], {f"__upto_{c}": F.col(c) for c in names}))
    ends = upto.select(*key, F.col("enter").alias("last"), *(F.col(f"__upto_{c}").alias(f"__end_{c}") for c in names))
    return upto.join(ends, [*key, "last"]).select(*key, node, *((F.col(f"__end_{c}") - F.col(f"__upto_{c}") + F.col(c)).alias(c) for c in names))


def leaf_paths(spans: DataFrame, key: list[str], node: str = "node_id") -> DataFrame:
    """key, leaf (its number), node and depth of every node on the way to every leaf: what a table of paths holds anyway.
    A node's leaves are a range, which is opened in blocks."""
    some = spans.where("first_leaf <= last_leaf")
    blocks = some.withColumn("__b", F.explode(F.sequence(F.floor(F.col("first_leaf") / BLOCK), F.floor(F.col("last_leaf") / BLOCK))))
    part = F.sequence(F.greatest("first_leaf", F.col("__b") * BLOCK), F.least("last_leaf", F.col("__b") * BLOCK + BLOCK - 1))
    return blocks.withColumn("leaf", F.explode(part)).select(*key, "leaf", node, "depth")


def nearest_marked(nodes: DataFrame, key: list[str], marked: str, node: str = "node_id", parent: str = "parent_id") -> DataFrame:
    """key, node and nearest: the closest node on the way to the root, itself included, for which the boolean column holds;
    nodes without one are left out. Pointers jump over nodes that aren't marked, twice as far each round."""
    up = F.when(F.coalesce(F.col(marked), F.lit(False)), F.col(node)).otherwise(F.col(parent)).cast("long")
    now = kept(nodes.select(*key, F.col(node).cast("long").alias(node), up.alias("__to"), F.coalesce(F.col(marked), F.lit(False)).alias("__done")))
    left = -1
    while True:
        open_ = now.where("not __done").count()
        if open_ in (0, left):
            break
        left = open_
        # a pointer to a node of many others' is one row here, and a skewed side of a plain join there
        far = now.select(*key, F.col(node).alias("__to"), F.col("__to").alias("__far"), F.col("__done").alias("__far_done"))
        going = now.where("not __done").join(far, [*key, "__to"]).select(*key, node, F.col("__far").alias("__to"), F.col("__far_done").alias("__done"))
        now = kept(now.where("__done").union(going.where("__to is not null")))
    return now.where("__done").select(*key, node, F.col("__to").alias("nearest"))
