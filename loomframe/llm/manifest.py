"""Merkle manifest of a dataset: a tree for each part, a tree over their roots, and a proof for every row.

1. Every row becomes a leaf digest where it is read, so that texts are never shuffled. Leaves are numbered within their part
   in range partitions of (part, id): a part with most of the rows is dealt to many tasks.
2. Nodes are built in blocks of 2^BLOCK_BITS consecutive ones, BLOCK_BITS levels at a time, in arrays; what is left of each
   block goes on to the next pass. Every node below a part's root is written with its level, its place and its sibling.
3. Proofs come by pointer jumping. A node holds the segment of siblings on its way to the ancestor 2^k levels up. A
   self-join on that ancestor appends the ancestor's own segment and doubles the distance, until every leaf reaches the
   root. In round k only nodes on levels that 2^k divides are still asked for, so rounds past the first are small but for the
   leaves. Ancestors are joined by broadcast once they are counted to be at most BROADCAST_NODES; before that there are many
   of them, each with at most 2^k leaves, so no key is large.
4. The roots of the parts are the leaves of the last tree, by the same steps.

Digests are lowercase hex of SHA-256 over concatenated inputs; digests go in as hex text.

Cases: a null field is ``-``, which no other value is written as. A null part is a part of its own and comes first. Rows with
equal or null ids are ordered by their leaf digest, nulls first; rows that repeat are equal leaves, whose order changes
nothing. An empty table gives an empty result. Columns other than those named are not read, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import number_rows
from .common import materialize

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels that one pass builds.
BLOCK_BITS = 8
#: Ancestors that are sent to every task, of 16 digests each at most.
BROADCAST_NODES = 20_000


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value as it goes into a leaf: its length in bytes, a colon and itself, or - for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: dict[str, Column]) -> Column:
    return digest(*(field(values[f]) for f in FIELDS))


def _level(nodes: Column) -> Column:
    """The digests of every two consecutive ones of an array; an odd last one becomes that of itself."""
    runs = F.sequence(F.lit(0), F.ceil(F.size(nodes) / 2).cast("int") - 1)
    return F.transform(runs, lambda i: digest(F.element_at(nodes, 2 * i + 1), F.coalesce(F.try_element_at(nodes, 2 * i + 2), F.lit(""))))


def _with_siblings(level: int, block: Column, nodes: Column, bits: int) -> Column:
    """array<struct<level, pos, hash, sibling>> of a block's nodes, bits levels above the block's first ones."""
    start = F.shiftleft(block, BLOCK_BITS - bits)
    return F.transform(
        nodes, lambda h, i: F.struct(F.lit(level).alias("level"), (start + i).alias("pos"), F.unhex(F.try_element_at(nodes, i + 1 + F.when(i % 2 == 0, 1).otherwise(-1))).alias("sibling"))
    )


def _block_pass(nodes: DataFrame, base: int) -> tuple[DataFrame, DataFrame]:
    """(nodes of levels base to base + BLOCK_BITS - 1 with siblings, nodes of level base + BLOCK_BITS or roots below it) from
    part, pos and hash of all nodes of level base in parts that have more than one, and size, their number."""
    block = F.shiftright("pos", BLOCK_BITS).alias("block")
    blocks = nodes.groupBy("part", "size", block).agg(F.array_sort(F.collect_list(F.struct("pos", "hash"))).alias("rows"))
    rows, now = blocks.withColumn("h0", F.col("rows.hash")), "h0"
    for k in range(1, BLOCK_BITS + 1):
        # a part whose nodes came down to one is done: its root goes no further
        wide = F.col("size") > (1 << (k - 1))
        rows = rows.withColumn(f"h{k}", F.when(wide, _level(F.col(now))))
        now = f"h{k}"
    rows = materialize(rows.drop("rows"), "manifest-blocks")
    below = [F.when(F.col("size") > (1 << k), _with_siblings(base + k, F.col("block"), F.col(f"h{k}"), k)) for k in range(BLOCK_BITS)]
    none = F.expr("cast(array() as array<struct<level:int,pos:bigint,sibling:binary>>)")
    spread = rows.select("part", F.inline(F.concat(*(F.coalesce(b, none) for b in below))))
    height = sum((F.when(F.col("size") > (1 << k), 1).otherwise(0) for k in range(BLOCK_BITS)), F.lit(0))
    last = F.element_at(F.coalesce(*(F.col(f"h{k}") for k in range(BLOCK_BITS, -1, -1))), 1)
    above = rows.select("part", F.col("block").alias("pos"), F.ceil(F.col("size") / (1 << BLOCK_BITS)).cast("long").alias("size"), last.alias("hash"), (F.lit(base) + height).alias("height"))
    return spread, above


def tree(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(part, level, pos, sibling of all nodes below a root; part, root and height) from part, pos, hash and size of leaves:
    their place from 0 on and their number in the part."""
    spread, roots, now, base = [], [leaves.where("size = 1").select("part", F.col("hash").alias("root"), F.lit(0).alias("height"))], leaves.where("size > 1").select("part", "size", "pos", "hash"), 0
    while True:
        nodes, above = _block_pass(now, base)
        spread.append(nodes)
        roots.append(above.where("size = 1").select("part", F.col("hash").alias("root"), "height"))
        now = above.where("size > 1").select("part", "size", "pos", "hash")
        base += BLOCK_BITS
        if now.isEmpty():
            break
    every, tops = spread[0], roots[0]
    for more in spread[1:]:
        every = every.union(more)
    for more in roots[1:]:
        tops = tops.union(more)
    return every, tops


def _jump(rows: DataFrame, ancestors: DataFrame, distance: int, few: bool) -> DataFrame:
    """Rows with part, level, pos and the segment to the ancestor this distance up, with that ancestor's appended."""
    up = ancestors.select(F.col("part").alias("a_part"), F.col("level").alias("a_level"), F.col("pos").alias("a_pos"), F.col("segment").alias("a_segment"))
    test = F.col("part").eqNullSafe(F.col("a_part")) & (F.col("level") + distance == F.col("a_level")) & (F.shiftright("pos", distance) == F.col("a_pos"))
    none = F.expr("cast(array() as array<binary>)")
    joined = rows.join(F.broadcast(up) if few else up, test, "left")
    return joined.withColumn("segment", F.concat("segment", F.coalesce("a_segment", none))).drop("a_part", "a_level", "a_pos", "a_segment")


def proofs(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(part, pos and segment of every leaf; part and root). A segment has a sibling for each level, null where there is
    none; leaves of parts with one leaf have an empty one."""
    nodes, tops = tree(leaves)
    tops = materialize(tops, "manifest-roots")
    nodes = nodes.withColumn("segment", F.array("sibling")).drop("sibling")
    inner = nodes.where("level > 0")
    low, top = nodes.where("level = 0"), tops.agg(F.max("height")).first()[0] or 0
    distance = 1
    while distance < top:
        # ancestors at an odd multiple of the distance are asked for; those at even ones go on with longer segments
        inner = materialize(inner, "manifest-segments")
        asked = inner.where(F.col("level") % (2 * distance) == distance)
        few = asked.count() <= BROADCAST_NODES
        low = _jump(low, asked, distance, few)
        inner = _jump(inner.where(F.col("level") % (2 * distance) == 0), asked, distance, few)
        distance *= 2
    alone = leaves.where("size = 1").select("part", "pos", F.expr("cast(array() as array<binary>)").alias("segment"))
    return low.select("part", "pos", "segment").union(alone), tops.select("part", "root")


def folded(hash: Column, pos: Column, segment: Column) -> Column:
    """The root that a digest at a place leads to by a segment."""
    first = F.struct(hash.alias("h"), pos.alias("pos"))

    def up(acc, sibling):
        other = F.lower(F.hex(sibling))
        h = F.when(sibling.isNull(), digest(acc["h"])).when(acc["pos"] % 2 == 0, digest(acc["h"], other)).otherwise(digest(other, acc["h"]))
        return F.struct(h.alias("h"), F.shiftright(acc["pos"], 1).alias("pos"))

    return F.aggregate(segment, first, up, lambda acc: acc["h"])


def manifest(docs: DataFrame, tampered: dict[str, Column] | None = None, id_col: str = "doc_id", part: str = "lang") -> DataFrame:
    """doc_id, leaf, subroot, root, proof (siblings to the root, binary), proof_sha256, folded_root and verified of every row.

    tampered: values in place of columns with which the leaf is computed that the proof is held against."""
    own = {f: F.col(f) for f in FIELDS}
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(part).cast("string").alias("part"), leaf(own).alias("hash"), leaf({**own, **(tampered or {})}).alias("claim"))
    numbered = materialize(number_rows(rows.withColumn("claim", F.when(F.col("claim") != F.col("hash"), F.col("claim"))), ["part"], ["doc_id", "hash"], "pos").withColumn("pos", F.col("pos") - 1), "manifest-leaves")
    sizes = numbered.groupBy("part").agg(F.count("*").alias("size")).withColumnRenamed("part", "s_part")
    leaves = numbered.join(sizes, F.col("part").eqNullSafe(F.col("s_part"))).select("part", "pos", "size", "hash")
    segments, subroots = proofs(leaves)

    # one leaf of the last tree for each part, numbered in the order of bytes
    ranked = number_rows(subroots, [], [F.col("part").cast("binary").asc_nulls_first()], "pos").select(F.col("part").alias("own"), F.lit("").alias("part"), (F.col("pos") - 1).alias("pos"), F.col("root").alias("hash"))
    ranked = materialize(ranked.withColumn("size", F.lit(subroots.count())), "manifest-parts")
    upper, tops = proofs(ranked.drop("own"))
    upper = upper.join(ranked.select("own", "pos", "hash"), "pos").join(tops, "part")
    upper = materialize(upper.select(F.col("own").alias("u_part"), F.col("pos").alias("u_pos"), F.col("segment").alias("u_segment"), F.col("hash").alias("subroot"), "root"), "manifest-upper")

    s = segments.select(F.col("part").alias("s_part"), F.col("pos").alias("s_pos"), "segment")
    joined = numbered.join(s, F.col("part").eqNullSafe(F.col("s_part")) & (F.col("pos") == F.col("s_pos")))
    joined = joined.join(upper, F.col("part").eqNullSafe(F.col("u_part")))
    proof = F.filter(F.concat("segment", "u_segment"), lambda x: x.isNotNull())
    subfold = folded(F.coalesce("claim", "hash"), F.col("pos"), F.col("segment"))
    out = joined.select("doc_id", F.col("hash").alias("leaf"), "subroot", "root", proof.alias("proof"), folded(subfold, F.col("u_pos"), F.col("u_segment")).alias("folded_root"))
    return out.withColumns({"proof_sha256": F.sha2(F.lower(F.array_join(F.transform("proof", F.hex), "")), 256), "verified": F.col("folded_root") == F.col("root")})
