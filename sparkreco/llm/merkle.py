"""Merkle manifests of a table: a hash tree for each group of rows, and one over the groups' roots.

Built bottom-up: rows are numbered within their group, every `fanout` consecutive nodes become one, and each level is written to
shared storage as one row a run, so that a run's nodes are read together. Proofs are pushed top-down: a level's runs join the proofs
that their parents were given, and each node prepends its siblings to them. A parent's proof moves once a run and not once a row.

All steps are DataFrame operations. Numbers within a group come from sorted range partitions and offsets: no group is sorted or
gathered in one task, a run has fanout nodes at most, and a group with a third of all rows is as many runs as it has sixteenths.

Defined cases: a null field hashes as `-`, an empty one as `0:`; a null group is a group of its own and the first; among rows with the
same order column (null first) the leaf decides; repeated rows are leaves of their own; a lone leaf is its group's root and a lone
group's root is the root of all; an empty table has neither leaves nor a root. Other columns, whatever their names, don't matter.
Texts may be as long as a row may be.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkreco.llm.storage import materialize

#: Rows of offsets, of some dozen bytes and a group's name each, up to which they are broadcast.
MOST_OFFSETS = 10000


def digest(*parts: Column) -> Column:
    """Lowercase hex of the SHA-256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(*values: Column) -> Column:
    return digest(*map(field, values))


def proof_text(proof: Column) -> Column:
    """All siblings from the leaf's run up to the root's."""
    return F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), "")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof amount to."""
    return F.aggregate(proof, leaf, lambda node, step: digest(step["left"], node, step["right"]))


def _numbered(rows: DataFrame, name: str) -> DataFrame:
    """rows (group, order, leaf, ...) with i, their number within the group from 0, and n, the group's size."""
    placed = rows.repartitionByRange("group", "order", "leaf").sortWithinPartitions("group", "order", "leaf").withColumn("at", F.monotonically_increasing_id())
    # written: the places are of one run of the sort, whatever is lost later
    placed = materialize(placed, f"{name}-sorted").withColumn("part", F.shiftright("at", 33))
    parts = materialize(placed.groupBy("group", "part").agg(F.min("at").alias("first"), F.count("*").alias("rows")), f"{name}-offsets")
    own = Window.partitionBy("group")
    offsets = parts.select("group", "part", (F.sum("rows").over(own.orderBy("part")) - F.col("rows") - F.col("first")).alias("shift"), F.sum("rows").over(own).alias("n"))
    return placed.join(F.broadcast(offsets) if parts.count() <= MOST_OFFSETS else offsets, ["group", "part"]).withColumn("i", F.col("at") + F.col("shift")).drop("at", "part", "shift")


@dataclass(frozen=True)
class Tree:
    """levels: each a table (group, run, n, nodes), nodes being structs with node and, on the lowest level, carried; n counts the group's nodes
    on this level. roots: (group, root, top), top being the level whose only run has become the root."""

    levels: list[DataFrame]
    roots: DataFrame


def build(rows: DataFrame, fanout: int, name: str) -> Tree:
    """rows: (group string, order, leaf, carried)."""
    nodes = _numbered(rows, name).select("group", "i", "n", F.col("leaf").alias("node"), "carried")
    levels: list[DataFrame] = []
    roots = None
    more = True
    while more:
        own = F.struct("i", "node", *["carried"] * (not levels))
        runs = nodes.groupBy("group", F.expr(f"i div {fanout}").alias("run")).agg(F.first("n").alias("n"), F.array_sort(F.collect_list(own), lambda a, b: (a["i"] - b["i"]).cast("int")).alias("nodes"))
        level = materialize(runs, f"{name}-level")
        joined = F.when(F.col("n") > 1, digest(F.array_join("nodes.node", ""))).otherwise(F.col("nodes")[0]["node"])
        parents = level.select("group", F.col("run").alias("i"), F.ceil(F.col("n") / fanout).alias("n"), joined.alias("node"))
        done = parents.filter("n = 1").select("group", F.col("node").alias("root"), F.lit(len(levels)).alias("top"))
        roots = done if roots is None else roots.unionByName(done)
        levels.append(level)
        nodes = parents.filter("n > 1")
        more = not nodes.isEmpty()
    return Tree(levels, roots)


def proofs(tree: Tree, inherited: DataFrame) -> DataFrame:
    """(group, node, carried, proof, above) of each leaf. inherited: (group, top, proof, above): what a root's nodes get, and what goes with it."""
    given = None
    for k in reversed(range(len(tree.levels))):
        tops = inherited.filter(F.col("top") == k).select("group", F.lit(0).cast("long").alias("run"), "proof", "above")
        parents = tops if given is None else given.unionByName(tops)
        own = tree.levels[k].join(parents, ["group", "run"]).select("group", "n", "proof", "above", F.col("nodes.node").alias("hashes"), F.posexplode("nodes").alias("at", "own"))
        step = F.struct(F.array_join(F.slice("hashes", F.lit(1), F.col("at")), "").alias("left"), F.array_join(F.slice("hashes", F.col("at") + 2, F.size("hashes")), "").alias("right"))
        pushed = F.when(F.col("n") > 1, F.concat(F.array(step), "proof")).otherwise(F.col("proof"))
        # a child's number is its run's number on the level below
        given = own.select("group", F.col("own.i").alias("run"), pushed.alias("proof"), "above", *[F.col(f"own.{c}").alias(c) for c in ["node", "carried"] if k == 0])
    return given.drop("run")


def manifest(docs: DataFrame, fields: list[str], group_col: str = "source", order_col: str = "doc_id", fanout: int = 16, carry: dict[str, Column] | None = None) -> DataFrame:
    """(order_col, leaf, subroot, root, proof array<struct<left, right>>, and the carried columns): a row for each row of docs.

    Groups ascend by the bytes of their names, rows within them by order_col.
    """
    name = F.col(f"`{group_col}`").cast("string")
    others = [F.col(f"`{order_col}`").alias("id"), *[c.alias(n) for n, c in (carry or {}).items()]]
    rows = docs.select(F.when(name.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), name)).alias("group"), F.col(f"`{order_col}`").alias("order"), leaf_hash(*[F.col(f"`{c}`") for c in fields]).alias("leaf"), F.struct(*others).alias("carried"))
    # written before the sort, which reads its input twice: texts are hashed once
    tree = build(materialize(rows, "merkle-leaves"), fanout, "merkle")
    over = build(tree.roots.select(F.lit("").alias("group"), F.col("group").alias("order"), F.col("root").alias("leaf"), F.struct("group", "top").alias("carried")), fanout, "merkle-groups")
    nothing = F.array().cast("array<struct<left:string,right:string>>")
    groups = proofs(over, over.roots.select("group", "top", nothing.alias("proof"), F.col("root").alias("above")))
    inherited = groups.select("carried.group", "carried.top", "proof", F.struct(F.col("node").alias("subroot"), F.col("above").alias("root")).alias("above"))
    found = proofs(tree, inherited)
    return found.select(F.col("carried.id").alias(order_col), F.col("node").alias("leaf"), "above.subroot", "above.root", "proof", *[F.col(f"carried.{n}").alias(n) for n in carry or {}])
