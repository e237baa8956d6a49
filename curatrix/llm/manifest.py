"""Merkle manifest of a dataset: radix ranks, a trie of rank digits, proofs and their verification.

Every row is a leaf; the leaves of a source stand by id and are reduced, ``FANOUT`` consecutive nodes to one, until one is
left; those of all sources are reduced to the root in the same way.

A leaf's rank in its source comes from histograms, not from a sort: ids are cut into digits of ``DIGIT_BITS`` bits. Rows that
agree in all but the last digit are a cell; cells are counted, counts added up digit by digit to the top; what stands before a
cell is then the sum of what stands before it among its siblings at each digit. So each ordering is of at most 2^12 siblings.
Only rows with one id are ordered among themselves, by their digest.

The rank in digits of base FANOUT is the leaf's key in a trie whose nodes are prefixes. Longest prefixes are reduced first,
``STEP`` digits at a time: all leaves that agree in the other digits (729 at most) are one small group. Groups are nodes of the
next step, in which there are 729 times fewer, and so on. On the way down each group gets its path to the root, siblings left
and right of each level; a leaf's proof is its path within its group and the group's own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.llm.common import written

FANOUT = 3
#: Levels that one group is reduced by.
STEP = 6
DIGIT_BITS = 12
_LEVELS = -(-64 // DIGIT_BITS) - 1
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
c = F.col


def _told(column: Column) -> Column:
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text), F.lit(":"), text), F.lit("-"))


def leaf(*columns: Column) -> Column:
    """SHA-256 (binary) of the columns in order, each as '-' or its length in bytes, a colon and its value."""
    return F.unhex(F.sha2(F.concat(*[_told(x) for x in columns]), 256))


def _shifted(prefix: Column) -> Column:
    """A prefix without its last digit; -1 stays for null, before all others."""
    return F.when(prefix < 0, F.lit(-1).cast("long")).otherwise(F.shiftrightunsigned(prefix, DIGIT_BITS))


def ranked(rows: DataFrame, group: str, key: str, tie: str) -> DataFrame:
    """rows with rank (from 0, within group, by key, null first, then tie) and total (rows of the group).

    group: not null. key: a long. Rows with one key are one cell, so a task orders as many as there are with one key.
    """
    flipped = c(key).bitwiseXOR(F.lit(-(2**63)))  # in unsigned order
    cell = F.when(c(key).isNull(), F.lit(-1).cast("long")).otherwise(F.shiftrightunsigned(flipped, DIGIT_BITS))
    inside = Window.partitionBy(group, "_cell").orderBy(c(key), c(tie))
    placed = rows.withColumn("_cell", cell)
    levels = [written(placed.groupBy(group, "_cell").agg(F.count(F.lit(1)).alias("_rows")), "rank-cells")]
    for _ in range(1, _LEVELS):
        levels.append(written(levels[-1].groupBy(group, _shifted(c("_cell")).alias("_cell")).agg(F.sum("_rows").alias("_rows")), "rank-cells"))
    before = lambda *by: F.coalesce(F.sum("_rows").over(Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = levels[-1].select(group, "_cell", before(group).alias("_before"), F.sum("_rows").over(Window.partitionBy(group)).alias("total"))
    for level in reversed(levels[:-1]):  # before a cell stands what is before its parent, and its own earlier siblings
        own = level.withColumn("_parent", _shifted(c("_cell")))
        own = own.withColumn("_earlier", before(group, "_parent"))
        offsets = own.join(offsets.withColumnRenamed("_cell", "_parent"), [group, "_parent"]).select(group, "_cell", (c("_before") + c("_earlier")).alias("_before"), "total")
    offsets = written(offsets, "rank-offsets")
    return placed.withColumn("_in", F.row_number().over(inside) - 1).join(offsets, [group, "_cell"]).select(*rows.columns, (c("_before") + c("_in")).cast("long").alias("rank"), "total")


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def reduced(nodes: list[str], levels: int) -> list[list[str]]:
    """nodes and so many levels above them, each FANOUT nodes of a level one of the next."""
    out = [nodes]
    for _ in range(levels):
        last = out[-1]
        out.append([digest(last[i : i + FANOUT]) for i in range(0, len(last), FANOUT)])
    return out


def siblings(tree: list[list[str]], place: int) -> tuple[list[str], list[str]]:
    """What stands left and right of a node and its ancestors in their runs, from the node up to below the top."""
    lefts, rights = [], []
    for level in tree[:-1]:
        first = place - place % FANOUT
        lefts.append("".join(level[first:place]))
        rights.append("".join(level[place + 1 : first + FANOUT]))
        place //= FANOUT
    return lefts, rights


def folded(node: str, lefts: list[str], rights: list[str]) -> str:
    """The root that a node and its path give."""
    for left, right in zip(lefts, rights):
        node = digest([left, node, right])
    return node


def depth_of(total: Column) -> Column:
    """Levels until so many nodes are one."""
    return sum((F.when(total > FANOUT**k, 1).otherwise(0) for k in range(40) if FANOUT**k < 2**63), F.lit(0)).cast("int")


# ---- Steps of the trie: nodes are tree, place, digest, depth (levels that their tree still has above them) ----


def _grouped(nodes: DataFrame, place: Column):
    return nodes.withColumn("_group", place.cast("long")).groupBy("tree", "_group")


def _parent(place: str = "place") -> Column:
    return F.floor(c(place) / FANOUT**STEP)


def _tree_of(group: pa.Table) -> tuple[pa.Table, list[list[str]]]:
    group = group.sort_by("place").combine_chunks()
    return group, reduced(group.column("digest").to_pylist(), min(STEP, group.column("depth")[0].as_py()))


def _up(nodes: DataFrame) -> DataFrame:
    """A node for each group: what its nodes are reduced to."""

    def run(group: pa.Table) -> pa.Table:
        group, tree = _tree_of(group)
        depth = max(0, group.column("depth")[0].as_py() - STEP)
        return pa.table({"tree": group.column("tree").slice(0, 1), "place": group.column("_group").slice(0, 1), "digest": tree[-1], "depth": pa.array([depth], pa.int32())})

    return _grouped(nodes.select("tree", "place", "digest", "depth"), _parent()).applyInArrow(run, "tree string, place long, digest string, depth int")


def _down(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """tree, place, lefts, rights and subroot of nodes, from those of their groups."""

    def run(group: pa.Table, over: pa.Table) -> pa.Table:
        group, tree = _tree_of(group)
        lefts, rights = over.column("lefts")[0].as_py(), over.column("rights")[0].as_py()
        found = [siblings(tree, i) for i in range(group.num_rows)]
        names = pa.list_(pa.string())
        return pa.table({"tree": group.column("tree"), "place": group.column("place"), "lefts": pa.array([a + lefts for a, _ in found], names), "rights": pa.array([b + rights for _, b in found], names), "subroot": pa.repeat(over.column("subroot")[0], group.num_rows)})

    return _grouped(nodes, _parent()).cogroup(_grouped(above, c("place"))).applyInArrow(run, "tree string, place long, lefts array<string>, rights array<string>, subroot string")


def _proven(leaves: DataFrame, above: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, proof_sha256 and folded_root of leaves (nodes with doc_id and changed), from the paths of their groups."""

    def run(group: pa.Table, over: pa.Table) -> pa.Table:
        group, tree = _tree_of(group)
        lefts, rights = over.column("lefts")[0].as_py(), over.column("rights")[0].as_py()
        rest = "".join(a + b for a, b in zip(lefts, rights))
        proofs, roots = [], []
        for i, (own, changed) in enumerate(zip(tree[0], group.column("changed").to_pylist())):
            a, b = siblings(tree, i)
            proofs.append(digest([*(x + y for x, y in zip(a, b)), rest]))
            roots.append(folded(folded(changed or own, a, b), lefts, rights))
        return pa.table({"doc_id": group.column("doc_id"), "leaf": group.column("digest"), "subroot": pa.repeat(over.column("subroot")[0], group.num_rows), "proof_sha256": proofs, "folded_root": roots})

    return _grouped(leaves, _parent()).cogroup(_grouped(above, c("place"))).applyInArrow(run, "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string")


def steps(nodes: DataFrame) -> list[DataFrame]:
    """nodes, and what each step reduces them to; the last has one node for each tree."""
    out = [nodes]
    while (out[-1].agg(F.max("depth")).first()[0] or 0) > 0:
        out.append(written(_up(out[-1]), "manifest-nodes"))
    return out


def _group_paths(stairs: list[DataFrame], top: DataFrame) -> DataFrame:
    """Paths of the groups of the first step, from those of whole trees (place 0)."""
    for nodes in reversed(stairs[1:-1]):
        top = written(_down(nodes, top), "manifest-paths")
    return top


def prove(docs: DataFrame, tampered: dict[str, Column], where: Column | None = None, columns: tuple[str, ...] = COLUMNS, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """One row for each document: doc_id, leaf, subroot (of its source), root, proof_sha256, folded_root, verified.

    proof_sha256: of the siblings of the leaf and its ancestors, level by level up to the root, left to right. folded_root is
    what the row gives with the original siblings after its columns in tampered are changed, where `where` holds; verified
    says whether that is the root. Sources go by their bytes, null first; the table of sources is ordered in one task.

    Columns may hold nulls; a null source is a source of its own. Rows without an id stand first in their source, rows with
    one id by their digest (they meet in one task, as ids are meant to be those of one row). Equal rows are leaves of their
    own. Long texts are hashed where they are and move nowhere. Other columns of docs play no part, whatever they are called.
    An empty table gives an empty result.
    """
    after = leaf(*[tampered.get(x, docs[x]) for x in columns])
    tree = F.coalesce(F.concat(F.lit("s"), docs[source_col].cast("string")), F.lit("n"))  # null before all others
    made = docs.select(docs[id_col].cast("long").alias("doc_id"), tree.alias("tree"), leaf(*[docs[x] for x in columns]).alias("digest"), F.when(F.lit(True) if where is None else where, after).alias("changed"))
    rows = ranked(written(made, "manifest-leaves"), "tree", "doc_id", "digest")
    leaves = written(rows.select("tree", c("rank").alias("place"), "doc_id", F.lower(F.hex("digest")).alias("digest"), F.lower(F.hex("changed")).alias("changed"), depth_of(c("total")).alias("depth")), "manifest-ranked")
    stairs = steps(leaves)
    order = Window.orderBy("tree")
    sources = stairs[-1].select("tree", c("digest").alias("subroot"), (F.row_number().over(order) - 1).cast("long").alias("place"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))
    sources = written(sources, "manifest-sources")
    over = steps(sources.select(F.lit("").alias("tree"), "place", c("subroot").alias("digest"), depth_of(c("n")).alias("depth")))
    root = over[-1].first()
    none = F.array().cast("array<string>")
    whole = over[-1].select("tree", "place", none.alias("lefts"), none.alias("rights"), F.lit("").alias("subroot"))
    ways = _down(over[0], _group_paths(over, whole)).select("place", "lefts", "rights")
    tops = written(sources.join(ways, "place").select("tree", F.lit(0).cast("long").alias("place"), "lefts", "rights", "subroot"), "manifest-tops")
    out = _proven(leaves, _group_paths(stairs, tops)).withColumn("root", F.lit(root["digest"] if root else None).cast("string"))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (c("folded_root") == c("root")).alias("verified"))
