"""The prefix trie of conversations: one row for each distinct opening of turns.

Each conversation's turns are scanned once, in order: numpy gives every prefix a polynomial rolling fingerprint, the sum of
turn hashes times powers of an odd base, modulo 2^64. Prefixes with one depth and fingerprint are candidates for a node. Each
is verified turn by turn: the last turn of every member, its role and text themselves, and the node of the prefix before are
held against those of the representative, the member with the smallest conv_id; what differs is split off. Since the prefix
before has been verified in the same way, equal nodes have equal turns throughout. A split changes the nodes below it, so
rounds go on until none is new; without collisions the first round is the last.

Then figures go up to the parents. A node stands with its representative; the nodes that one conversation represents are the
end of its own path. So what is summed over a node's subtree is the sum over its members of what each represents there: all
that it represents, or, for the node's representative, what it represents from that depth on. That takes one grouping, without
going level by level and without pairs of nodes and ancestors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.llm.common import dropped, text_of, written

#: An odd base of the fingerprints, so that its powers have inverses modulo 2^64.
BASE = 0x9E3779B97F4A7C15
#: Conversations share turns within families of so many consecutive ids; how many turns the first of a family lends, less than.
FAMILY, LENT = 5, 9
#: Ids of conversations that end at one node are put together for ranges of so many ids before they meet.
ENDS = 4096

_NODE = ["depth", "fp", "part"]
c = F.col


def ordered(turns: DataFrame) -> DataFrame:
    """conv_id, i (from 1), role, text of turns, by number (null first), then role and text; null role and text are empty.

    Rows without a conv_id belong to no conversation and are left out.
    """
    rows = turns.where(c("conv_id").isNotNull()).select(c("conv_id").cast("long").alias("conv_id"), "turn", text_of("role").alias("role"), text_of("text").alias("text"))
    return rows.withColumn("i", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))).drop("turn")


def regrown(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on the first of their family: conv_id, lent (0 or 1), i, role, text; and all conv_ids.

    Conversation c opens with the first h turns of conversation c - c % FAMILY, h = crc32(c) % LENT, then has its own turns
    after its first h.
    """
    head = F.crc32(c("conv_id").cast("string")) % LENT
    ids = rows.select("conv_id").distinct()
    own = rows.where(c("i") > head).select("conv_id", F.lit(1).alias("lent"), "i", "role", "text")
    first = rows.where((F.pmod("conv_id", F.lit(FAMILY)) == 0) & (c("i") < LENT))
    lent = first.withColumn("conv_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(FAMILY - 1)), lambda k: c("conv_id") + k)))
    lent = lent.where(c("i") <= head).select("conv_id", F.lit(0).alias("lent"), "i", "role", "text")
    return lent.join(ids, "conv_id", "left_semi").unionByName(own), ids


def scan(convs: np.ndarray, hashes: np.ndarray, before: tuple[int | None, int, int] = (None, 0, 0)) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[int | None, int, int]]:
    """Depths and fingerprints of the prefixes that turns end, the fingerprints one turn before, and the state to go on with.

    convs: ids, equal ones together; hashes: of the turns, uint64. before: the conversation, depth and fingerprint that the
    turns before ended with. The fingerprint of turns h1..hd is h1 * BASE^(d-1) + ... + hd.
    """
    n = len(convs)
    new = np.concatenate([[convs[0] != before[0]], convs[1:] != convs[:-1]])
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    going_on = first == 0 if not new[0] else np.zeros(n, bool)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(n + 1, BASE, np.uint64)) * np.uint64(pow(BASE, -1, 1 << 64))  # BASE^0, BASE^1, ...
        inverse = np.cumprod(np.full(n, pow(BASE, -1, 1 << 64), np.uint64)) * np.uint64(BASE)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(hashes * inverse)])
        place = np.arange(n)
        fp = (sums[1:] - sums[first]) * powers[place]
        fp = fp + np.where(going_on, powers[place + 1] * np.uint64(before[2]), np.uint64(0))
    up = np.where(new, np.uint64(0), np.concatenate([[np.uint64(before[2])], fp[:-1]]))
    depth = place - first + 1 + np.where(going_on, before[1], 0)
    return depth, fp, up, (int(convs[-1]), int(depth[-1]), int(fp[-1]))


def prefixes(rows: DataFrame, bits: int = 64) -> DataFrame:
    """conv_id, depth, fp, up (the fingerprint one turn before), role, text for each prefix of each conversation.

    rows: conv_id, lent, i, role, text. bits: of the fingerprints that are kept, fewer only to test collisions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: tuple[int | None, int, int] = (None, 0, 0)
        mask = np.uint64((1 << bits) - 1)
        for b in batches:
            if not b.num_rows:
                continue
            depth, fp, up, state = scan(b.column("conv_id").to_numpy(), b.column("h").to_numpy().view(np.uint64), state)
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array(depth, pa.int64()), pa.array((fp & mask).view(np.int64)), pa.array((up & mask).view(np.int64)), b.column("role"), b.column("text")], names=["conv_id", "depth", "fp", "up", "role", "text"])

    n = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    hashed = rows.withColumn("h", F.xxhash64("role", "text")).repartition(int(n), "conv_id").sortWithinPartitions("conv_id", "lent", "i")
    return hashed.select("conv_id", "h", "role", "text").mapInArrow(run, "conv_id long, depth long, fp long, up long, role string, text string")


def _variants(rows: DataFrame) -> DataFrame:
    """What the members of each candidate end in: a row for each different parent, role and text, with the smallest member."""
    found = rows.groupBy("depth", "fp", "up", "up_part", "role", "text").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
    number = F.row_number().over(Window.partitionBy("depth", "fp").orderBy("conv_id", "up_part")) - 1
    return found.withColumn("part", number.cast("int"))


def verified(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of prefixes() with part (and up_part, of the parent), which tells apart what shares a fingerprint but not all turns;
    and the nodes: depth, fp, part, up, up_part, conv_id (of the representative), n_convs, bytes (of the last text)."""
    rows = written(rows.withColumns({"part": F.lit(0), "up_part": F.lit(0)}), "trie-prefixes")
    told = None
    while True:
        slim = _variants(rows).select(*_NODE, "up", "up_part", "conv_id", "n_convs", F.octet_length("text").cast("long").alias("bytes"), F.when(c("part") > 0, F.struct("role", "text")).alias("turn"))
        nodes = written(slim, "trie-nodes")
        split = nodes.where("part > 0")
        now = split.count()
        if now == (told or 0):
            return rows, nodes
        told = now
        # members that equal the representative keep part 0; the others find theirs by the turn itself
        theirs = split.select("depth", "fp", "up", "up_part", c("turn.role").alias("role"), c("turn.text").alias("text"), c("part").alias("_part"))
        keys = ["depth", "fp", "up", "up_part", "role", "text"]
        parted = rows.drop("part").join(theirs, keys, "left").withColumn("part", F.coalesce("_part", F.lit(0))).drop("_part")
        path = Window.partitionBy("conv_id").orderBy("depth")
        before = rows
        rows = written(parted.withColumn("up_part", F.coalesce(F.lag("part").over(path), F.lit(0))), "trie-prefixes")
        dropped(before), dropped(nodes)


def _ends(rows: DataFrame) -> DataFrame:
    """Node and SHA-256 of the conv_ids (comma-joined, ascending) that end there, put together range by range."""
    path = Window.partitionBy("conv_id").orderBy(c("depth").desc())
    last = rows.select("conv_id", *_NODE).withColumn("_r", F.row_number().over(path)).where("_r = 1")
    parts = last.withColumn("_range", F.floor(c("conv_id") / ENDS)).groupBy(*_NODE, "_range").agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    return _hashed(parts)


def _hashed(parts: DataFrame) -> DataFrame:
    """One row for each node: ends_sha256 of its parts in order. A node's parts pass one by one, and only a hash is kept of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        done = lambda nodes, shas: pa.RecordBatch.from_arrays([pa.array([x[0] for x in nodes], pa.int64()), pa.array([x[1] for x in nodes], pa.int64()), pa.array([x[2] for x in nodes], pa.int32()), pa.array(shas, pa.string())], names=[*_NODE, "ends_sha256"])
        for b in batches:
            nodes, shas = [], []
            for *at, ids in zip(*(b.column(x).to_pylist() for x in (*_NODE, "ids"))):
                if at == node:
                    sha.update(b",")
                else:
                    if node is not None:
                        nodes.append(node), shas.append(sha.hexdigest())
                    node, sha = at, hashlib.sha256()
                sha.update(ids.encode())
            yield done(nodes, shas)
        if node is not None:
            yield done([node], [sha.hexdigest()])

    n = parts.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return parts.repartition(int(n), *_NODE).sortWithinPartitions(*_NODE, "_range").select(*_NODE, "ids").mapInArrow(run, "depth long, fp long, part int, ends_sha256 string")


def trie(turns: DataFrame, bits: int = 64) -> DataFrame:
    """One row for each node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: conv_id, turn, role, text; conversations are rebuilt as regrown() says. n_leaves: childless nodes of the subtree;
    saved_tokens: over the subtree, bytes of a node's last text times its members but one; ends_sha256: of the ids of the
    conversations that end there. The root (depth 0) has all conversations, and those without turns end there.

    Null roles and texts are empty; turns go by number, null first, rows with one number by role and text, so equal rows are
    turns of their own; rows without a conv_id are left out. Other columns play no part. Long texts go along to the node they
    end. An empty table gives an empty result.
    """
    given = written(ordered(turns), "trie-turns")
    rebuilt, ids = regrown(given)
    rows, nodes = verified(prefixes(rebuilt, bits))
    weight = (c("n_convs") - 1) * c("bytes")
    below = nodes.where("depth > 1").groupBy((c("depth") - 1).alias("depth"), c("up").alias("fp"), c("up_part").alias("part")).agg(F.count(F.lit(1)).alias("n_children"))
    path = Window.partitionBy("conv_id").orderBy("depth")
    nodes = nodes.join(below, _NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = nodes.withColumns({"_from": F.sum(weight).over(path.rowsBetween(0, Window.unboundedFollowing)), "_all": F.sum(weight).over(Window.partitionBy("conv_id")), "_own": F.lag("conv_id").over(path)})
    nodes = written(nodes.select(*_NODE, "up", "up_part", "conv_id", "n_convs", "n_children", "_from", "_all", "_own"), "trie-nodes")
    told = nodes.groupBy("conv_id").agg(F.first("_all").alias("_saved"), F.count_if(c("n_children") == 0).alias("_leaf"))
    sums = rows.join(told, "conv_id").groupBy(*_NODE).agg(F.sum("_saved").alias("_saved"), F.sum("_leaf").alias("n_leaves"))
    # the parent is represented by the same conversation, but for the first node of each
    heads = nodes.where("_own is null and depth > 1").select(*_NODE, (c("depth") - 1).alias("_d"), "up", "up_part")
    parents = nodes.select(c("depth").alias("_d"), c("fp").alias("up"), c("part").alias("up_part"), c("conv_id").alias("_head"))
    heads = heads.join(parents, ["_d", "up", "up_part"]).select(*_NODE, "_head")
    ends = written(_ends(rows), "trie-ends")
    over = ids.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).first()
    nothing = hashlib.sha256().hexdigest()
    rest = nodes.join(sums, _NODE).join(heads, _NODE, "left").join(ends, _NODE, "left")
    out = rest.select(
        "conv_id", "depth", F.coalesce("_own", "_head", F.lit(over["conv_id"]).cast("long")).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", (c("_saved") - c("_all") + c("_from")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
    )
    return out.unionByName(_root(rows, nodes, ids, nothing))


def _root(rows: DataFrame, nodes: DataFrame, ids: DataFrame, nothing: str) -> DataFrame:
    """The node without turns, if there are conversations."""
    zero = F.lit(0).cast("long")
    none = [zero.alias("depth"), zero.alias("fp"), F.lit(0).alias("part")]
    turnless = ids.join(rows.select("conv_id"), "conv_id", "left_anti")
    parts = turnless.withColumn("_range", F.floor(c("conv_id") / ENDS)).groupBy("_range").agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    sha = _hashed(parts.select(*none, "_range", "ids")).select("ends_sha256").first()
    below = nodes.agg(F.count_if(c("depth") == 1).alias("n_children"), F.count_if(c("n_children") == 0).alias("n_leaves"), F.coalesce(F.sum(F.when(c("_own").isNull(), c("_all"))), zero).alias("saved_tokens")).first()
    all_of = ids.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    leaves = below["n_leaves"] or 1  # a root without children is a leaf itself
    return all_of.select("conv_id", zero.alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", F.lit(below["n_children"]).cast("long").alias("n_children"), F.lit(leaves).cast("long").alias("n_leaves"), F.lit(below["saved_tokens"]).cast("long").alias("saved_tokens"), F.lit(sha[0] if sha else nothing).alias("ends_sha256"))
