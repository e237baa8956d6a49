"""Chat formatting as prefix trees.

Conversations whose first turns agree share them. Each tree of conversations is emitted once, depth-first: one text for
a tree, in which a shared turn stands once, with a row for each turn (node) that says where it stands, at which position
it starts in a conversation (positions count on from the parent), and which intervals of the tree's text it may attend
to: those of its ancestors and its own. Reading the intervals of a conversation's last turn gives back its formatted
text, exactly.

A turn is ``<|role|>\\n`` + text + ``<|end|>\\n``. Inside roles and texts every ``<|`` and ``|>``, and each of the control
strings of other templates, gets a backslash after its first character, however many follow it already, so escaping is
reversible.

Trees stay small (``tree_conversations`` on average). Opening turns that more conversations share are a large prefix; of
a conversation the longest large prefix counts. Conversations that go on from it with one turn stay in one tree; only the
different next turns are dealt into as many trees as that needs, and the conversations that end with it by id. So turns
are repeated for several trees only as part of a large prefix, whole copies only if there are more than a tree holds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import written

#: Control strings of this template and of common others. Fixed values.
CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<bos>", "<eos>", "<start_of_turn>", "<end_of_turn>")
END = "<|end|>\n"
# a control string with any number of backslashes after its first character
_ESCAPE = re.compile("|".join(re.escape(c[0]) + r"(?=\\*" + re.escape(c[1:]) + ")" for c in CONTROL))
_PLAIN = re.compile("|".join(re.escape(c[0]) + r"\\(?=\\*" + re.escape(c[1:]) + ")" for c in CONTROL))


def escape(text: str) -> str:
    """No control string is left in the result; one more backslash follows its first character."""
    return _ESCAPE.sub(lambda m: m.group() + "\\", text)


def unescape(text: str) -> str:
    return _PLAIN.sub(lambda m: m.group()[:-1], text)


def sql_pattern(control: str) -> str:
    """A pattern for RE2 that matches where escape() adds a backslash for this control string."""
    return re.escape(control[0]) + r"\\*" + re.escape(control[1:])


def head(role: str) -> str:
    return f"<|{escape(role)}|>\n"


def formatted_turn(role: str, text: str) -> str:
    return head(role) + escape(text) + END


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """Turns of a formatted conversation: role, text, and where the escaped text starts and ends."""
    out, at = [], 0
    while at < len(formatted):
        close = formatted.index("|>\n", at + 2)
        end = formatted.index(END, close + 3)
        out.append((unescape(formatted[at + 2 : close]), unescape(formatted[close + 3 : end]), close + 3, end))
        at = end + len(END)
    return out


class _Node:
    __slots__ = ("turn", "below", "ends")

    def __init__(self, turn: tuple[str, str] | None):
        self.turn, self.below, self.ends = turn, {}, []


def build(conversations: list[tuple[int, list[tuple[str, str]]]]) -> tuple[str, list[dict]]:
    """The text of a tree of conversations (id, turns), and its nodes in depth-first order.

    A node: node, parent (-1: none), role, start and stop in the text, position (of its first character within each of
    its conversations), attend (intervals of the text), loss_start and loss_stop (an assistant's escaped text; else
    equal), conv_ids (of conversations that end here).
    """
    top = _Node(None)
    for conv, turns in conversations:
        node = top
        for turn in turns:
            if turn not in node.below:
                node.below[turn] = _Node(turn)
            node = node.below[turn]
        node.ends.append(conv)
    parts, nodes, at = [], [], 0
    todo = [(top, -1, 0, ())]
    while todo:
        node, parent, position, spans = todo.pop()
        number = parent
        if node.turn:
            role, text = node.turn
            piece = formatted_turn(role, text)
            number, start, stop = len(nodes), at, at + len(piece)
            spans = (*spans[:-1], (spans[-1][0], stop)) if spans and spans[-1][1] == start else (*spans, (start, stop))
            a = start + len(head(role)) if role == "assistant" else start
            z = stop - len(END) if role == "assistant" else start
            nodes.append({"node": number, "parent": parent, "role": role, "start": start, "stop": stop, "position": position, "attend": list(spans), "loss_start": a, "loss_stop": z, "conv_ids": node.ends})
            parts.append(piece)
            at, position = stop, position + len(piece)
        todo.extend((x, number, position, spans) for x in reversed(node.below.values()))
    return "".join(parts), nodes


_NODES = "array<struct<node:int,parent:int,role:string,start:long,stop:long,position:long,attend:array<struct<start:long,stop:long>>,loss_start:long,loss_stop:long,conv_ids:array<long>>>"


def format_trees(turns: DataFrame, tree_conversations: int = 256) -> DataFrame:
    """One row for each tree: first (hash of the turns that all its conversations open with), tree (its number among those
    with that), text, nodes. turns: conv_id, turn, role, text.

    Null roles and texts count as empty; turns go by number, null first, rows with one number by role and text; a row with
    a null conv_id belongs to the conversation with that id. Repeated rows are turns of their own. Other columns of turns are
    left out, whatever they are called. An empty table gives an empty result.
    """
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    key = ["_id", "_none"]  # a null id stays apart from all others
    keyed = turns.withColumn("_id", F.coalesce("conv_id", F.lit(0))).withColumn("_none", F.col("conv_id").isNull())
    convs = keyed.groupBy(*key).agg(F.sort_array(F.collect_list(row)).alias("turns"))
    longer = lambda path, t: F.concat(path, F.array(F.xxhash64(F.coalesce(F.get(path, F.size(path) - 1), F.lit(0).cast("long")), t["role"], t["text"])))
    paths = written(convs.select(*key, F.aggregate("turns", F.lit([]).cast("array<long>"), longer).alias("path")), "chat-paths")
    steps = paths.select(*key, F.posexplode("path").alias("depth", "prefix"), "path")
    large = written(steps.groupBy("prefix").count().where(F.col("count") > tree_conversations).select("prefix"), "chat-large")
    # a prefix is larger than those that go on from it, so the deepest large one tells of all
    deepest = steps.select(*key, "depth", "prefix").join(large, "prefix").groupBy(*key).agg(F.max("depth").alias("depth"))
    depth = F.coalesce("depth", F.lit(0))
    after = F.coalesce(F.get("path", depth + 1), F.xxhash64(*key))
    placed = written(paths.join(deepest, key, "left").select(*key, F.get("path", depth).alias("first"), after.alias("after")), "chat-places")
    pools = written(placed.groupBy("first").agg(F.ceil(F.count(F.lit(1)) / tree_conversations).alias("trees")).where("trees > 1"), "chat-pools")
    tree = F.pmod(F.xxhash64("after"), F.coalesce("trees", F.lit(1))).cast("long")
    dealt = convs.join(placed.join(pools, "first", "left").select(*key, "first", tree.alias("tree")), key)
    dealt = dealt.select(F.when(~F.col("_none"), F.col("_id")).alias("conv_id"), "turns", "first", "tree")

    def run(group: pa.Table) -> pa.Table:
        rows = group.sort_by("conv_id").to_pylist()
        text, nodes = build([(r["conv_id"], [(t["role"], t["text"]) for t in r["turns"]]) for r in rows])
        for x in nodes:
            x["attend"] = [{"start": a, "stop": z} for a, z in x["attend"]]
        return pa.Table.from_pydict({"first": [rows[0]["first"]], "tree": [rows[0]["tree"]], "text": [text], "nodes": [nodes]}, schema=_arrow_schema())

    return dealt.groupBy("first", "tree").applyInArrow(run, f"first long, tree long, text string, nodes {_NODES}")


def _arrow_schema() -> pa.Schema:
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    node = pa.struct([("node", pa.int32()), ("parent", pa.int32()), ("role", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("position", pa.int64()), ("attend", span), ("loss_start", pa.int64()), ("loss_stop", pa.int64()), ("conv_ids", pa.list_(pa.int64()))])
    return pa.schema([("first", pa.int64()), ("tree", pa.int64()), ("text", pa.string()), ("nodes", pa.list_(node))])


def read_back(trees: DataFrame) -> DataFrame:
    """One row for each conversation, from the trees alone: conv_id, turns (role, text), loss_text (unescaped), formatted.

    A conversation's formatted text is what its last turn attends to; its turns are parsed from that. No trees give an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        for batch in batches:
            for text, nodes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out: dict[str, list] = {"conv_id": [], "turns": [], "loss_text": [], "formatted": []}
                for x in nodes:
                    if not x["conv_ids"]:
                        continue
                    whole = "".join(text[s["start"] : s["stop"]] for s in x["attend"])
                    lost, up = [], x
                    while up is not None:
                        if up["loss_stop"] > up["loss_start"]:
                            lost.append(unescape(text[up["loss_start"] : up["loss_stop"]]))
                        up = nodes[up["parent"]] if up["parent"] >= 0 else None
                    turns = [{"role": r, "text": t} for r, t, _, _ in parse(whole)]
                    for conv in x["conv_ids"]:
                        out["conv_id"].append(conv), out["turns"].append(turns), out["loss_text"].append("".join(reversed(lost))), out["formatted"].append(whole)
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("conv_id", pa.int64()), ("turns", turn), ("loss_text", pa.string()), ("formatted", pa.string())]))

    return trees.select("text", "nodes").mapInArrow(run, "conv_id long, turns array<struct<role:string,text:string>>, loss_text string, formatted string")
