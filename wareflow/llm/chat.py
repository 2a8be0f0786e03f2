"""Chat formatting into prefix trees.

Conversations that share initial turns share their nodes: the formatted text of a shared turn is written
once, depth first, with the position it has in every conversation that goes through it and the intervals
of its ancestors, which are all that it may attend to. Conversations are put into the order of their turns with a
range partitioning, so that those which share turns are neighbours, and trees are built by one pass over each
partition that holds only the path of the last conversation and the tree at hand.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, written

START, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Control strings of common templates. Inside texts each gets ESCAPE after its first character.
CONTROL = [START, MIDDLE, END, "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<unk>", "<pad>"]
ESCAPE = "␛"
_CONTROL = re.compile("|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL))
_TURN = re.compile(re.escape(START) + "(.*?)" + re.escape(MIDDLE) + "(.*?)" + re.escape(END), re.S)
#: Characters of text after which a tree is closed; its shared turns are written again in the next one.
TREE_CHARS = 1 << 16
#: Turns whose hashes order the conversations.
ORDER_TURNS = 64
LOSS_ROLE = "assistant"


def escape(text: str) -> str:
    """Text without control strings; ``unescape`` gives it back."""
    return _CONTROL.sub(lambda m: m[0] + ESCAPE, text.replace(ESCAPE, ESCAPE * 2))


def unescape(text: str) -> str:
    return re.sub(f"{ESCAPE}({ESCAPE}?)", r"\1", text)


def turn_text(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and where its text starts and ends in it."""
    head, body = f"{START}{escape(role)}{MIDDLE}", escape(text)
    return head + body + END, len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


class Tree:
    """A tree under construction, with the path of the conversation that came last."""

    def __init__(self):
        self.text: list[str] = []
        self.size = 0
        self.nodes: list[dict] = []
        self.leaves: list[dict] = []
        self.path: list[tuple[tuple[str, str], int]] = []

    def add(self, conv_id: int | None, turns: list[tuple[str, str]]) -> None:
        shared = 0
        while shared < min(len(self.path), len(turns)) and self.path[shared][0] == turns[shared]:
            shared += 1
        del self.path[shared:]
        for turn in turns[shared:]:
            parent = self.path[-1][1] if self.path else -1
            formatted, a, b = turn_text(*turn)
            up = self.nodes[parent] if parent >= 0 else None
            # Ancestors of a chain lie side by side, so their intervals join.
            seen = [dict(x) for x in up["sees"]] if up else []
            if up:
                if seen and seen[-1]["end"] == up["first"]:
                    seen[-1]["end"] = up["end"]
                else:
                    seen.append({"first": up["first"], "end": up["end"]})
            node = {"first": self.size, "end": self.size + len(formatted), "parent": parent, "position": up["position"] + up["end"] - up["first"] if up else 0, "sees": seen, "loss": [{"first": self.size + a, "end": self.size + b}] if turn[0] == LOSS_ROLE else []}
            self.path.append((turn, len(self.nodes)))
            self.nodes.append(node)
            self.text.append(formatted)
            self.size += len(formatted)
        self.leaves.append({"conv_id": conv_id, "node": self.path[-1][1] if self.path else -1})

    def shares(self, turns: list[tuple[str, str]]) -> bool:
        return bool(self.path) and bool(turns) and self.path[0][0] == turns[0]

    def row(self) -> dict:
        return {"text": "".join(self.text), "nodes": self.nodes, "leaves": self.leaves}


_SPAN = "struct<first: int, end: int>"
SCHEMA = f"text string, nodes array<struct<first: int, end: int, parent: int, position: int, sees: array<{_SPAN}>, loss: array<{_SPAN}>>>, leaves array<struct<conv_id: long, node: int>>"


def _arrow() -> pa.Schema:
    span = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
    node = pa.struct([("first", pa.int32()), ("end", pa.int32()), ("parent", pa.int32()), ("position", pa.int32()), ("sees", span), ("loss", span)])
    return pa.schema([("text", pa.string()), ("nodes", pa.list_(node)), ("leaves", pa.list_(pa.struct([("conv_id", pa.int64()), ("node", pa.int32())])))])


def build_trees(conversations: DataFrame, tree_chars: int = TREE_CHARS) -> DataFrame:
    """Packed prefix trees of ``conversations`` (conv_id, turn, role, text).

    One row per tree: ``text``; ``nodes``, each with its interval in text, its parent, the position id of its first
    character (character i of a node has position + i), the intervals of its ancestors (sees) and of the text under the loss
    mask; ``leaves``, the node at which each conversation ends. Positions count characters.

    Turns are ordered by turn, ties by role and text; null turns come first, null roles and texts are empty. Rows with a null
    conv_id form one conversation. A repeated row is a turn of its own. Equal conversations share all their nodes. A tree closes when
    it has ``tree_chars`` characters or the first turn changes; the next one writes the turns it shares again, so
    that neither trees nor tasks grow with the number of conversations behind one first turn. Further columns are ignored.
    """
    ready(conversations.sparkSession)
    empty = F.lit("")
    turn = F.struct(F.col("turn"), F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    grouped = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    grouped = written(grouped.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns")))
    order = F.transform(F.slice("turns", 1, ORDER_TURNS), lambda t: F.xxhash64(t["role"], t["text"]))
    ordered = grouped.withColumn("order", order).repartitionByRange("order", "conv_id").sortWithinPartitions("order", "conv_id").drop("order")
    schema = _arrow()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, done, size = Tree(), [], 0
        for batch in batches:
            ids, turns = batch.column("conv_id"), batch.column("turns")
            for k in range(batch.num_rows):
                conv = [(t["role"], t["text"]) for t in turns[k].as_py()]
                if tree.leaves and (tree.size >= tree_chars or not tree.shares(conv)):
                    done.append(tree.row())
                    size += tree.size
                    tree = Tree()
                    if size >= 1 << 20:
                        yield pa.RecordBatch.from_pylist(done, schema)
                        done, size = [], 0
                tree.add(ids[k].as_py(), conv)
        if tree.leaves:
            done.append(tree.row())
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)

    return ordered.mapInArrow(run, SCHEMA)


def read_back(trees: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_texts, roles, texts): every conversation out of its tree.

    The text of a conversation is what its leaf sees, and the leaf itself; ``loss_texts`` are the unescaped texts under its loss mask.
    """
    ready(trees.sparkSession)
    schema = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("loss_texts", pa.list_(pa.string())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                text, nodes = batch.column("text")[k].as_py(), batch.column("nodes")[k].as_py()
                out, size = [], 0
                for leaf in batch.column("leaves")[k].as_py():
                    parts, loss, at = "", [], leaf["node"]
                    if at >= 0:
                        own = nodes[at]
                        parts = "".join(text[s["first"] : s["end"]] for s in [*own["sees"], own])
                    while at >= 0:
                        loss += [unescape(text[s["first"] : s["end"]]) for s in reversed(nodes[at]["loss"])]
                        at = nodes[at]["parent"]
                    turns = parse(parts)
                    out.append({"conv_id": leaf["conv_id"], "formatted": parts, "loss_texts": loss[::-1], "roles": [r for r, _ in turns], "texts": [t for _, t in turns]})
                    size += len(parts)
                    if size >= 4 << 20:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema)

    return trees.mapInArrow(run, "conv_id long, formatted string, loss_texts array<string>, roles array<string>, texts array<string>")


def report(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the trees."""
    back = read_back(written(build_trees(conversations)))
    turns = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit("\n"), t, F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return back.select(
        "conv_id",
        F.size("roles").cast("long").alias("n_turns"),
        sha(turns).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        sha(loss).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
