"""Chat formatting as prefix trees: turns that conversations share at their start are emitted once."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The template's control strings, and what stands before and after a turn's text.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|", "|>")
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("<s>[INST] ", " [/INST]"), "assistant": (" ", " </s>")}
OTHER_END = "<|end|>"
#: Conversations and characters of one tree at most (a longer conversation has a tree of its own).
TREE_CONVERSATIONS, TREE_CHARS = 256, 1 << 20

_CONTROL = re.compile("(?=" + "|".join(map(re.escape, CONTROLS)) + ")(.)")
_TURN = re.compile(
    "(?s:" + "|".join(f"{re.escape(a)}(?P<{role}>.*?){re.escape(b)}" for role, (a, b) in MARKS.items()) + f"|<\\|role:(?P<name>.*?)\\|>(?P<other>.*?){re.escape(OTHER_END)})"
)


def escape(text: str) -> str:
    """text without control strings: backslashes are doubled, and one stands after a control string's first character."""
    return _CONTROL.sub("\\1\\\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def turn_text(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and where its escaped text lies in it."""
    before, after = MARKS.get(role) or (f"<|role:{escape(role)}|>", OTHER_END)
    body = escape(text)
    return before + body + after, len(before), len(before) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn begins at character {at}")
        at = m.end()
        if m["other"] is not None:
            turns.append((unescape(m["name"]), unescape(m["other"])))
        else:
            role = next(r for r in MARKS if m[r] is not None)
            turns.append((role, unescape(m[role])))
    return turns


def tree(conversations: list[tuple[object, list[tuple[str, str]]]]) -> dict:
    """The prefix tree of some (id, turns): its text depth-first, its nodes, and the node where each ends.

    Tokens are characters. `positions` has a position id for each: where it would stand in a conversation alone, so ids go on from
    a node's parent, not from the text before it. A node has its span in the text, the spans of its text that count for the
    loss, and `attends`: the spans of its ancestors, which with the causal part of its own are all that its characters may attend to.
    """
    root: dict = {"children": {}, "ends": []}
    for name, turns in conversations:
        node = root
        for turn in turns:
            node = node["children"].setdefault(turn, {"children": {}, "ends": []})
        node["ends"].append(name)
    text, nodes, leaves, at = [], [], [{"conv_id": c, "node": -1} for c in root["ends"]], 0
    positions = [np.empty(0, np.int32)]
    stack = [(turn, child, -1) for turn, child in reversed(root["children"].items())]
    while stack:
        (role, body), node, parent = stack.pop()
        formatted, a, b = turn_text(role, body)
        above = nodes[parent] if parent >= 0 else None
        attends = _joined([*above["attends"], (above["start"], above["end"])]) if above else []
        position = above["position"] + above["end"] - above["start"] if above else 0
        positions.append(np.arange(position, position + len(formatted), dtype=np.int32))
        nodes.append({"parent": parent, "role": role, "start": at, "end": at + len(formatted), "position": position, "loss": [(at + a, at + b)] if role == "assistant" else [], "attends": attends})
        leaves += [{"conv_id": c, "node": len(nodes) - 1} for c in node["ends"]]
        text.append(formatted)
        at += len(formatted)
        stack += [(turn, child, len(nodes) - 1) for turn, child in reversed(node["children"].items())]
    return {"text": "".join(text), "positions": np.concatenate(positions), "nodes": nodes, "leaves": leaves}


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and out[-1][1] == a:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_NODE = pa.struct([("parent", pa.int32()), ("role", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("position", pa.int32()), ("loss", pa.list_(_SPAN)), ("attends", pa.list_(_SPAN))])
_TREE = pa.schema([("text", pa.string()), ("positions", pa.list_(pa.int32())), ("nodes", pa.list_(_NODE)), ("leaves", pa.list_(pa.struct([("conv_id", pa.int64()), ("node", pa.int32())])))])
_TREE_DDL = "text string, positions array<int>, nodes array<struct<parent:int,role:string,start:int,end:int,position:int,loss:array<struct<start:int,end:int>>,attends:array<struct<start:int,end:int>>>>, leaves array<struct<conv_id:bigint,node:int>>"


def _row(t: dict) -> dict:
    spans = lambda xs: [{"start": a, "end": b} for a, b in xs]
    return t | {"nodes": [n | {"loss": spans(n["loss"]), "attends": spans(n["attends"])} for n in t["nodes"]]}


def pack(conversations: DataFrame, most: int = TREE_CONVERSATIONS, chars: int = TREE_CHARS) -> DataFrame:
    """Trees (text, positions, nodes, leaves) of all conversations; rows are turns (conv_id, turn, role, text).

    Conversations are sorted by the hashes of all their turns, in order, across the cluster, ties by their id: those that share their
    first turns, however many, are neighbours. Each task cuts its run into trees of bounded size. A first turn or a whole conversation that
    a third of all rows share thus spreads over many tasks, and is emitted once a tree. A null text or role counts as empty, turns
    that tie are ordered by role and text, repeated rows are turns of their own, more columns are left aside, and an
    empty table gives no tree. A turn without a conv_id is a conversation of its own, without an id. A very long conversation has a
    tree of its own, and its turns meet in one task.
    """
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"),
    )
    known = turns.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    whole = known.unionByName(turns.where("conv_id is null").select("conv_id", F.array("t").alias("turns")))
    path = F.transform("turns", lambda t: F.xxhash64(t["role"], t["text"]))
    keys = ["path", "conv_id"]
    ordered = whole.withColumn("path", path).repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv_id", "turns")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for k in range(batch.num_rows):
                turns = [(t["role"], t["text"]) for t in batch.column(1)[k].as_py()]
                n = sum(len(text) for _, text in turns)
                if held and (len(held) >= most or size + n > chars):
                    yield pa.RecordBatch.from_pylist([_row(tree(held))], _TREE)
                    held, size = [], 0
                held.append((batch.column(0)[k].as_py(), turns))
                size += n
        if held:
            yield pa.RecordBatch.from_pylist([_row(tree(held))], _TREE)

    return ordered.mapInArrow(run, _TREE_DDL)


def read_back(t: dict) -> Iterator[dict]:
    """Every conversation of a tree, from its text, position ids, nodes and leaves alone."""
    text, nodes = t["text"], t["nodes"]
    for leaf in t["leaves"]:
        pieces, loss = "", []
        if leaf["node"] >= 0:
            n = nodes[leaf["node"]]
            spans = [(s["start"], s["end"]) for s in n["attends"]] + [(n["start"], n["end"])]
            pieces = "".join(text[a:b] for a, b in spans)
            ids = np.concatenate([t["positions"][a:b] for a, b in spans])
            if not np.array_equal(ids, np.arange(len(pieces))):
                raise ValueError("position ids don't count a conversation's characters")
            k = leaf["node"]
            while k >= 0:
                loss += [text[s["start"] : s["end"]] for s in reversed(nodes[k]["loss"])]
                k = nodes[k]["parent"]
        yield {"conv_id": leaf["conv_id"], "turns": parse(pieces), "loss": [unescape(x) for x in reversed(loss)], "chars": len(pieces)}


_REPORT = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def digests(trees: DataFrame) -> DataFrame:
    """A row for each conversation that trees hold, with digests of what reads back from them."""

    def sha(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                t = {c: batch.column(j)[k].values.to_numpy() if c == "positions" else batch.column(j)[k].as_py() for j, c in enumerate(_TREE.names)}
                rows = []
                for c in read_back(t):
                    loss = "".join(c["loss"])
                    rows.append({"conv_id": c["conv_id"], "n_turns": len(c["turns"]), "turns_sha256": sha("".join(f"{r}\n{x}\n" for r, x in c["turns"])), "loss_chars": len(loss), "loss_sha256": sha(loss), "formatted_chars": c["chars"]})
                yield pa.RecordBatch.from_pylist(rows, _REPORT)

    return trees.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
