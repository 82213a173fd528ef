"""Newick trees: tokens by a pattern, then a stack; one task works through whole trees.

Nodes are numbered as they close. A label is all text up to a bracket, comma or semicolon (a ":length" stays in it, as do spaces);
an inner node without one has a null label; an empty leaf makes no node; several trees in one text leave the last as the root.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"[(),;]|[^(),;]+")
NODES = "tree_id string, node_id bigint, parent_id bigint, label string, is_root boolean"


def parse(text: str | None) -> tuple[list[tuple[int, int | None, str | None]], int | None]:
    """(node, parent, label) of every node in the order in which they close, and the root: the last node outside brackets."""
    labels: list[str | None] = []
    parent: dict[int, int] = {}
    waiting: list[list[int]] = []
    closed, root = False, None

    def add(label: str | None, children: list[int]) -> None:
        node = len(labels)
        labels.append(label)
        parent.update(dict.fromkeys(children, node))
        nonlocal root
        if waiting:
            waiting[-1].append(node)
        else:
            root = node

    for token in TOKEN.findall(text or ""):
        if token == "(":
            waiting.append([])
        elif token == ")":
            if not waiting:
                raise ValueError("a bracket closes that was not opened")
            add(None, waiting.pop())
        elif token not in ",;":
            if closed:
                labels[-1] = token
            else:
                add(token, [])
        closed = token == ")"
    return [(n, parent.get(n), label) for n, label in enumerate(labels)], root


def nodes(trees: DataFrame, tree: str = "tree_id", newick: str = "newick") -> DataFrame:
    """(tree_id, node_id, parent_id, label, is_root) of every tree."""
    rows = trees.select(F.col(tree).cast("string").alias("tree_id"), F.col(newick).alias("newick"))

    def read(batches):
        for batch in batches:
            for tree_id, text in zip(batch.column("tree_id").to_pylist(), batch.column("newick").to_pylist(), strict=True):
                own, root = parse(text)
                columns = [[tree_id] * len(own), [n for n, *_ in own], [up for _, up, _ in own], [label for *_, label in own], [n == root for n, *_ in own]]
                types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["tree_id", "node_id", "parent_id", "label", "is_root"])

    return rows.mapInArrow(read, NODES)
