"""Connected components by alternating large-star and small-star rounds.

Each round is two grouped minima and two joins over the edge table, written to the shared folder,
so neither edges nor components ever meet on the driver or in one task. Edges of one task are
first thinned to a spanning forest, which keeps every component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, discard


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for the nodes of these edges that aren't smallest themselves."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, root[left], least)
        np.minimum.at(new, root[right], least)
        while (jump := new[new]).tobytes() != new.tobytes():
            new = jump
        if (new == root).all():
            break
        root = new
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def thin(edges: DataFrame, at_once: int = 1 << 20) -> DataFrame:
    """A spanning forest of the edges (a, b) of every task, in runs of at most about at_once edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            a, b = forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            if batch.num_rows:
                held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            if sum(len(x) for x, _ in held) >= at_once:
                yield flush()
        if held:
            yield flush()

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable from each node that has an edge in (a, b). Read from one table in the shared folder."""
    clean = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    now = cut(thin(clean).distinct(), "edges")
    while True:
        both = now.union(now.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(down.select("u", "m")).where("a <> b")
        new = cut(small.distinct(), "edges")
        # stars all round: no node has two smaller neighbours and no smallest node is itself joined to a smaller one
        done = new.groupBy("a").count().where("count > 1").isEmpty() and new.join(new.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()
        discard(now)
        now = new
        if done:
            break
    roots = now.select(F.col("b").alias("a")).distinct()
    out = cut(now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("a", "a")), "components")
    discard(now)
    return out
