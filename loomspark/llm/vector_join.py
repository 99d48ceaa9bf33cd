"""Embedding near-duplicates by an epsilon grid order join.

Vectors are scaled to unit length in double precision, so a cosine of at least c means a distance
of at most eps = sqrt(2 - 2c). Equal vectors of one label fall into one class first. The classes are rotated
onto their principal dimensions and sorted by the cells of a grid of width eps on the leading ones.
The sorted sequence is cut into intervals (blocks); blocks, and above them groups of blocks, carry
the box that bounds them on the leading dimensions, and so do spans of groups. Interval pairs of one
label are joined from the top down: pairs of spans of spans, of spans, then of groups, whose boxes lie more than eps apart
are skipped; the blocks of the groups left are shipped once for each pair of groups, where pairs of blocks
are tested alike, and inside a pair of blocks the halving goes on down to LEAF vectors, where
cosines are computed in full; those at the threshold are computed once more from the vectors before they were scaled to
unit length, whose rounding would move them across it.

No pair list is made: a pair of groups returns, for each vector, the number of its links there and
one edge towards the smallest id it is connected with. Vectors travel in the element type of the table
and find their class again by two 64-bit hashes within their label; all arithmetic is in double precision.

Defined results: a vector that is null, zero or holds null or non-finite components, and one
without label, links with nothing. Components may be of any finite size, however large or small. Vectors of different lengths never link. Repeated rows are
vectors of their own. Empty tables give empty tables; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import cut, discard

LEADING = 8
#: Vectors of a block, blocks of a group, partitions of the sorted order in a span.
BLOCK = 512
GROUP = 16
SPAN = 64
LEAF = 64
#: Slack of the skipping test, far above rounding and far below any eps of use.
SLACK = 1e-6
#: Distance from the threshold, far above rounding, within which a cosine is computed again from the vectors as they are.
CLOSE = 1e-12


def scaled_rows(x: np.ndarray) -> np.ndarray:
    """The rows times a power of two, which costs no digit and brings each near 1, so no square over- or underflows."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def unit_rows(x: np.ndarray) -> np.ndarray:
    """The rows at length 1."""
    x = scaled_rows(x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def rounded_cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The cosines of rows of equal place, computed with more digits and rounded to a double; unit vectors are rounded before they are multiplied, these aren't."""
    x, y = x.astype(np.longdouble), y.astype(np.longdouble)
    return ((x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))).astype(np.float64)


def units(values: pd.Series) -> np.ndarray:
    return unit_rows(np.array(values.tolist(), np.float64))


def principal(classes: DataFrame, dim: int) -> np.ndarray:
    """The leading principal directions of all unit vectors of that length; dim * dim numbers reach the driver."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dim + 1, dim))
        for frame in frames:
            x = units(frame["v"])
            total += np.vstack([x.sum(axis=0), x.T @ x])
        yield pd.DataFrame({"at": np.arange(total.size), "x": total.ravel()})

    sums = np.zeros((dim + 1) * dim)
    got = classes.where(F.size("v") == dim).select("v").mapInPandas(run, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).toPandas()
    sums[got["at"].to_numpy(np.int64)] = got["x"]
    sums = sums.reshape(dim + 1, dim)
    n = max(1.0, np.trace(sums[1:]))
    mean = sums[0] / n
    return np.linalg.eigh(sums[1:] / n - np.outer(mean, mean))[1][:, ::-1][:, :LEADING]


def boxes_apart(a: np.ndarray, b: np.ndarray) -> float:
    """Distance of two boxes given as (low, high)."""
    gap = np.maximum(0.0, np.maximum(a[0] - b[1], b[0] - a[1]))
    return math.sqrt(float((gap * gap).sum()))


class BlockPair:
    """Link counts and roots of two blocks (or of one with itself)."""

    def __init__(self, a: tuple, b: tuple | None, axes: np.ndarray, cosine: float) -> None:
        self.cosine, self.eps = cosine, math.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK
        self.same = b is None
        (self.id_a, self.w_a, self.v_a), (self.id_b, self.w_b, self.v_b) = a, b or a
        self.x_a = unit_rows(self.v_a)
        self.x_b = self.x_a if self.same else unit_rows(self.v_b)
        self.p_a, self.p_b = self.x_a @ axes, self.x_b @ axes
        self.n_a, self.n_b = np.zeros(len(self.id_a), np.int64), np.zeros(len(self.id_b), np.int64)
        self.r_a = self.id_a.copy()
        self.r_b = self.r_a if self.same else self.id_b.copy()

    def join(self, a: slice, b: slice) -> None:
        pa, pb = self.p_a[a], self.p_b[b]
        if boxes_apart((pa.min(axis=0), pa.max(axis=0)), (pb.min(axis=0), pb.max(axis=0))) > self.eps:
            return
        na, nb = a.stop - a.start, b.stop - b.start
        if max(na, nb) <= LEAF:
            self.leaf(a, b)
            return
        halves = lambda s: [slice(s.start, m := (s.start + s.stop) // 2), slice(m, s.stop)] if s.stop - s.start > LEAF else [s]
        for i, x in enumerate(halves(a)):
            for j, y in enumerate(halves(b)):
                if not (self.same and a == b and j < i):
                    self.join(x, y)

    def leaf(self, a: slice, b: slice) -> None:
        cosines = self.x_a[a] @ self.x_b[b].T
        on = cosines >= self.cosine
        i, j = np.nonzero(np.abs(cosines - self.cosine) <= CLOSE)
        step = max(1, (1 << 18) // self.v_a.shape[1])
        for k in range(0, len(i), step):
            p, q = i[k : k + step], j[k : k + step]
            on[p, q] = rounded_cosines(scaled_rows(self.v_a[a][p]), scaled_rows(self.v_b[b][q])) >= self.cosine
        own = self.same and a == b
        if own:
            np.fill_diagonal(on, False)
        if not on.any():
            return
        self.n_a[a] += on @ self.w_b[b]
        if not own:
            (self.n_a if self.same else self.n_b)[b] += on.T @ self.w_a[a]
        far = np.iinfo(np.int64).max
        while True:
            before = self.r_a[a].copy(), self.r_b[b].copy()
            self.r_a[a] = np.minimum(self.r_a[a], np.where(on, self.r_b[b][None, :], far).min(axis=1))
            self.r_b[b] = np.minimum(self.r_b[b], np.where(on, self.r_a[a][:, None], far).min(axis=0))
            if (before[0] == self.r_a[a]).all() and (before[1] == self.r_b[b]).all():
                return

    def result(self) -> pd.DataFrame:
        self.join(slice(0, len(self.id_a)), slice(0, len(self.id_b)))
        parts = [(self.id_a, self.n_a, self.r_a)] + ([] if self.same else [(self.id_b, self.n_b, self.r_b)])
        out = pd.concat([pd.DataFrame({"rep": i, "links": n, "root": r}) for i, n, r in parts])
        return out[out["links"] > 0]


def blocks(classes: DataFrame, axes: dict[int, np.ndarray], eps: float, parts: int) -> DataFrame:
    """One row per interval of the grid order: label, dim, span and group, place in the group, its box, and its members packed."""
    kind = classes.schema["v"].dataType.elementType.simpleString()
    number = np.float32 if kind == "float" else np.float64

    def project(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dim, rows in frame.groupby(frame["v"].map(len)):
                p = units(rows["v"]) @ axes[dim]
                yield rows.assign(dim=dim, cell=list(np.floor(p / max(eps, 1e-6)).astype(np.int32)), p=list(p))

    def slabs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, made, held = TaskContext.get().partitionId(), 0, []
        count, last = 0, None

        def whole() -> pd.DataFrame:
            rows = pd.concat(held)
            p, first = np.array(rows["p"].tolist()), rows.iloc[0]
            group = (part << 32) + made // GROUP
            return pd.DataFrame({"label": [first["label"]], "dim": [first["dim"]], "span": [part // SPAN], "group": [group], "block": [made], "low": [p.min(axis=0)], "high": [p.max(axis=0)], "reps": [rows["rep"].to_numpy(np.int64).tobytes()], "weights": [rows["w"].to_numpy(np.int64).tobytes()], "vectors": [np.array(rows["v"].tolist(), number).tobytes()]})

        for frame in frames:
            edge = np.flatnonzero((frame["label"].to_numpy()[1:] != frame["label"].to_numpy()[:-1]) | (frame["dim"].to_numpy()[1:] != frame["dim"].to_numpy()[:-1])) + 1
            for a, b in zip(np.r_[0, edge], np.r_[edge, len(frame)], strict=True):
                run = frame.iloc[a:b]
                now = (run["label"].iloc[0], run["dim"].iloc[0]) if len(run) else last
                if now != last and held:
                    yield whole()
                    held, count, made = [], 0, made + 1
                last = now
                while len(run):
                    take = run.iloc[: BLOCK - count]
                    held.append(take)
                    count += len(take)
                    run = run.iloc[len(take) :]
                    if count == BLOCK:
                        yield whole()
                        held, count, made = [], 0, made + 1
        if held:
            yield whole()

    order = ["label", "dim", "cell", "rep"]
    cells = classes.mapInPandas(project, f"label long, rep long, w long, v array<{kind}>, dim int, cell array<int>, p array<double>")
    sorted_ = cells.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return sorted_.mapInPandas(slabs, "label long, dim int, span long, group long, block int, low array<double>, high array<double>, reps binary, weights binary, vectors binary")


def apart(a: str, b: str) -> Column:
    """Squared distance of two boxes, in built-in functions."""
    gap = lambda i: F.greatest(F.lit(0.0), F.col(f"{a}.low")[i] - F.col(f"{b}.high")[i], F.col(f"{b}.low")[i] - F.col(f"{a}.high")[i])
    each = F.transform(F.sequence(F.lit(0), F.size(f"{a}.low") - 1), lambda i: gap(i) * gap(i))
    return F.aggregate(each, F.lit(0.0), lambda x, y: x + y)


def group_pairs(outline: DataFrame, n_axes: int, limit: float, parts: int) -> DataFrame:
    """(label, dim, ga, gb, box_a, box_b), ga <= gb: the groups whose boxes are near each other.

    Boxes form a tree: groups, spans, spans of SPAN spans and so on, up to a level of at most SPAN boxes. Only the top level
    compares all its pairs; each level below joins the children of near pairs.
    """
    key = ["label", "dim"]
    side = lambda how, c: F.filter(F.array(*[how(F.get(c, F.lit(i))) for i in range(n_axes)]), lambda x: x.isNotNull()).alias(c)
    groups = outline.groupBy(*key, "span", "group").agg(side(F.min, "low"), side(F.max, "high"))
    levels = [groups.withColumnRenamed("span", "up").withColumnRenamed("group", "node"), groups.groupBy(*key, F.col("span").alias("node")).agg(side(F.min, "low"), side(F.max, "high"))]
    count = -(-parts // SPAN)
    while count > SPAN:
        below = levels[-1].withColumn("up", F.floor(F.col("node") / SPAN))
        levels[-1] = below
        levels.append(below.groupBy(*key, F.col("up").alias("node")).agg(side(F.min, "low"), side(F.max, "high")))
        count = -(-count // SPAN)
    levels[-1] = levels[-1].withColumn("up", F.lit(0).cast("long"))
    near = levels[-1].select(*key, F.lit(0).cast("long").alias("node_a"), F.lit(0).cast("long").alias("node_b")).distinct()
    for level in reversed(levels):
        child = lambda x, rows: rows.select(*key, F.col("up").alias(f"node_{x}"), F.col("node").alias(f"child_{x}"), F.struct("low", "high").alias(f"box_{x}"))
        both = near.select(*key, "node_a", "node_b").join(child("a", level), [*key, "node_a"]).join(child("b", level), [*key, "node_b"])
        close = both.where((F.col("child_a") <= F.col("child_b")) & (apart("box_a", "box_b") <= limit))
        near = close.select(*key, F.col("child_a").alias("node_a"), F.col("child_b").alias("node_b"), "box_a", "box_b")
    return near.withColumnsRenamed({"node_a": "ga", "node_b": "gb"})


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of vectors."""
    eps = math.sqrt(max(0.0, 2 - 2 * cosine))
    single = vectors.schema[embedding].dataType.simpleString() == "array<float>"
    v = F.col(embedding) if single else F.transform(embedding, lambda x: x.cast("double"))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), v.alias("v"))
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0.0)
    sound = rows.where(F.coalesce(fine, F.lit(False)))
    prints = [F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2")]
    classes = cut(sound.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("w")).select("label", "rep", "w", "v", *prints), "vectors")
    packed = classes.select("label", "rep", "w", "v")
    dims = [r[0] for r in classes.select(F.size("v")).distinct().collect()]
    axes = {d: principal(packed, d) for d in dims}
    parts = max(1, -(-classes.count() // (BLOCK * GROUP)))
    held = cut(blocks(packed, axes, eps, parts), "blocks")
    limit, number = (eps + SLACK) ** 2, np.float32 if single else np.float64
    pairs = group_pairs(held.select("label", "dim", "span", "group", "low", "high"), max([1, *(a.shape[1] for a in axes.values())]), limit, parts)
    key = ["label", "dim", "ga", "gb"]
    content = held.select("label", "dim", "group", "block", "low", "high", "reps", "weights", "vectors")

    def shipped(own: str, other: str, wanted: Column) -> DataFrame:
        """The blocks of group `own` of each pair that lie near the box of group `other`."""
        near = pairs.where(wanted).select(*key, F.col(f"box_{other}").alias("box"))
        mine = content.withColumnRenamed("group", f"g{own}").withColumn("of", F.struct("low", "high"))
        return near.join(mine, ["label", "dim", f"g{own}"]).where(apart("of", "box") <= limit).select(*key, F.lit(own).alias("side"), "block", "low", "high", "reps", "weights", "vectors")

    def tiles(names: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        dim, own = int(names[1]), names[2] == names[3]
        rows = {s: list(x.sort_values("block").itertuples(index=False)) for s, x in frame.groupby("side")}
        left, right = rows.get("a", []), rows.get("a" if own else "b", [])

        def unpack(row: tuple) -> tuple:
            x = np.frombuffer(row.vectors, number).reshape(-1, dim).astype(np.float64)
            return np.frombuffer(row.reps, np.int64), np.frombuffer(row.weights, np.int64), x

        found = []
        for i, a in enumerate(left):
            mine = unpack(a)
            for j, b in enumerate(right):
                if (not own or i <= j) and boxes_apart((np.asarray(a.low), np.asarray(a.high)), (np.asarray(b.low), np.asarray(b.high))) ** 2 <= limit:
                    found.append(BlockPair(mine, None if own and i == j else unpack(b), axes[dim], cosine).result())
        every = pd.concat(found) if found else pd.DataFrame({"rep": [], "links": [], "root": []}, dtype=np.int64)
        linked = every.groupby(["rep", "root"], as_index=False)["links"].sum()
        return linked[["rep", "links", "root"]]

    apart_groups = F.col("ga") < F.col("gb")
    sides = shipped("a", "b", F.lit(True)).unionByName(shipped("b", "a", apart_groups))
    found = cut(sides.groupBy(*key).applyInPandas(tiles, "rep long, links long, root long"), "links")
    discard(held)
    of = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    per_class = classes.drop("v").join(found.groupBy("rep").agg(F.sum("links").alias("links")), "rep", "left").join(of.withColumnRenamed("node", "rep"), "rep", "left")
    named = per_class.select("label", "h1", "h2", (F.col("w") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = sound.select("vec_id", "label", *prints).join(named, ["label", "h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.coalesce(fine, F.lit(False))).select("vec_id", F.lit(0).cast("long"), "vec_id")
    return linked.union(alone.toDF("vec_id", "n_links", "component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
