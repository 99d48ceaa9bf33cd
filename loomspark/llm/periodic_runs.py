"""Periodic runs: maximal stretches of words that repeat with a period, found by harmonic grid probing.

A run is a stretch with smallest period q, at least max(least, 3 q) words long, that no neighbouring word extends with the
same period. Where a run has period p, words p apart are equal over at least 2 p places in a row, so two neighbouring points
of the grid 0, p, 2p, ... lie among them, wherever the grid starts. Probing word equality at jp and (j + 1)p costs n / p for each p, n log n
for all. Survivors are those with as many equal grid points in a row as any run of the period must have. They are confirmed by
comparing the p words between two grid points in growing chunks, and extended both ways by chunked comparison. Grid points within a
found run whose period divides p are skipped: there the run itself is what would be found again (by Fine and Wilf, a stretch of
three periods p has its smallest period as a divisor of p, and that one has been probed before).

Rows are taken in slices of about WORDS words. Up to the period `few` (about the root of the longest text) all texts of a
slice are probed together, one period after the other; beyond it each text alone, one grid step after the other for whole ranges of
periods. So a text costs about the root of its length in NumPy calls.

Defined results: null and blank texts have no words and no run; their collapsed text is empty. Texts are taken whole, a text that is
longer than a slice alone. Repeated rows are answered each. Other columns pass through; those named like an output
are replaced. Empty tables give empty tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import SPACE, bound

LEAST = 24
#: Bytes of text of a slice of rows, numbers compared at once, and the least number of periods probed for all texts together.
BYTES, AT_ONCE, FEW = 4 << 20, 1 << 20, 64
OUT = [("n_runs", "long"), ("start", "long"), ("length", "long"), ("period", "long"), ("exponent_milli", "long"), ("runs", "array<struct<start:long,length:long,period:long>>"), ("collapsed", "string")]


def equal_from(x: np.ndarray, at: int, p: int) -> int:
    """The first i >= at with x[i] != x[i + p], or len(x) - p; chunks double."""
    end, width = len(x) - p, 64
    while at < end:
        stop = min(end, at + width)
        differ = np.flatnonzero(x[at:stop] != x[at + p : stop + p])
        if len(differ):
            return at + int(differ[0])
        at, width = stop, min(2 * width, AT_ONCE)
    return max(at, end)


def equal_to(x: np.ndarray, at: int, p: int) -> int:
    """The last i < at with x[i] != x[i + p], or -1; chunks double."""
    width = 64
    while at > 0:
        start = max(0, at - width)
        differ = np.flatnonzero(x[start:at] != x[start + p : at + p])
        if len(differ):
            return start + int(differ[-1])
        at, width = start, min(2 * width, AT_ONCE)
    return -1


class Runs:
    """The runs found so far in an array of word numbers whose texts are parted by numbers that occur once."""

    def __init__(self, x: np.ndarray, least: int) -> None:
        self.x, self.least = x, least
        self.found: dict[tuple[int, int], int] = {}
        self.table = np.zeros((0, 3), np.int64)

    def within(self, at: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Whether the words at .. at + 2p lie in a found run whose period divides p; `at` is in order where all p are equal."""
        if len(self.table) != len(self.found):
            self.table = np.array([(s, e, q) for (s, e), q in self.found.items()], np.int64)
        if not len(at) or not len(self.table):
            return np.zeros(len(at), bool)
        s, e, q = self.table[(self.table[:, 0] <= at.max()) & (self.table[:, 1] >= at.min()) & (self.table[:, 1] - self.table[:, 0] >= 2 * p.min())].T
        if p.min() == p.max():
            s, e = s[p[0] % q == 0], e[p[0] % q == 0]
            mark = np.zeros(len(at) + 1, np.int64)
            a, b = np.searchsorted(at, s), np.searchsorted(at, e - 2 * p[0], side="right")
            np.add.at(mark, a, 1)
            np.add.at(mark, np.maximum(a, b), -1)
            return np.cumsum(mark[:-1]) > 0
        out = np.zeros(len(at), bool)
        for low, high, period in zip(s.tolist(), e.tolist(), q.tolist(), strict=True):
            out |= (p % period == 0) & (at >= low) & (at + 2 * p <= high)
        return out

    def confirmed(self, at: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Of the survivors, those whose p words from `at` on all equal the words p later."""
        ok, offset, width = np.ones(len(at), bool), 1, 4
        while offset < (most := int(p[ok].max(initial=0))):
            left = np.flatnonzero(ok & (p > offset))
            step = min(width, most - offset)
            for some in np.array_split(left, -(-len(left) * step // AT_ONCE) or 1):
                o = offset + np.arange(step)
                i = at[some][:, None] + np.minimum(o, p[some][:, None] - 1)
                ok[some] = (self.x[i] == self.x[i + p[some][:, None]]).all(axis=1)
            offset, width = offset + step, min(2 * width, AT_ONCE)
        return ok

    def extend(self, at: np.ndarray, p: np.ndarray) -> None:
        """Extend survivors, in order of period and place, and keep those that are runs."""
        ok = self.confirmed(at, p)
        last = (0, 0, 0)
        for i, q in zip(at[ok].tolist(), p[ok].tolist(), strict=True):
            if q == last[0] and last[1] <= i < last[2]:
                continue
            start, end = equal_to(self.x, i, q) + 1, equal_from(self.x, i, q) + q
            last = (q, start, end - q)
            if end - start >= max(self.least, 3 * q):
                self.found.setdefault((start, end), q)


def together(runs: Runs, first: np.ndarray, sizes: np.ndarray, few: int) -> None:
    """Probe the periods 1 .. few over all texts that are long enough; texts stand in order of size."""
    x = runs.x
    for p in range(1, few + 1):
        least = max(runs.least, 3 * p)
        k = int(np.searchsorted(sizes, least))
        if k == len(sizes):
            break
        base = int(first[k])
        grid = x[base::p]
        same = grid[:-1] == grid[1:]
        need = max(runs.least - p, 2 * p) // p  # equal grid points in a row that a run of this period has at least
        sums = np.r_[0, np.cumsum(same)]
        row = sums[need:] - sums[:-need] == need
        at = base + p * np.flatnonzero(row)
        one = np.full(len(at), p, np.int64)
        skip = runs.within(at, one)
        runs.extend(at[~skip], one[~skip])


def alone(runs: Runs, base: int, n: int, few: int) -> None:
    """Probe the periods beyond few of one text, in ranges that double; two equal grid points in a row survive."""
    x, low = runs.x[base : base + n], few + 1
    while low <= n // 3:
        high = min(2 * low - 1, n // 3)
        found_at, found_p = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        before = np.zeros(0, bool)
        for j in range(n // low):
            top = min(high, (n - 1) // (j + 1))
            if top < low:
                break
            p = np.arange(low, top + 1)
            same = x[j * p] == x[(j + 1) * p]
            both = np.flatnonzero(same & before[: len(same)]) if j else np.zeros(0, np.int64)
            found_at.append((j - 1) * p[both])
            found_p.append(p[both])
            before = same
        at, p = np.concatenate(found_at) + base, np.concatenate(found_p)
        order = np.lexsort((at, p))
        at, p = at[order], p[order]
        skip = runs.within(at, p)
        runs.extend(at[~skip], p[~skip])  # no period of this range divides another one, so one look at what was found before does
        low = high + 1


def runs_of(x: np.ndarray, sizes: np.ndarray, least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each text, by start, then period; x has the texts' word numbers end to end."""
    sizes = np.asarray(sizes, np.int64)
    order = np.argsort(sizes, kind="stable")
    begin = np.cumsum(sizes) - sizes
    parts, first, at = [], np.zeros(len(sizes), np.int64), 0
    for k, i in enumerate(order.tolist()):  # a number that occurs once stands before each text and at the end
        parts += [np.array([-1 - k], np.int64), x[begin[i] : begin[i] + sizes[i]].astype(np.int64)]
        first[k] = at + 1
        at += 1 + int(sizes[i])
    runs = Runs(np.concatenate([*parts, [-1 - len(sizes)]]), least)
    ordered = sizes[order]
    few = max(FEW, math.isqrt(int(ordered[-1]))) if len(sizes) else 0
    together(runs, first, ordered, few)
    for k in range(int(np.searchsorted(ordered, max(least, 3 * (few + 1)))), len(sizes)):
        alone(runs, int(first[k]), int(ordered[k]), few)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(sizes))]
    if runs.found:
        of = np.searchsorted(first, [s for s, _ in runs.found], side="right") - 1
        for k, ((s, e), q) in zip(of.tolist(), runs.found.items(), strict=True):
            out[order[k]].append((s - int(first[k]), e - s, q))
    return [sorted(r, key=lambda t: (t[0], t[2])) for r in out]


def numbered(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(all words end to end, their numbers, words of each text)."""
    lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
    words, parent = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    real = pc.not_equal(words, "")
    words, parent = words.filter(real), parent[real.to_numpy(zero_copy_only=False)]
    return words, words.dictionary_encode().indices.to_numpy(zero_copy_only=False), np.bincount(parent, minlength=len(texts))


def answers(texts: pa.Array, least: int) -> list[pa.Array]:
    """The columns OUT of the texts."""
    words, x, sizes = numbered(texts)
    begin = np.cumsum(sizes) - sizes
    found = runs_of(x, sizes, least)
    dropped = np.zeros(len(x) + 1, np.int64)
    for i, runs in enumerate(found):
        for s, n, q in runs:
            dropped[begin[i] + s + q] += 1
            dropped[begin[i] + s + n] -= 1
    stay = np.cumsum(dropped)[:-1] == 0
    kept = np.r_[0, np.cumsum(stay)]
    offsets = pa.array(np.r_[kept[begin], kept[-1]], pa.int64())
    collapsed = pc.binary_join(pa.LargeListArray.from_arrays(offsets, words.filter(pa.array(stay))), pa.scalar(" ", pa.large_string())).cast(pa.string())
    best = [max(r, key=lambda t: (Fraction(t[1], t[2]), -t[0], -t[2]), default=None) for r in found]
    long = lambda make: pa.array([None if b is None else make(*b) for b in best], pa.int64())
    rows = pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r] for r in found], pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])))
    return [pa.array([len(r) for r in found], pa.int64()), long(lambda s, n, q: s), long(lambda s, n, q: n), long(lambda s, n, q: q), long(lambda s, n, q: 1000 * n // q), rows, collapsed]


def slices(batch: pa.RecordBatch, texts: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about BYTES of text, one row at least."""
    size = pc.binary_length(batch.column(texts)).fill_null(0).to_numpy().astype(np.int64)
    total, at = np.cumsum(size), 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + BYTES, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def detect(docs: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """docs with n_runs, the run with the greatest exponent (start, length, period, exponent_milli), all runs and the collapsed text.

    The collapsed text keeps of each run its first period: a word goes if any run contains it after that run's first q words.
    """
    if least < 1:
        raise ValueError("least starts at 1")
    new = [name for name, _ in OUT]
    kept = [c for c in docs.columns if c not in new]
    read = kept if text in kept else [*kept, text]
    made = ", ".join(f"{name} {kind}" for name, kind in OUT)
    schema = T.StructType([*[f for f in docs.schema.fields if f.name in kept], *T.StructType.fromDDL(made).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = read.index(text)
        for batch in batches:
            for some in slices(batch, at):
                yield pa.RecordBatch.from_arrays([*some.columns[: len(kept)], *answers(some.column(at), least)], names=kept + new)

    return docs.select(*[F.col(f"`{c}`") for c in read]).mapInArrow(run, schema)


def listed(runs: Column) -> Column:
    """Every run as its line `start,length,period`."""
    return F.array_join(F.transform(runs, lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")


def planted(doc_id: Column, text: Column) -> Column:
    """The text with the words from place a on repeated with period p, where the id's checksum is a multiple of ten."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def repeat(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, F.greatest(n, F.lit(1)).cast("long")).cast("int")
        p = (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
        places = F.when(n > 0, F.sequence(F.lit(0), n - 1))
        return bound(F.struct(a.alias("a"), p.alias("p")), lambda s: F.array_join(F.transform(places, lambda i: words[F.when(i < s["a"], i).otherwise(s["a"] + F.pmod(i - s["a"], s["p"]))]), " "))

    return F.when(F.pmod(h, F.lit(10)) == 0, bound(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), ""), repeat)).otherwise(text)
