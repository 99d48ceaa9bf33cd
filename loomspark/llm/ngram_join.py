"""N-gram Jaccard join: size-banded tiles, bitmap bounds, exact intersection.

Each document becomes the set of its distinct k-word shingles, as 64-bit hashes. Equal sets fall
into one class, represented by its smallest id. Sizes are cut into bands, each as wide as the
threshold allows two sets to differ, so linked sets lie in one band or in neighbouring ones. A
tile is a size band and a shingle: it holds the classes of the band that have the shingle among their
rarest (home) and those of the band below (guests). A set with Jaccard similarity of at least t to
another shares with it one of its first n - ceil(t n) + 1 shingles in any common order; the order
puts shingles of heavy hash buckets last, so common passages seldom make tiles. Most tiles of a group of
near copies hold the same classes; one of each is kept (members are compared by count and two
64-bit hashes). Tiles over TILE classes are cut into pairs of parts. Parity bitmaps bound a pair's
overlap from above: differing bits cannot outnumber differing shingles. Pairs that pass are
intersected exactly, as sorted arrays of whole 64-bit hashes.

Only connection matters, so the work goes in passes. The first tests each class against its most
alike predecessor; the next ROUNDS join components by the most alike pairs across them; the last
tests every pair of a tile that is still in different components and that passes the bound. No link
between components can be missed, and a connected group isn't expanded into all its pairs.

Defined results: null or blank text has the empty set, n_shingles 0, and links with nothing; a text
with fewer than k words has one shingle, the whole sequence. Rows without id link with nothing.
Rows that repeat an id count as one document: that of its texts with words whose xxhash64 is smallest speaks for
all of them, whatever the order of the rows. Very long texts are taken whole. Empty tables give
empty tables; columns other than id and text are not looked at.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import cut, discard, mix64, small

TILE = 4096
BUCKETS = 1 << 20
#: Rows and bytes of text that are hashed at once; a longer text or word is taken alone.
ROWS, BYTES = 500, 1 << 20
#: Rounds that test only the BEST most alike pairs of a class in each tile, before all pairs that are left.
ROUNDS, BEST = 2, 1
#: 64-bit numbers that a tile compares at once.
AT_ONCE = 1 << 18
#: Base of the words' polynomial hash, its inverse modulo 2^64, and a random number for each byte, A-Z as a-z.
BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)
FOLDED = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint64)
VALUE = mix64((FOLDED + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03))
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
NEXT_BLANK = re.compile(rb"[\x20\x09-\x0D]")


@cache
def powers(base: int, most: int) -> np.ndarray:
    out = np.full(most, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(where each word starts, 64-bit hash of it), A-Z folded: sums of byte values times powers of BASE, from prefix sums."""
    starts, hashes, at = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
    while at < len(raw):
        blank = NEXT_BLANK.search(raw, at + BYTES) if at + BYTES < len(raw) else None
        end = blank.start() if blank else len(raw)
        b = np.frombuffer(raw, np.uint8, end - at, at)
        edge = np.flatnonzero(np.diff(BLANK[b], prepend=True, append=True))
        s, e = edge[::2], edge[1::2]
        most = max(BYTES + 1, 1 << len(b).bit_length())
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(VALUE[b] * powers(BASE, most)[: len(b)], out=sums[1:])
        starts.append(s + at)
        hashes.append(mix64((sums[e] - sums[s]) * powers(UNBASE, most)[s] + (e - s).astype(np.uint64)))
        at = end
    return np.concatenate(starts), np.concatenate(hashes)


def shingled(texts: list[str | None], k: int) -> Iterator[np.ndarray]:
    """The distinct hashes of the k-word shingles of each text, sorted."""
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    held, size = [], 0
    for i, r in enumerate(raw):
        held.append(r)
        size += len(r) + 1
        if size >= BYTES or i == len(raw) - 1:
            yield from _shingled(held, k)
            held, size = [], 0


def _shingled(raw: list[bytes], k: int) -> Iterator[np.ndarray]:
    starts, h = word_hashes(b" ".join(raw))
    first = np.searchsorted(starts, np.cumsum([0, *[len(r) + 1 for r in raw]]))
    out = np.full(max(0, len(h) - k + 1), k, np.uint64)
    for i in range(k):
        out = mix64(out ^ h[i : len(out) + i])
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            some = np.sort(out[a : b - k + 1])
            yield some[np.r_[True, some[1:] != some[:-1]]]
        elif b > a:
            alone = np.full(1, b - a, np.uint64)
            for i in range(a, b):
                alone = mix64(alone ^ h[i : i + 1])
            yield alone
        else:
            yield np.zeros(0, np.uint64)


def bitmap(h: np.ndarray) -> np.ndarray:
    """Parity bits of the hashes, as many as twice the power of two at or above their number, 1024 to 65536; the wider, the tighter the bound."""
    width = min(1 << 16, max(1024, 2 << int(len(h) - 1).bit_length()))
    return np.packbits((np.bincount((h >> np.uint64(40)).astype(np.int64) & (width - 1), minlength=width) & 1).astype(np.uint8), bitorder="little").view(np.uint64)


def differing(a: np.ndarray, b: np.ndarray) -> int:
    """Differing bits of two bitmaps, the longer one folded to the shorter: a lower bound of the sets' difference."""
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def may_reach(total: np.ndarray, differ: np.ndarray, percent: int) -> np.ndarray:
    """Whether overlap (total - differ) / 2 of union (total + differ) / 2 can reach the percentage."""
    return 100 * (total - differ) >= percent * (total + differ)


def heavy_buckets(docs: DataFrame, k: int) -> np.ndarray:
    """log2 of the documents that hit each heavy hash bucket; 0 for the others. At most BUCKETS numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(BUCKETS, np.int64)
        for batch in small(batches, ROWS):
            for h in shingled(batch.column(0).to_pylist(), k):
                np.add.at(count, (h & np.uint64(BUCKETS - 1)).astype(np.int64), 1)
        at = np.flatnonzero(count >= max(32, 8 * count.mean()))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(count[at])], names=["bucket", "n"])

    found = docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS, np.uint8)
    out[found["bucket"].to_numpy(np.int64)] = np.log2(found["n"].to_numpy(np.float64)).astype(np.uint8)
    return out


def describe(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(id, t, n, sid, keys, bits): text hash, set size, set hash, prefix shingles and bitmap of each document."""
    rank = docs.sparkSession.sparkContext.broadcast(heavy_buckets(docs, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = rank.value
        for batch in small(batches, ROWS):
            n, sid, keys, bits = [], [], [], []
            for h in shingled(batch.column(1).to_pylist(), k):
                first = len(h) - -(-percent * len(h) // 100) + 1 if len(h) else 0
                by = h[np.argsort(order[(h & np.uint64(BUCKETS - 1)).astype(np.int64)], kind="stable")]
                n.append(len(h))
                sid.append(xxhash.xxh64_intdigest(h.tobytes()))
                keys.append(by[:first].view(np.int64))
                bits.append(bitmap(h).tobytes() if len(h) else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(np.array(sid, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.binary())], names=["id", "t", "n", "sid", "keys", "bits"])

    return docs.select("id", "text", "t").mapInArrow(run, "id long, t long, n long, sid long, keys array<long>, bits binary")


def whole_groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Consecutive rows as tables that never end within a group of equal values in `by`; and the number of each row's group."""
    held: list[pa.RecordBatch] = []

    def numbered(rows: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(rows)
        keys = np.stack([table.column(c).to_numpy() for c in by])
        return table, np.cumsum((np.diff(keys, axis=1, prepend=keys[:, :1]) != 0).any(axis=0))

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table, group = numbered(held)
        last = int(np.searchsorted(group, group[-1]))
        if last:
            yield table.slice(0, last), group[:last]
            held = table.slice(last).combine_chunks().to_batches()
    if held:
        yield numbered(held)


def tiles_of(classes: DataFrame, percent: int) -> DataFrame:
    """(key, band, rep, n, home, g): the members of each tile, one of tiles with equal members; key numbers the tile, g is its size."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log(percent / 100 - 1e-9)))
    keyed = classes.select("rep", "n", band.alias("own"), F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("g"), F.max("own").alias("top")).where("g > 1").drop("g")
    spread = F.explode(F.when(F.col("own") < F.col("top"), F.array("own", F.col("own") + 1)).otherwise(F.array("own")))
    rows = cut(keyed.join(shared, "key").select("key", "rep", "n", "own", spread.alias("band")), "rows")
    seen = rows.groupBy("key", "band").agg(F.count("*").alias("g"), F.count_if(F.col("own") == F.col("band")).alias("homes"), *[F.bit_xor(F.xxhash64("rep", F.lit(i))).alias(f"x{i}") for i in (1, 2)])
    single = seen.where("g > 1 AND homes > 0").groupBy("band", "g", "x1", "x2").agg(F.min("key").alias("key")).drop("x1", "x2")
    out = cut(rows.join(single, ["key", "band"]).select("key", "band", "rep", "n", (F.col("own") == F.col("band")).alias("home"), "g"), "tiles")
    discard(rows)
    return out


def neighbours(tiles: DataFrame, percent: int) -> DataFrame:
    """(a, b, na, nb): each class of a tile with the one before it in order of size and id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.zeros((0, 5), np.int64)
        for batch in batches:
            rows = np.concatenate([last, np.stack([batch.column(i).to_numpy() for i in range(5)], axis=1)])  # key, band, part, n, rep
            a, b = rows[:-1], rows[1:]
            near = (a[:, :3] == b[:, :3]).all(axis=1) & (a[:, 4] != b[:, 4]) & (100 * a[:, 3] >= percent * b[:, 3])
            pairs = np.unique(np.stack([a[near, 4], b[near, 4], a[near, 3], b[near, 3]], axis=1), axis=0)
            last = rows[-1:]
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, i]) for i in range(4)], names=["a", "b", "na", "nb"])

    part = F.pmod(F.xxhash64("rep"), F.ceil(F.col("g") / TILE))
    dealt = tiles.select("key", "band", part.alias("part"), "n", "rep").repartition("key", "band", "part").sortWithinPartitions("key", "band", "part", "n", "rep")
    return dealt.mapInArrow(run, "a long, b long, na long, nb long")


def bounded(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b, differ) of the pairs whose bitmaps let them reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            differ = np.array([differing(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)) for p, q in zip(x, y, strict=True)], np.int64)
            ok = may_reach(batch.column(2).to_numpy() + batch.column(3).to_numpy(), differ, percent) if batch.num_rows else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok)) for c in (batch.column(0), batch.column(1), pa.array(differ))], names=["a", "b", "differ"])

    bits = classes.select(F.col("rep"), "bits")
    wide = pairs.join(bits.toDF("a", "x"), "a").join(bits.toDF("b", "y"), "b")
    return wide.select("a", "b", "na", "nb", "x", "y").mapInArrow(run, "a long, b long, differ long")


def verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) that reach the threshold, by intersecting their whole sorted shingle arrays; written to the shared folder."""

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, ROWS):
            packed = [h.tobytes() for h in shingled(batch.column(1).to_pylist(), k)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(packed, pa.binary())], names=["id", "t", "h"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, ROWS):
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(ok, pa.bool_())) for i in (0, 1)], names=["a", "b"])

    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    told = docs.select("id", "text", "t").join(wanted, "id", "left_semi").mapInArrow(arrays, "id long, t long, h binary").where(F.octet_length("h") > 0)
    sets = cut(told.groupBy("id").agg(F.min_by("h", "t").alias("h")), "sets")
    wide = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    out = cut(wide.select("a", "b", "x", "y").mapInArrow(meet, "a long, b long"), "links")
    discard(sets)
    return out


def crossing(tiles: DataFrame, classes: DataFrame, found: DataFrame, percent: int, best: int | None = None) -> DataFrame:
    """(a, b): pairs of a tile in different components whose sizes and bitmaps let them reach the threshold.

    With `best`, a class keeps only that many of its pairs with larger ones of the tiles looked at together, those with the
    smallest share of differing bits.
    """
    t = tiles.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = t.groupBy("key", "band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key", "band")
    parts = F.ceil(F.col("g") / TILE)
    p = F.pmod(F.xxhash64("rep"), parts)
    other = F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda i: F.struct(F.least(i, p).alias("i"), F.greatest(i, p).alias("j")))
    rows = t.join(mixed, ["key", "band"]).withColumn("p", p).withColumn("tile", F.explode(other)).join(classes.select("rep", "bits"), "rep")
    dealt = rows.select("key", "band", "tile.i", "tile.j", "p", "n", "rep", "home", "component", "bits").repartition("key", "band", "i", "j").sortWithinPartitions("key", "band", "i", "j", "n", "rep")

    def near(tiles: pa.Table, tile: np.ndarray) -> Iterator[np.ndarray]:
        n, rep, comp, part, home, i, j = (tiles.column(c).to_numpy() for c in ("n", "rep", "component", "p", "home", "i", "j"))
        two, (reps, local) = i != j, np.unique(rep, return_inverse=True)
        raw = tiles.column("bits").to_pylist()
        width = np.array([len(x) // 8 for x in raw])
        flat, start = np.frombuffer(b"".join(raw), np.uint64), np.cumsum(width) - width
        most = int(n.max()) + 1  # a class's partners stand next to it: those up to 100 / percent times its size
        end = np.searchsorted(tile * most + n, tile * most + np.minimum(100 * n // percent, most - 1), side="right")
        count = end - np.arange(len(n)) - 1
        total = np.cumsum(count)
        at = 0
        while at < len(n):
            stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + AT_ONCE, side="right")))
            x = np.repeat(np.arange(at, stop), count[at:stop])
            y = np.arange(len(x)) - np.repeat(total[at:stop] - count[at:stop] - (total[at - 1] if at else 0), count[at:stop]) + x + 1
            at = stop
            ok = (comp[x] != comp[y]) & (home[x] | home[y]) & (~two[x] | (part[x] != part[y]))
            x, y = x[ok], y[ok]
            _, first = np.unique(local[x] * len(reps) + local[y], return_index=True)
            x, y = x[first], y[first]
            differ = np.zeros(len(x), np.int64)
            shape = width[x] << 16 | width[y]
            for both in np.unique(shape):
                of, low, high = np.flatnonzero(shape == both), both >> 16, both & 0xFFFF
                for some in np.array_split(of, -(-len(of) * high // AT_ONCE)):
                    fold = flat[start[y[some]][:, None] + np.arange(high)]
                    while fold.shape[1] > low:
                        fold = fold[:, : fold.shape[1] // 2] ^ fold[:, fold.shape[1] // 2 :]
                    differ[some] = np.bitwise_count(flat[start[x[some]][:, None] + np.arange(low)] ^ fold).sum(axis=1, dtype=np.int64)
            reach = may_reach(n[x] + n[y], differ, percent)
            x, y, share = x[reach], y[reach], (differ / (n[x] + n[y]))[reach]
            if best:
                order = np.lexsort((share, rep[x]))
                x, y = x[order], y[order]
                first = np.arange(len(x)) - np.searchsorted(rep[x], rep[x]) < best
                x, y = x[first], y[first]
            if len(x):
                yield np.stack([rep[x], rep[y]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tiles, tile in whole_groups(batches, ["key", "band", "i", "j"]):
            for pairs in near(tiles, tile):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs. Links: 100 * intersection >= percent * union."""
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("t"))
    told = cut(describe(rows, words, percent), "shingled")
    sizes = cut(told.select("id", "n"), "sizes")
    real = told.where("n > 0 AND id IS NOT NULL")
    speaker = cut(real.groupBy("id").agg(F.min_by("sid", "t").alias("sid"), F.min_by("n", "t").alias("n")), "speakers")
    class_of = cut(speaker.groupBy("sid", "n").agg(F.min("id").alias("rep")), "classes")
    own = class_of.select(F.col("rep").alias("id"), F.col("sid").alias("own_sid"), F.col("n").alias("own_n"))
    spoken = real.join(own, "id").where("sid = own_sid AND n = own_n").dropDuplicates(["id"])
    classes = cut(spoken.select(F.col("id").alias("rep"), "n", "keys", "bits"), "sets")  # several passes read it
    discard(told)
    tiles = tiles_of(classes, percent)
    near = bounded(neighbours(tiles, percent).distinct(), classes, percent)
    pairs = cut(near.groupBy("b").agg(F.min_by("a", F.struct("differ", "a")).alias("a")).select("a", "b"), "pairs")
    links = verified(pairs, rows, words, percent)
    found = components(links)
    discard(pairs, links)
    for best in (*[BEST] * ROUNDS, None):
        pairs = cut(crossing(tiles, classes, found, percent, best), "pairs")
        if pairs.isEmpty():
            discard(pairs)
            break
        links, before = verified(pairs, rows, words, percent), found
        if not links.isEmpty():
            found = components(found.toDF("a", "b").union(links))
            discard(before)
        discard(pairs, links)
    discard(tiles, classes)
    named = class_of.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("sid", "n", F.coalesce("component", "rep").alias("component"))
    of = speaker.join(named, ["sid", "n"]).select("id", "component")
    out = sizes.join(of, "id", "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))
