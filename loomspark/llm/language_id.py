"""Language identification by prediction by partial matching (PPM).

Each language owns a context tree: counts of the byte that follows every context of 0 to ORDER
bytes. The statistics are frozen after fitting. The code length of a byte is exact: it walks from
the longest context that the tree knows, pays the escape probability d/(n+d) (n: occurrences,
d: distinct followers, "method C") for each context that has never seen the byte, and ends in a
uniform order -1. The language whose tree codes the text in the fewest bits is predicted.

Fitting uses a bounded sample of labelled rows: `docs_per_language` different texts of each language,
picked by a hash of the text; copies count once. Texts longer than `max_sample_chars` are used, whole,
only where a language has too few shorter ones. Everything else reads all rows.

Defined results: null text, or a text without any letter, gives `und` and score 0; so does a model
without languages. Ties go to the language that sorts first. Very long texts are scored whole, in
windows that carry the context over. Repeated rows are scored one by one. Other columns pass
through; a column named like an output is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .shared import append_columns

ORDER = 4
#: Rows that a worker takes at once.
SLICE = 1000
LETTER = re.compile(r"[^\W\d_]")
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def text_bytes(text: str) -> bytes:
    """What the trees see: lower-cased UTF-8, opened by ORDER zero bytes as the starting context."""
    return b"\0" * ORDER + text.lower().encode("utf-8", "surrogatepass")


def gram_keys(data: np.ndarray, order: int, start: int) -> np.ndarray:
    """The order+1 bytes ending at each position from start on, as one integer."""
    key = np.zeros(len(data) - start, np.uint64)
    for back in range(order, -1, -1):
        key = (key << np.uint64(8)) | data[start - back : len(data) - back]
    return key


@dataclass
class Lookup:
    """Open addressing over unsigned keys; find() gives row numbers, -1 for a key that is not there."""

    keys: np.ndarray
    slots: np.ndarray = field(init=False)
    shift: np.uint64 = field(init=False)

    def __post_init__(self) -> None:
        bits = max(4, int(np.ceil(np.log2(max(1, len(self.keys)) * 3))))
        self.shift, self.slots = np.uint64(64 - bits), np.full(1 << bits, -1, np.int32)
        rows, at = np.arange(len(self.keys), dtype=np.int32), (self.keys * MULTIPLIER) >> self.shift
        while len(rows):
            free = self.slots[at] < 0
            self.slots[at[free]] = rows[free]
            lost = self.slots[at] != rows
            rows, at = rows[lost], (at[lost] + np.uint64(1)) & np.uint64(len(self.slots) - 1)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(wanted), -1, np.int32)
        at = (wanted * MULTIPLIER) >> self.shift
        out = self.slots[at]
        open_ = np.flatnonzero((out >= 0) & (self.keys[out] != wanted))
        while len(open_):
            at[open_] = (at[open_] + np.uint64(1)) & np.uint64(len(self.slots) - 1)
            out[open_] = self.slots[at[open_]]
            rest = out[open_]
            open_ = open_[(rest >= 0) & (self.keys[rest] != wanted[open_])]
        return out


@dataclass
class PpmModel:
    """Frozen trees of all languages, with code lengths in bits already resolved for every known gram."""

    languages: list[str]
    grams: list[Lookup]
    bits: list[np.ndarray]
    contexts: list[Lookup]
    escapes: list[np.ndarray]

    @classmethod
    def from_counts(cls, languages: list[str], orders: np.ndarray, keys: np.ndarray, langs: np.ndarray, counts: np.ndarray) -> PpmModel:
        n = len(languages)
        grams, bits, contexts, escapes = [], [], [], []
        for k in range(ORDER + 1):
            mine = orders == k
            known, at = np.unique(keys[mine], return_inverse=True)
            seen = np.zeros((len(known), n))
            np.add.at(seen, (at, langs[mine]), counts[mine])
            heads, of = np.unique(known >> np.uint64(8), return_inverse=True)
            total, distinct = np.zeros((len(heads), n)), np.zeros((len(heads), n))
            np.add.at(total, of, seen)
            np.add.at(distinct, of, (seen > 0).astype(float))
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(distinct / (total + distinct)), 0.0)
                direct = -np.log2(seen / (total + distinct)[of])
            if k == 0:
                shorter = np.full((len(known), n), 8.0)
            else:
                shorter = bits[-1][grams[-1].find(known & np.uint64((1 << 8 * k) - 1))]
            grams.append(Lookup(known))
            contexts.append(Lookup(heads))
            bits.append(np.where(seen > 0, direct, escape[of] + shorter).astype(np.float32))
            escapes.append(escape.astype(np.float32))
        return cls(languages, grams, bits, contexts, escapes)

    def code_lengths(self, data: np.ndarray, start: int) -> np.ndarray:
        """Bits of each byte from start on, a column a language."""
        n = len(data) - start
        full = gram_keys(data, ORDER, start)
        out = np.zeros((n, len(self.languages)), np.float32)
        left = np.arange(n)
        for k in range(ORDER, -1, -1):
            key = full[left] if k == ORDER else full[left] & np.uint64((1 << 8 * (k + 1)) - 1)
            at = self.grams[k].find(key)
            hit = at >= 0
            if hit.all():
                out[left] += self.bits[k][at]
                return out
            out[left[hit]] += self.bits[k][at[hit]]
            left, key = left[~hit], key[~hit]
            head = self.contexts[k].find(key >> np.uint64(8))
            some = head >= 0
            out[left[some]] += self.escapes[k][head[some]]
        out[left] += np.float32(8.0)
        return out

    def totals(self, texts: list[bytes], window: int = 1 << 20) -> np.ndarray:
        """Bits of each whole text, a row a text; texts are laid end to end and cut into windows."""
        out = np.zeros((len(texts), len(self.languages)))
        lengths = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(lengths)
        i = 0
        while i < len(texts):
            base = ends[i] - lengths[i]
            j = max(i + 1, int(np.searchsorted(ends, base + window, "right")))
            data = np.frombuffer(b"".join(texts[i:j]), np.uint8).astype(np.uint64)
            owner = np.repeat(np.arange(i, j), lengths[i:j])
            inside = np.arange(len(data)) - np.repeat(ends[i:j] - lengths[i:j] - base, lengths[i:j]) >= ORDER
            for a in range(ORDER, len(data), window):
                b = min(len(data), a + window)
                cost = self.code_lengths(data[a - ORDER : b], ORDER) * inside[a:b, None]
                who = owner[a:b]
                first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
                out[who[first]] += np.add.reduceat(cost, first, axis=0, dtype=np.float64)
            i = j
        return out


def windows(data: bytes, size: int = 1 << 16) -> Iterator[np.ndarray]:
    """data in pieces that begin with the ORDER bytes before them."""
    for at in range(ORDER, len(data), size):
        yield np.frombuffer(data[at - ORDER : at + size], np.uint8).astype(np.uint64)


def gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(order, key, lang) counts of each batch of (lang, text)."""
    for batch in batches:
        table = batch.to_pandas()
        for lang, rows in table.groupby("lang"):
            for k in range(ORDER + 1):
                parts = (gram_keys(part, k, ORDER) for t in rows["text"] for part in windows(text_bytes(t)))
                while some := list(islice(parts, 64)):
                    key, count = np.unique(np.concatenate(some), return_counts=True)
                    yield pa.RecordBatch.from_pydict({"order": pa.array(np.full(len(key), k, np.int32)), "key": pa.array(key.astype(np.int64)), "lang": pa.array([lang] * len(key), pa.string()), "count": pa.array(count)})


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", docs_per_language: int = 160, max_sample_chars: int = 20_000) -> PpmModel:
    """Trees from a bounded sample of the labelled rows of docs.

    At most docs_per_language different texts a language are used, longer ones than max_sample_chars
    characters only where there are too few others; what reaches the driver is their gram counts.
    """
    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where(F.col("lang").isNotNull() & (F.length("text") > 0))
    marked = rows.withColumns({"draw": F.xxhash64("text", F.lit(20240229)), "long": F.length("text") > max_sample_chars})
    different = marked.select("lang", "long", "draw").distinct()
    sizes = different.groupBy("lang").agg(F.count_if(~F.col("long")).alias("short"), F.count_if("long").alias("long")).collect()
    if not sizes:
        return PpmModel.from_counts([], *[np.zeros(0, t) for t in (np.int32, np.uint64, np.int64, np.int64)])

    def share(of: str) -> Column:
        return F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, 2.0 * docs_per_language / max(1, r[of])) if of == "short" or r["short"] < docs_per_language else -1.0)])[F.col("lang")]

    near = marked.where(F.pmod("draw", F.lit(1 << 30)) / F.lit(float(1 << 30)) <= F.when(F.col("long"), share("long")).otherwise(share("short")))
    ranked = near.select("lang", "long", "draw").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("long", "draw")))
    picked = ranked.where(F.col("rank") <= docs_per_language).select("lang", "long", "draw")
    sample = near.join(F.broadcast(picked), ["lang", "long", "draw"]).groupBy("lang", "draw").agg(F.min("text").alias("text")).select("lang", "text")
    counted = sample.mapInArrow(gram_counts, "order int, key long, lang string, count long").groupBy("order", "key", "lang").agg(F.sum("count").alias("count")).toPandas()
    languages = sorted(r["lang"] for r in sizes)
    number = {x: i for i, x in enumerate(languages)}
    return PpmModel.from_counts(languages, counted["order"].to_numpy(), counted["key"].to_numpy().astype(np.uint64), counted["lang"].map(number).to_numpy().astype(np.int64), counted["count"].to_numpy())


def identify(docs: DataFrame, model: PpmModel, text: str = "text") -> DataFrame:
    """docs with lang_pred, score (the posterior of that language under equal priors) and bits_per_byte."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(texts: list[str | None]) -> list:
        trees = shared.value
        pick = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if trees.languages else []
        lang, score, per_byte = ["und"] * len(texts), [0.0] * len(texts), [None] * len(texts)
        if pick:
            coded = [text_bytes(texts[i]) for i in pick]
            bits = trees.totals(coded)
            best = bits.argmin(axis=1)
            least = bits[np.arange(len(pick)), best]
            post = 1.0 / np.exp2(np.maximum(least[:, None] - bits, -1000.0)).sum(axis=1)
            for i, b, p, x, c in zip(pick, best, post, least, coded, strict=True):
                lang[i], score[i], per_byte[i] = trees.languages[b], float(p), float(x) / (len(c) - ORDER)
        return [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(per_byte, pa.float64())]

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())]
    return append_columns(docs, [text], fields, make, SLICE)
