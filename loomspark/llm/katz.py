"""Katz backoff word bigrams, counted in hash-partitioned tables and evaluated token by token.

The text is lower-cased words and one end token. With history h and word w

    p(w | h) = d(r) r / c(h)          if the training rows hold (h, w) r >= least times
             = alpha(h) p(w)          otherwise
    p(w)     = d(c) c / N             if they hold w, else the unigram mass that discounting frees

d is Good-Turing's r*/r for counts up to K, in Katz's form. `least` is 1 by default, so every pair is
kept; with 2, Katz's own reduction, pairs seen once leave their mass to the backoff. alpha(h) makes the probabilities after
h sum to one exactly over all training words and one unknown word.

Documents are laid out once as blocks: a row holds the token stream of some documents as numbers
into the block's own list of word hashes. Every block asks each hash bucket for the counts of its
distinct words and pairs; a bucket adds up what all blocks hold of its keys and answers each block
in the order asked. So each count travels once per block and key, not once per token, no
table is collected, and a very common word is one key of each block. The buckets follow
the input in number. For alpha, the first block to hold a pair adds its share to the
pair's history.

Words are told apart by 64-bit hashes; pairs by 40 bits within their bucket (about one pair in a
million shares its number with another).

Defined results: null text is the empty text, one end token. Without training rows every
probability is that of one unknown word, 1. Rows without id are scored and not trained on.
Repeated rows count each time. Texts are taken whole; one text is never split over blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, discard, mix64, squeezed, unsqueezed, words_of

K = 5
BLOCK_BYTES = 12 << 20
BUCKET_BYTES = 24 << 20
START, END = 0, 1
#: Hashes of the two local numbers that every block starts with; no word hashes to them.
MARKS = np.array([0x5354415254, 0x454E44], np.uint64)
PAIR_BITS = np.uint64(24)
STATS = -1
REPLY = "block long, bucket int, kind int, data binary"


def blocks(docs: DataFrame) -> DataFrame:
    """One row per block of (id, train, text): ids, train flags, tokens per document, token numbers, word hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        ids: list = []
        train, lengths, tokens, local, size = [], [], [], {}, 0

        def flush() -> pa.RecordBatch:
            nonlocal number, ids, train, lengths, tokens, local, size
            words = np.concatenate([MARKS, np.fromiter((xxhash.xxh64_intdigest(w) for w in local), np.uint64, len(local))])
            out = [[number], [ids], [np.array(train, np.uint8).tobytes()], [np.array(lengths, np.uint32).tobytes()], [squeezed(np.concatenate(tokens).astype(np.uint32))], [words.tobytes()]]
            number, ids, train, lengths, tokens, local, size = number + 1, [], [], [], [], {}, 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4), strict=True)], names=["block", "ids", "train", "lengths", "tokens", "words"])

        for batch in batches:
            for at in range(batch.num_rows):
                words = words_of(batch.column(2)[at].as_py())
                fresh = local.setdefault
                got = np.fromiter((fresh(w, len(local) + 2) for w in words), np.uint32, len(words))
                tokens.append(np.append(got, np.uint32(END)))
                ids.append(batch.column(0)[at].as_py()), train.append(batch.column(1)[at].as_py()), lengths.append(len(words) + 1)
                size += 6 * len(words) + 64
                if size >= BLOCK_BYTES:
                    yield flush()
        if ids:
            yield flush()

    return docs.select("id", "train", "text").mapInArrow(run, "block long, ids array<long>, train binary, lengths binary, tokens binary, words binary")


class Block:
    """A block's arrays: tokens w, their histories h, the document and training flag of each."""

    def __init__(self, train: bytes, lengths: bytes, tokens: bytes, words: bytes, buckets: int) -> None:
        self.w, self.words = unsqueezed(tokens).astype(np.int64), np.frombuffer(words, np.uint64)
        n = np.frombuffer(lengths, np.uint32)
        self.first = np.r_[0, np.cumsum(n)[:-1]].astype(np.int64)
        self.h = np.r_[START, self.w[:-1]]
        self.h[self.first] = START
        self.train = np.repeat(np.frombuffer(train, np.uint8) > 0, n)
        self.n_train, self.buckets = int((np.frombuffer(train, np.uint8) > 0).sum()), buckets

    def word_order(self) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers by bucket and hash, and where each bucket starts."""
        bucket = (mix64(self.words) >> np.uint64(32)).astype(np.int64) % self.buckets
        order = np.lexsort((self.words, bucket))
        return order, np.searchsorted(bucket[order], np.arange(self.buckets + 1))

    def pairs(self, inverse: bool = False) -> None:
        """Distinct (h, w) as numbers, with training counts and hashes, in order of bucket and hash."""
        key = self.h * len(self.words) + self.w
        got = np.unique(key, return_inverse=inverse)
        self.pair, back = got if inverse else (got, None)
        a, b = self.words[self.pair // len(self.words)], self.words[self.pair % len(self.words)]
        mixed = mix64(mix64(a) * np.uint64(3) ^ b)
        bucket = (mixed & np.uint64((1 << 24) - 1)).astype(np.int64) % self.buckets
        print_ = mixed >> PAIR_BITS
        order = np.lexsort((print_, bucket))
        self.pair, self.prints, self.pair_at = self.pair[order], print_[order], np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        self.key = key
        if inverse:
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            self.of = place[back]

    def pair_counts(self) -> np.ndarray:
        seen, n = np.unique(self.key[self.train], return_counts=True)
        out = np.zeros(len(self.pair), np.int64)
        if len(seen):
            at = np.minimum(np.searchsorted(seen, self.pair), len(seen) - 1)
            out = np.where(seen[at] == self.pair, n[at], 0)
        return out


def per_block(frame: pd.DataFrame, buckets: int) -> Iterator[tuple[int, Block]]:
    for block, train, lengths, tokens, words in zip(*(frame[c] for c in ("block", "train", "lengths", "tokens", "words")), strict=True):
        yield block, Block(train, lengths, tokens, words, buckets)


ASK = "bucket int, block long, keys binary, counts binary"


def asked(laid: DataFrame, buckets: int, pairs: bool) -> DataFrame:
    """What each block asks each bucket: its keys there in order, and its own training counts of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                for number, b in per_block(batch.slice(i, 1).to_pandas(), buckets):
                    if pairs:
                        b.pairs()
                        keys, counts, at = b.prints, b.pair_counts(), b.pair_at
                    else:
                        order, at = b.word_order()
                        counts = np.bincount(b.w[b.train], minlength=len(b.words))
                        counts[START] = b.n_train
                        keys, counts = b.words[order], counts[order]
                    held = np.flatnonzero(np.diff(at))  # buckets without a key of the block get no row and no step of the loop
                    rows = [(k, number, pack(keys[x:y], pairs), squeezed(counts[x:y].astype(np.uint32))) for k, x, y in zip(held.tolist(), at[held], at[held + 1], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "block", "keys", "counts"])

    return laid.select("block", "train", "lengths", "tokens", "words").mapInArrow(run, ASK)


def pack(keys: np.ndarray, steps: bool) -> bytes:
    """Sorted keys as 8 bytes each, or as their steps, compressed."""
    if not steps:
        return keys.tobytes()
    gaps = np.diff(keys, prepend=np.uint64(0))
    return squeezed(gaps.astype(np.uint32) if gaps.max() < 1 << 32 else gaps)


def unpack(raw: bytes, steps: bool) -> np.ndarray:
    if not steps:
        return np.frombuffer(raw, np.uint64)
    return np.cumsum(unsqueezed(raw), dtype=np.uint64)


def histogram(counts: np.ndarray) -> bytes:
    """N, V and the numbers of keys seen 1 to K + 1 times."""
    return np.array([counts.sum(), (counts > 0).sum(), *[(counts == r).sum() for r in range(1, K + 2)]], np.int64).tobytes()


def answers(asks: DataFrame, pairs: bool) -> DataFrame:
    """Each bucket's total counts, to each block in the order asked; and a row of count statistics a bucket.

    A pair's answer is twice its count, plus one for the block that owns it: the first one asking
    with a training count.
    """
    kind = int(pairs)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        bucket, blocks_ = table.column("bucket")[0].as_py(), table.column("block").to_pylist()
        keys = [unpack(x, pairs) for x in table.column("keys").to_pylist()]
        own = np.concatenate([unsqueezed(x) for x in table.column("counts").to_pylist()]).astype(np.int64)
        known, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, weights=own, minlength=len(known)).astype(np.int64)
        reply = total[at]
        if pairs:
            owner = np.full(len(known), len(at), np.int64)
            some = np.flatnonzero(own > 0)
            np.minimum.at(owner, at[some], some)
            reply = 2 * reply + (owner[at] == np.arange(len(at)))
            stats = total
        else:
            stats = total[known != MARKS[START]]
        ends = np.cumsum([len(k) for k in keys])
        data = [squeezed(reply[e - len(k) : e].astype(np.uint64 if reply.max() >= 1 << 32 else np.uint32)) for k, e in zip(keys, ends, strict=True)]
        return pa.table([pa.array([*blocks_, STATS]), pa.array([bucket] * (len(data) + 1), pa.int32()), pa.array([kind] * (len(data) + 1), pa.int32()), pa.array([*data, histogram(stats)], pa.binary())], names=["block", "bucket", "kind", "data"])

    return asks.groupBy("bucket").applyInArrow(run, REPLY)


def statistics(replies: DataFrame) -> np.ndarray:
    """N, V, n_1 .. n_K+1 over all buckets. One short row a task reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(K + 3, np.int64)
        for batch in batches:
            for data in batch.column(0):
                total += np.frombuffer(data.as_buffer(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["data"])

    rows = replies.where(F.col("block") == STATS).select("data").mapInArrow(run, "data binary").collect()
    return sum((np.frombuffer(r["data"], np.int64) for r in rows), np.zeros(K + 3, np.int64))


def discounts(n: np.ndarray, least: int) -> np.ndarray:
    """d(0..K) for keys kept from `least` occurrences on; n: numbers of keys seen 1 to K + 1 times."""
    common = (K + 1) * n[K] / n[0] if n[0] else 0.0
    out = np.zeros(K + 1)
    for r in range(least, K + 1):
        turing = (r + 1) * n[r] / (r * n[r - 1]) if n[r - 1] else 1.0
        d = (turing - common) / (1 - common) if common < 1 else 0.0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


class Model:
    """The corpus-wide numbers: unigram and bigram discounts, the unknown word's probability."""

    def __init__(self, words: np.ndarray, pairs: np.ndarray, least: int = 1) -> None:
        self.n, self.v, self.least = int(words[0]), int(words[1]), least
        self.d1, self.d2 = discounts(words[2:], 1), discounts(pairs[2:], least)
        freed = sum((1 - self.d1[r]) * r * int(words[1 + r]) for r in range(1, K + 1))
        self.scale = 1.0 if freed > 0 else self.n / (self.n + 1.0)
        self.unknown = freed / self.n if freed > 0 else 1.0 / (self.n + 1.0)

    def unigram(self, c: np.ndarray) -> np.ndarray:
        seen = np.where(c <= K, self.d1[np.minimum(c, K)], 1.0) * c * (self.scale / max(1, self.n))
        return np.where(c > 0, seen, self.unknown)

    def discounted(self, r: np.ndarray) -> np.ndarray:
        """d(r) r of pairs; 0 for those treated as unseen."""
        return np.where(r <= K, self.d2[np.minimum(r, K)], 1.0) * r

    @staticmethod
    def histories(c: np.ndarray, kept: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(denominator, alpha) of histories with c tokens, kept discounted counts and seen unigram mass."""
        bottom = np.where(kept > c - 0.5, c + 1.0, c).astype(float)
        bottom = np.maximum(bottom, 1.0)
        return bottom, (1.0 - kept / bottom) / np.maximum(1.0 - seen, 1e-300)


def replied(table: pa.Table | pd.DataFrame, kind: int) -> np.ndarray:
    """A block's answers of one kind, bucket after bucket."""
    rows = table[table["kind"] == kind].sort_values("bucket")["data"]
    if kind == 2:
        return np.concatenate([unsqueezed(x).view(np.float64).reshape(-1, 2) for x in rows])
    return np.concatenate([unsqueezed(x) for x in rows]).astype(np.int64)


def shares(laid: DataFrame, replies: DataFrame, model: Model, buckets: int) -> DataFrame:
    """(h, kept, seen): for each history, the discounted counts and unigram mass of its kept pairs."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        got = right.to_pandas()
        parts = []
        for _, b in per_block(left.to_pandas(), buckets):
            order, _at = b.word_order()
            c = np.zeros(len(b.words), np.int64)
            c[order] = replied(got, 0)
            b.pairs()
            told = replied(got, 1)
            mine = np.flatnonzero((told & 1 == 1) & (told >= 2 * model.least))
            h, w = b.pair[mine] // len(b.words), b.pair[mine] % len(b.words)
            kept, seen = (np.bincount(h, weights=x, minlength=len(b.words)).astype(np.float64) for x in (model.discounted(told[mine] >> 1), model.unigram(c[w])))
            at = np.unique(h)
            parts.append(pa.table([pa.array(b.words[at].view(np.int64)), pa.array(kept[at]), pa.array(seen[at])], names=["h", "kept", "seen"]))
        return pa.concat_tables(parts) if parts else pa.table({"h": pa.array([], pa.int64()), "kept": pa.array([], pa.float64()), "seen": pa.array([], pa.float64())})

    each = laid.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, "h long, kept double, seen double")
    return each.groupBy("h").agg(F.sum("kept").alias("kept"), F.sum("seen").alias("seen"))


def history_answers(asks: DataFrame, shared: DataFrame, buckets: int) -> DataFrame:
    """(kept, seen) of every word asked for, to each block in the order asked."""

    def bucket_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy().view(np.uint64)
            bucket = ((mix64(h) >> np.uint64(32)).astype(np.int64) % buckets).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), *batch.columns], names=["bucket", "h", "kept", "seen"])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        h = right.column("h").to_numpy().view(np.uint64)
        order = np.argsort(h)
        h, values = h[order], np.stack([right.column(c).to_numpy()[order] for c in ("kept", "seen")], axis=1)
        out = []
        for raw in left.column("keys").to_pylist():
            key = np.frombuffer(raw, np.uint64)
            got = np.zeros((len(key), 2))
            if len(h):
                at = np.minimum(np.searchsorted(h, key), len(h) - 1)
                got[h[at] == key] = values[at[h[at] == key]]
            out.append(squeezed(got.view(np.uint64)))
        return pa.table([left.column("block"), left.column("bucket"), pa.array([2] * len(out), pa.int32()), pa.array(out, pa.binary())], names=["block", "bucket", "kind", "data"])

    dealt = shared.mapInArrow(bucket_of, "bucket int, h long, kept double, seen double")
    return asks.groupBy("bucket").cogroup(dealt.groupBy("bucket")).applyInArrow(run, REPLY)


def scored(laid: DataFrame, replies: DataFrame, model: Model, buckets: int) -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) of each document."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        got, parts = right.to_pandas(), []
        rows = left.to_pandas()
        for ids, (_, b) in zip(rows["ids"], per_block(rows, buckets), strict=True):
            order, _at = b.word_order()
            c, shares_ = np.zeros(len(b.words), np.int64), np.zeros((len(b.words), 2))
            c[order], shares_[order] = replied(got, 0), replied(got, 2)
            b.pairs(inverse=True)
            bottom, alpha = model.histories(c, shares_[:, 0], shares_[:, 1])
            with np.errstate(divide="ignore"):
                hit = np.log10(model.discounted(replied(got, 1) >> 1))[b.of] - np.log10(bottom)[b.h]
                miss = np.log10(alpha)[b.h] + np.log10(model.unigram(c))[b.w]
            base = np.log10((c + 1.0) / (model.n + (model.v + 1.0)))[b.w]
            known = (c > 0)[b.w]
            n = np.diff(np.r_[b.first, len(b.w)])
            sums = [np.add.reduceat(x, b.first) for x in (known.astype(np.int64), base, np.where(np.isfinite(hit), hit, miss))]
            parts.append(pa.table([pa.array(ids, pa.int64()), pa.array(n), *[pa.array(s) for s in sums]], names=["id", "n_tokens", "n_known", "base_score", "score"]))
        return pa.concat_tables(parts)

    return laid.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, "id long, n_tokens long, n_known long, base_score double, score double")


def score(docs: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text", least: int = 1) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of each row, learning from the rows where train holds.

    Pairs seen fewer than `least` times are left to the backoff; 1 keeps them all.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, math.ceil(size / BUCKET_BYTES))
    laid = cut(blocks(rows), "blocks")
    asks = cut(asked(laid, buckets, False), "asks")
    words = cut(answers(asks, False), "words")
    pairs = cut(answers(asked(laid, buckets, True), True), "pairs")
    model = Model(statistics(words), statistics(pairs), least)
    replies = words.union(pairs).where(F.col("block") != STATS)
    shared = cut(shares(laid, replies, model, buckets), "shares")
    more = cut(history_answers(asks, shared, buckets), "histories")
    discard(asks, shared)
    out = scored(laid, replies.union(more), model, buckets)
    return out.select(F.col("id").alias("doc_id"), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")
