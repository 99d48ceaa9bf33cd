"""Tokenising and bounded-space online best-fit packing.

Pieces arrive one by one and go to the open sequence whose free space is the smallest that still
holds them. A fixed number of sequences is open at once; their free spaces are marked in one
bitset, so the best fit is the lowest set bit at or above the length. When a further sequence is
needed and all places are taken, the fullest one closes.

Defined results: null text is the empty text (just the end id). Only documents over the capacity
are cut. Repeated rows are packed as separate rows. Empty tables give empty tables. Pieces are
dealt to packers by a hash; each packer sees its pieces longest first, then by id, so a lost task
packs the same again.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut, small

END_ID = 1
#: Signs that the tokenizer separates from letters before them and keeps together.
SIGNS = b".,;:!?*#$%&"
CAPACITY = 4096
OPEN_BINS = 2048
TOKENS_PER_PACKER = 1 << 25
#: Runs that a task keeps the ids of, about 300 bytes each; they go with the task, as the next one meets other rare words.
MOST_RUNS = 600_000
#: Runs of letters that the tokenizer is given as one text.
AT_ONCE = 256


class WordTokens:
    """Token ids of texts, by a cache of blank-free runs.

    The tokenizer never joins what a blank separates, so a text's ids are the ids of its
    blank-separated runs in order. When the cache would hold over `most` runs, only those
    of the texts in hand stay.
    """

    def __init__(self, path: str, most: int = MOST_RUNS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.known: dict[bytes, bytes] = {}

    def code(self, runs: list[bytes]) -> None:
        """Enter the ids of runs; AT_ONCE runs of letters go as one text, which counts only if each came out as one word."""
        known, alone, letters = self.known, [], []
        for run in runs:
            text = run.decode()
            (letters if text.isalpha() else alone).append((run, text))
        for at in range(0, len(letters), AT_ONCE):
            some = letters[at : at + AT_ONCE]
            coded = self.tokenizer.encode(" ".join([t for _, t in some]), add_special_tokens=False)
            edge = [0, *(np.flatnonzero(np.diff(coded.word_ids)) + 1).tolist(), len(coded.ids)]
            if len(edge) - 1 != len(some):
                alone += some
                continue
            ids = array("I", coded.ids).tobytes()
            known.update((run, ids[4 * x : 4 * y]) for (run, _), x, y in zip(some, edge, edge[1:], strict=False))
        coded = self.tokenizer.encode_batch([t for _, t in alone], add_special_tokens=False)
        known.update((run, array("I", c.ids).tobytes()) for (run, _), c in zip(alone, coded, strict=True))

    def learn(self, split: list[list[bytes]]) -> None:
        """Code all runs of these texts that aren't known; letters with common signs behind them are coded as the two parts the tokenizer makes of them."""
        new = {r for runs in split for r in runs if r not in self.known}
        if len(self.known) + 2 * len(new) > self.most:
            self.known = {r: self.known[r] for runs in split for r in runs if r in self.known}
        known, parts = self.known, {}
        for run in new:
            stem = run.rstrip(SIGNS)
            if len(stem) < len(run) and stem.decode().isalpha():
                parts[run] = stem, run[len(stem) :]
        self.code(list({x for run in new for x in parts.get(run, (run,)) if x not in known}))
        known.update((run, known[stem] + known[tail]) for run, (stem, tail) in parts.items())

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, END_ID last."""
        end = np.array([END_ID], "<u4").tobytes()
        raw = [t.encode("utf-8", "replace") if t else b"" for t in texts]
        # lower case as the tokenizer does, but for its special tokens
        split = [(r if b"<|" in r else r.lower()).split() for r in raw]
        self.learn(split)
        get = self.known.__getitem__
        return [b"".join([*map(get, runs), end]) for runs in split]


_TOKENIZERS: dict[str, WordTokens] = {}


def tokenize(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (binary, little-endian unsigned 32-bit)."""
    kind = docs.schema[doc_id].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _TOKENIZERS:
            _TOKENIZERS[tokenizer_path] = WordTokens(tokenizer_path)
        coder = _TOKENIZERS[tokenizer_path]
        for batch in small(batches, 1000):
            rows, pieces, starts, lengths, parts = [], [], [], [], []
            for i, ids in enumerate(coder.ids(batch.column(1).to_pylist())):
                for k, a in enumerate(range(0, len(ids) // 4, capacity)):
                    part = ids[4 * a : 4 * (a + capacity)]
                    rows.append(i), pieces.append(k), starts.append(a), lengths.append(len(part) // 4), parts.append(part)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(parts, pa.binary())], names=schema.names)
        coder.known = {}

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


class BestFit:
    """Online best-fit over at most open_bins open sequences."""

    def __init__(self, capacity: int, open_bins: int) -> None:
        self.capacity, self.open_bins = capacity, open_bins
        self.free_bits, self.by_free, self.n_open, self.opened = 0, {}, 0, 0

    def put(self, length: int) -> tuple[int, int]:
        """(sequence number, offset in it) of a piece."""
        fits = self.free_bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            number = self.take(free)
        else:
            if self.n_open == self.open_bins:
                self.take((self.free_bits & -self.free_bits).bit_length() - 1)
            free, number = self.capacity, self.opened
            self.opened += 1
        if free > length:
            rest = free - length
            self.by_free.setdefault(rest, []).append(number)
            self.free_bits |= 1 << rest
            self.n_open += 1
        return number, self.capacity - free

    def take(self, free: int) -> int:
        """Remove one open sequence with that free space."""
        stack = self.by_free[free]
        number = stack.pop()
        if not stack:
            self.free_bits ^= 1 << free
        self.n_open -= 1
        return number


def pack(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, tokens_per_packer: int = TOKENS_PER_PACKER, order: tuple[str, ...] = ("doc_id", "piece"), length: str = "length") -> DataFrame:
    """pieces with sequence_id and offset; every piece's length must be 1 to capacity.

    The number of packers follows the tokens in hand, each packing about tokens_per_packer of
    them, so neither a packer's work nor the share of half-filled sequences grows with the input.
    """
    held = cut(pieces, "pieces")
    total = held.agg(F.sum(length)).first()[0] or 0
    packers = max(1, -(-total // tokens_per_packer))
    kept = [c for c in held.columns if c not in ("sequence_id", "offset")]
    schema = T.StructType([held.schema[c] for c in kept] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    packer: Column = F.pmod(F.xxhash64(*order), F.lit(packers))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fits: dict[int, BestFit] = {}
        for frame in frames:
            ids, offsets = [], []
            for who, n in zip(frame["__packer"], frame[length], strict=True):
                if who not in fits:
                    fits = {who: BestFit(capacity, open_bins)}
                fit = fits[who]
                number, offset = fit.put(int(n))
                ids.append((int(who) << 40) | number)
                offsets.append(offset)
            yield frame[kept].assign(sequence_id=ids, offset=offsets)

    dealt = held.select(*kept).withColumn("__packer", packer).repartition(int(packers), "__packer")
    return dealt.sortWithinPartitions("__packer", F.desc(length), *order).mapInPandas(run, schema)
