"""SentencePiece encoding and decoding: an Aho-Corasick automaton drives a single-pass Viterbi.

The automaton over the pieces reads the text once. At each position it reports, along its output
links, every piece that ends there, and each one relaxes the best score of that position. The
encoding is the segmentation with the highest sum of the piece scores stored in the model file; a
character that no piece covers costs `unknown` and becomes its bytes' pieces (or the unknown id).

Pieces never hold the blank mark after another character, nor certain characters (line feeds, in
the usual files) beside any other; the text is cut there, which changes no segmentation, and
equal cuts are looked up rather than read again. The lookup table is bounded in bytes and emptied when
it is full; a worker takes SLICE rows of an Arrow batch at once, so it never holds more than their
ids. `transcode` does both directions in one pass and returns figures instead of ids and texts.

Defined results: null and empty text have no ids and score 0 and decode to the empty text. Ties take
the longest last piece. Texts are encoded whole; repeated rows are encoded one by one; other
columns pass through and those named like an output are replaced.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import append_columns

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
PENALTY = 10.0
#: Bytes of the lookup table of a worker (about ENTRY each plus what is stored), and rows taken at once.
CACHE_BYTES, ENTRY = 48 << 20, 300
SLICE = 256


def varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (raw[at] & 127) << shift
        at, shift = at + 1, shift + 7
        if raw[at - 1] < 128:
            return value, at


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol buffer message."""
    at = 0
    while at < len(raw):
        key, at = varint(raw, at)
        kind = key & 7
        if kind == 0:
            value, at = varint(raw, at)
        else:
            size = 4 if kind == 5 else 8 if kind == 1 else 0
            if kind == 2:
                size, at = varint(raw, at)
            value, at = raw[at : at + size], at + size
        yield key >> 3, value


@dataclass(frozen=True)
class Pieces:
    """The piece table of a model file: text, score and type by id, and whether a blank is put in front."""

    text: list[str]
    score: list[float]
    kind: list[int]
    dummy_prefix: bool

    @classmethod
    def load(cls, path: str) -> Pieces:
        text, score, kind, prefix = [], [], [], True
        with open(path, "rb") as file:
            for number, value in fields(file.read()):
                if number == 1:
                    piece = dict(fields(value))
                    text.append(piece[1].decode())
                    score.append(struct.unpack("<f", piece.get(2, bytes(4)))[0])
                    kind.append(piece.get(3, NORMAL))
                elif number == 3:
                    prefix = bool(dict(fields(value)).get(3, 1))
        return cls(text, score, kind, prefix)


class Codec:
    """Encoder and decoder of one model; built once a worker."""

    def __init__(self, pieces: Pieces, cache_bytes: int = CACHE_BYTES) -> None:
        import ahocorasick

        self.pieces, self.most, self.held, self.known = pieces, cache_bytes, 0, {}
        self.automaton = ahocorasick.Automaton()
        plain = [i for i, k in enumerate(pieces.kind) if k in (NORMAL, USER)]
        for i in plain:
            self.automaton.add_word(pieces.text[i], (len(pieces.text[i]), pieces.score[i], i))
        self.automaton.make_automaton()
        self.single = {pieces.text[i] for i in plain if len(pieces.text[i]) == 1}
        self.unknown = min((pieces.score[i] for i in plain), default=0.0) - PENALTY
        self.unknown_id = next((i for i, k in enumerate(pieces.kind) if k == UNKNOWN), 0)
        self.byte_id = {int(pieces.text[i][3:5], 16): i for i, k in enumerate(pieces.kind) if k == BYTE}
        self.id_byte = {i: b for b, i in self.byte_id.items()}
        longer = [pieces.text[i] for i in plain if len(pieces.text[i]) > 1]
        self.whole = any(MARK in x.lstrip(MARK) for x in longer)
        alone = "" if any("\n" in x for x in longer) else "\n"
        self.cuts = re.compile(rf"\n|{MARK}*[^{MARK}\n]+|{MARK}+" if alone else rf"{MARK}*[^{MARK}]+|{MARK}+", re.S)
        self.shown = [x.replace(MARK, " ") if k in (NORMAL, USER) else "" for x, k in zip(pieces.text, pieces.kind, strict=True)]

    def viterbi(self, text: str) -> tuple[list[int], float]:
        """Best ids of a cut and their score."""
        n = len(text)
        best, back = [float("-inf")] * (n + 1), [None] * (n + 1)
        best[0] = 0.0
        done = 0 if not self.single.issuperset(text) else n
        for end, (size, gain, piece) in self.automaton.iter(text):
            while done <= end:
                self.cover(text, done, best, back)
                done += 1
            score = best[end + 1 - size] + gain
            if score > best[end + 1]:
                best[end + 1], back[end + 1] = score, (size, piece)
        while done < n:
            self.cover(text, done, best, back)
            done += 1
        out, at = [], n
        while at:
            size, piece = back[at]
            out.append([piece] if piece >= 0 else self.spelt(text[at - 1]))
            at -= size
        return [i for part in reversed(out) for i in part], best[n]

    def cover(self, text: str, at: int, best: list[float], back: list) -> None:
        """Let a character without a piece of its own pass at the price of an unknown one."""
        if text[at] not in self.single and best[at] + self.unknown > best[at + 1]:
            best[at + 1], back[at + 1] = best[at] + self.unknown, (1, -1)

    def spelt(self, character: str) -> list[int]:
        raw = character.encode("utf-8", "surrogatepass")
        return [self.byte_id[b] for b in raw] if all(b in self.byte_id for b in raw) else [self.unknown_id]

    def encode(self, text: str | None) -> tuple[bytes, float]:
        """Little-endian unsigned 32-bit ids, and the summed score."""
        if not text:
            return b"", 0.0
        marked = (MARK if self.pieces.dummy_prefix else "") + text.replace(" ", MARK)
        ids, total, known = [], 0.0, self.known
        for cut in [marked] if self.whole else self.cuts.findall(marked):
            got = known.get(cut)
            if got is None:
                path, score = self.viterbi(cut)
                got = np.array(path, "<u4").tobytes(), score
                size = ENTRY + 4 * len(cut) + len(got[0])
                if self.held + size > self.most:
                    known.clear()
                    self.held = 0
                if size <= self.most:
                    known[cut] = got
                    self.held += size
            ids.append(got[0])
            total += got[1]
        return b"".join(ids), total

    def decode(self, ids: bytes) -> str:
        """The text of ids; runs of byte pieces are read as UTF-8."""
        numbers, shown = np.frombuffer(ids, "<u4").tolist(), self.shown
        if self.id_byte and not self.id_byte.keys().isdisjoint(numbers):
            parts, raw = [], bytearray()
            for i in numbers:
                if i in self.id_byte:
                    raw.append(self.id_byte[i])
                    continue
                if raw:
                    parts.append(raw.decode("utf-8", "replace"))
                    raw.clear()
                parts.append(shown[i])
            text = "".join(parts) + raw.decode("utf-8", "replace")
        else:
            text = "".join([shown[i] for i in numbers])
        return text[1:] if self.pieces.dummy_prefix and text[:1] == " " else text


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(Pieces.load(path))
    return _CODECS[path]


def encode(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """docs with ids (binary, little-endian unsigned 32-bit), n_ids and score."""

    def make(texts: list[str | None]) -> list:
        coder = codec(model_path)
        got = [coder.encode(t) for t in texts]
        return [pa.array([g[0] for g in got], pa.binary()), pa.array([len(g[0]) // 4 for g in got], pa.int64()), pa.array([g[1] for g in got], pa.float64())]

    return append_columns(docs, [text], [T.StructField("ids", T.BinaryType()), T.StructField("n_ids", T.LongType()), T.StructField("score", T.DoubleType())], make, SLICE)


def decode(docs: DataFrame, model_path: str, ids: str = "ids") -> DataFrame:
    """docs with decoded, the text of their ids; null ids are no ids."""

    def make(values: list[bytes | None]) -> list:
        coder = codec(model_path)
        return [pa.array([coder.decode(v or b"") for v in values], pa.string())]

    return append_columns(docs, [ids], [T.StructField("decoded", T.StringType())], make, SLICE)


def transcode(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """docs with n_ids, ids_crc32, score and round_trip (whether decoding gives the text back), in one pass over the texts."""

    def make(texts: list[str | None]) -> list:
        coder, rows = codec(model_path), []
        for t in texts:
            ids, score = coder.encode(t)
            rows.append((len(ids) // 4, zlib.crc32(ids), score, coder.decode(ids) == (t or "")))
        return [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.bool_()))]

    new = [T.StructField("n_ids", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("round_trip", T.BooleanType())]
    return append_columns(docs, [text], new, make, SLICE)
