"""Vector columns and the embedder protocol: (text column) -> array<double>, of unit length."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import Text, alpha_tokens

Embedder = Callable[[Text], Column]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def unit(a: Column) -> Column:
    held = F.array(F.struct(a.alias("v"), F.greatest(norm(a), F.lit(1e-12)).alias("n")))  # the length is taken once, not for each component
    return F.transform(held, lambda s: F.transform(s["v"], lambda x: x.cast("double") / s["n"]))[0]


def added(a: Column, b: Column) -> Column:
    return F.when(a.isNull(), b).otherwise(F.zip_with(a, b, lambda x, y: x + y))


def hashing_embedder(dim: int = 64) -> Embedder:
    """Signed feature hashing of the words, in built-in functions."""

    def embed(text: Text) -> Column:
        hashed = F.transform(alpha_tokens(text), lambda w: F.xxhash64(w))
        zero = F.array_repeat(F.lit(0.0), dim)

        def add(acc: Column, h: Column) -> Column:
            at, sign = F.pmod(h, F.lit(dim)).cast("int"), F.when(F.shiftright(h, 40).bitwiseAND(1) == 1, 1.0).otherwise(-1.0)
            return F.transform(acc, lambda x, i: F.when(i == at, x + sign).otherwise(x))

        return F.aggregate(hashed, zero, add, lambda v: F.when(norm(v) > 0, unit(v)).otherwise(v))

    return embed


def mean_pooled(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Masked mean over tokens, then unit length (floor 1e-9)."""
    wide = mask[..., None].astype(np.float32)
    mean = (states * wide).sum(axis=1) / np.maximum(wide.sum(axis=1), 1e-9)
    return mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-9)


def onnx_embed(rows: DataFrame, text: str, model_path: str, tokenizer_path: str, out: str = "embedding", batch: int = 128, most_tokens: int = 256) -> DataFrame:
    """rows with an embedding column from an ONNX encoder and a tokenizers file, an Arrow batch at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import onnxruntime
        from tokenizers import Tokenizer

        session, tokenizer = onnxruntime.InferenceSession(model_path), Tokenizer.from_file(tokenizer_path)
        tokenizer.enable_truncation(most_tokens)
        tokenizer.enable_padding()
        wanted = {x.name for x in session.get_inputs()}
        for frame in frames:
            vectors: list = []
            for at in range(0, len(frame), batch):
                coded = tokenizer.encode_batch(frame[text].fillna("").iloc[at : at + batch].tolist())
                ids, mask = (np.array([getattr(c, k) for c in coded], np.int64) for k in ("ids", "attention_mask"))
                feed = {k: v for k, v in {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}.items() if k in wanted}
                vectors += mean_pooled(session.run(None, feed)[0], mask).tolist()
            yield frame.assign(**{out: vectors})

    from pyspark.sql import types as T

    return rows.mapInPandas(run, T.StructType([*rows.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))]))
