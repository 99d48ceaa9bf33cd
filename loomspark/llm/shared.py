"""Helpers that several operators use: word splitting, appended columns, cut lineage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a maximal run of anything but these six ASCII characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a session that runs in one process may go without the setting."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        found = "/tmp/checkpoints"
    return found.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back, so later plans start from the files."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete what cut() wrote, once nothing reads it any more."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.inputFiles()[0]).getParent() if table.inputFiles() else None
        if path:
            path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once a row, however often `use` names it and wherever a filter is moved to."""
    return F.transform(F.array(value), use)[0]


def squeezed(values: np.ndarray) -> bytes:
    """Integers as bytes: planes of equal significance, compressed."""
    width = values.dtype.itemsize
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).view(np.uint8).reshape(-1, width).T.tobytes())


def unsqueezed(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), np.uint8).reshape(raw[0], -1)
    return np.ascontiguousarray(planes.T).view(f"<u{raw[0]}").ravel()


def words_of(text: str | None, fold: bool = True) -> list[bytes]:
    """Words as UTF-8 bytes. bytes.split() splits on exactly the six ASCII blanks, bytes.lower() folds A-Z only."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    return (raw.lower() if fold else raw).split()


def small(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most `rows` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def append_columns(df: DataFrame, inputs: list[str], fields: list[T.StructField], make: Callable[..., list], at_once: int = 10_000) -> DataFrame:
    """df with further columns from make(*input columns as Python lists), called with at most at_once rows.

    A column of df whose name is taken by a new field is replaced.
    """
    new = [f.name for f in fields]
    kept = [c for c in df.columns if c not in new]
    schema = T.StructType([f for f in df.schema.fields if f.name in kept] + fields)
    read = df.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"`{c}`").alias(f"__in_{i}") for i, c in enumerate(inputs)])
    n = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, at_once):
            made = make(*[batch.column(n + i).to_pylist() for i in range(len(inputs))])
            columns = [batch.column(i) for i in range(n)] + [x if isinstance(x, pa.Array) else pa.array(x) for x in made]
            yield pa.RecordBatch.from_arrays(columns, names=kept + new)

    return read.mapInArrow(run, schema)


def remainder(column: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod."""
    return F.crc32(column.cast("string").cast("binary")) % F.lit(mod)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
