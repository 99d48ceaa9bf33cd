"""CSV records with multi-line cells, read in many tasks.

Spark's text reader cuts a file into byte ranges and gives each its whole lines; what it can't know is whether a range starts within quotes. A
line maps the state before it (outside or inside quotes) to the state after it, and so does a range: its map is that of its lines one
after the other. A first pass finds for each range its map and how many records start in it, under either state; the maps are composed along the
file; a second pass, with the right state, joins lines to records. Records within one range are done there, and only the pieces of
records that cross ranges are shuffled. Columns are taken out of whole records by Spark's own CSV functions.

A range is one short row in the table of ranges, which is broadcast: 800,000 rows for 100 TB in ranges of 128 MB.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Lines end with this; a carriage return before it belongs to the line end.
LINE_END = "\n"
OPTIONS = {"quote": '"', "escape": '"'}


def inside_after(line: str, inside: bool) -> bool:
    """Whether a quoted cell is open after the line. A quote opens a cell only at its start; doubled quotes stay inside."""
    if '"' not in line:
        return inside
    at, n = 0, len(line)
    while True:
        if inside or (at < n and line[at] == '"'):
            at = at if inside else at + 1
            while True:
                at = line.find('"', at)
                if at < 0:
                    return True
                if line.startswith('""', at):
                    at += 2
                else:
                    at += 1
                    break
            inside = False
        at = line.find(",", at)
        if at < 0:
            return False
        at += 1


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, line) in the order of the files within each range."""
    raw = spark.read.option("lineSep", LINE_END).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.regexp_replace("value", "\r$", "").alias("line"))


def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, start, out0, out1, starts0, starts1) of each range: state after it and records started in it, from outside and inside."""
    now, state, count = None, [False, True], [0, 0]

    def row() -> pa.RecordBatch:
        values = [[now[0]], [now[1]], [state[0]], [state[1]], [count[0]], [count[1]]]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64()), strict=True)], names=["file", "start", "out0", "out1", "starts0", "starts1"])

    for batch in batches:
        for file, start, line in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if (file, start) != now:
                if now:
                    yield row()
                now, state, count = (file, start), [False, True], [0, 0]
            for k in (0, 1):
                count[k] += not state[k] and line != ""
                state[k] = inside_after(line, state[k])
    if now:
        yield row()


def ranges(found: DataFrame) -> DataFrame:
    """(file, start, inside, before): the state in which each range starts, and the records that start before it.

    A range's map keeps the state, turns it, or forgets it. So the state is that after the last range that forgets, turned as often as a
    range since then turns it.
    """
    by = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    turns, fixed = (F.col("out0") & ~F.col("out1")).cast("int"), F.col("out0") == F.col("out1")
    since = found.withColumns({"turned": F.coalesce(F.sum(turns).over(by), F.lit(0)), "upto": F.sum(turns).over(by.rowsBetween(Window.unboundedPreceding, 0))})
    last = F.last(F.when(fixed, F.struct(F.col("out0").alias("state"), F.col("upto").alias("turned"))), True).over(by)
    known = since.withColumn("last", last)
    inside = F.coalesce(F.col("last.state"), F.lit(False)) != ((F.col("turned") - F.coalesce("last.turned", F.lit(0))) % 2 == 1)
    started = known.withColumn("inside", inside).withColumn("n", F.when(F.col("inside"), F.col("starts1")).otherwise(F.col("starts0")))
    every = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)  # one short row a range
    return started.select("file", "start", "inside", F.coalesce(F.sum("n").over(every), F.lit(0)).alias("before"))


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(record, start, text, whole) of rows (file, start, line, inside, before): records, and in the end of ranges pieces of them."""
    now, inside, number, held, opened = None, False, 0, [], False
    out: list[tuple] = []

    def close(ended: bool) -> None:
        if held:
            out.append((number, now[1], LINE_END.join(held), opened and ended))
            held.clear()

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [[], [], [], []]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.bool_()), strict=True)], names=["record", "start", "text", "whole"])

    for batch in batches:
        for file, start, line, was, before in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if (file, start) != now:
                close(not inside)
                now, inside, number, opened = (file, start), was, before - 1, False
            if not inside:
                close(True)
                if line == "":
                    continue
                number, opened = number + 1, True
            held.append(line)
            inside = inside_after(line, inside)
        if out:
            yield flush()
    close(not inside)
    yield flush()


def records(spark: SparkSession, path: str) -> DataFrame:
    """(conversation_index, text): the CSV records of a file or folder, numbered 0, 1, 2 .. by file and place.

    A quote that is never closed makes the rest of its file one record, as in any CSV reader.
    """
    every = lines(spark, path)
    known = ranges(every.mapInArrow(mapped, "file string, start long, out0 boolean, out1 boolean, starts0 long, starts1 long"))
    told = every.join(F.broadcast(known), ["file", "start"]).select("file", "start", "line", "inside", "before")
    found = told.mapInArrow(pieces, "record long, start long, text string, whole boolean")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda x: x["text"]), LINE_END)
    joined = found.where("NOT whole").groupBy("record").agg(text.alias("text"))
    return found.where("whole").select("record", "text").unionByName(joined).withColumnRenamed("record", "conversation_index")


def column(text: Column, at: int = 0) -> Column:
    """One column of a CSV record."""
    names = ", ".join(f"c{i} string" for i in range(at + 1))
    return F.from_csv(text, names, OPTIONS)[f"c{at}"]
