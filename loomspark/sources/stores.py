"""Stored tables that are read in part: a folder for them, and tables kept in the order of a key.

An ordered table is Parquet partitioned by `range`, a range of the key; beside it lies a directory with one row for each range,
the rows in it and before it. The ranges are drawn once, when the table is written, and everything else is counted on
what was written. So a page reads the ranges it lies in and no other, however deep it is, and places are dense.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Rows of a range, and ranges that are summed up in one group.
RANGE, RANGES = 100_000, 4096


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all nodes share. Only a session that runs in one process may go without the setting."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        found = "/tmp/checkpoints"
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def running(counts: DataFrame, at: str, n: str, before: str) -> DataFrame:
    """counts, whose `at` is 0, 1, 2 .., with the sum of n in the rows before; by groups of RANGES rows and then over the groups."""
    grouped = counts.withColumn("__group", F.floor(F.col(at) / RANGES))
    sums = grouped.groupBy("__group").agg(F.sum(n).alias("__sum"))
    ahead = lambda w, by, c: F.coalesce(F.sum(c).over(w.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = sums.select("__group", ahead(Window.partitionBy(), "__group", "__sum").alias("__ahead"))  # one row for each RANGES ranges of RANGE rows
    inside = grouped.withColumn(before, ahead(Window.partitionBy("__group"), at, n))
    return inside.join(groups, "__group").withColumn(before, F.col(before) + F.col("__ahead")).drop("__group", "__ahead")


def save_schema(spark: SparkSession, schema: T.StructType, path: str) -> None:
    """Keep a schema beside a table, so that a table without rows can be opened, too."""
    spark.createDataFrame([(schema.json(),)], "schema string").coalesce(1).write.mode("overwrite").parquet(f"{path}.schema")


def open_table(spark: SparkSession, path: str) -> DataFrame:
    """A table whose schema is kept beside it."""
    held = spark.read.schema("schema string").parquet(f"{path}.schema").first()["schema"]
    return spark.read.schema(T.StructType.fromJson(json.loads(held))).parquet(path)


class OrderedTable:
    """A table stored in the order of the columns `by`, the last of which tell all rows apart."""

    def __init__(self, spark: SparkSession, path: str, by: Sequence[str]) -> None:
        self.by = list(by)
        self.rows = open_table(spark, f"{path}/rows")
        self.directory = spark.read.schema("range int, n long, before long").parquet(f"{path}/directory")

    @classmethod
    def write(cls, rows: DataFrame, path: str, by: Sequence[str], per_range: int = RANGE) -> OrderedTable:
        """Store rows in ranges of about per_range rows. Empty tables have no range."""
        if "range" in rows.columns:
            raise ValueError("a column is named range")
        spark = rows.sparkSession
        parts = max(1, -(-rows.count() // per_range))
        dealt = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("range", F.spark_partition_id())
        dealt.write.mode("overwrite").partitionBy("range").parquet(f"{path}/rows")
        save_schema(spark, dealt.schema, f"{path}/rows")
        stored = open_table(spark, f"{path}/rows")
        found = stored.groupBy("range").agg(F.count("*").alias("n"))
        every = spark.range(parts).select(F.col("id").cast("int").alias("range")).join(found, "range", "left").select("range", F.coalesce("n", F.lit(0)).alias("n"))
        running(every, "range", "n", "before").where("n > 0").write.mode("overwrite").parquet(f"{path}/directory")
        return cls(spark, path, by)

    def total(self) -> int:
        return self.directory.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def between(self, first: int, last: int) -> DataFrame:
        """Rows at the places first .. last - 1, counted from 0, in order. Only their ranges are read."""
        held = self.directory.where((F.col("before") < last) & (F.col("before") + F.col("n") > first)).orderBy("before").collect()  # as many as the page has ranges
        if not held:
            return self.rows.where("false").drop("range")
        some = self.rows.where(F.col("range").isin([r["range"] for r in held]))
        return some.orderBy(*self.by).offset(max(0, first - held[0]["before"])).limit(last - max(first, held[0]["before"])).drop("range")

    def page(self, number: int, size: int) -> DataFrame:
        """The rows of one page; pages count from 1."""
        if number < 1 or size < 1:
            raise ValueError("page and per_page start at 1")
        return self.between((number - 1) * size, number * size)

    def placed(self, name: str = "place") -> DataFrame:
        """All rows with their place, counted from 0; ranges are numbered apart."""
        inside = self.rows.withColumn(name, F.row_number().over(Window.partitionBy("range").orderBy(*self.by)) - 1)
        return inside.join(self.directory.select("range", "before"), "range").withColumn(name, F.col(name) + F.col("before")).drop("range", "before")


def places(rows: DataFrame, group: Sequence[str], first: Column, then: Column, rest: Sequence[str], name: str, block: int = 1 << 16) -> DataFrame:
    """rows with their place, counted from 1, within `group` in falling order of `first`, then by `then` and by the number rest[0] (an integer).

    Places are counts: rows with a larger value of `first`, rows of the same value in earlier blocks of `block` numbers, rows ahead in the block.
    No range is sampled, and no task orders more than a block, or the blocks of one value, or the values of one group.
    """
    key = [*group, "__first", "__then", "__block"]
    told = rows.withColumns({"__first": first, "__then": then, "__block": F.floor(F.col(rest[0]) / block)})
    counts = told.groupBy(*key).agg(F.count("*").alias("__n"))
    ahead = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = counts.withColumn("__ahead", ahead(Window.partitionBy(*group, "__first").orderBy("__then", "__block"), "__n"))
    values = counts.groupBy(*group, "__first").agg(F.sum("__n").alias("__n")).withColumn("__more", ahead(Window.partitionBy(*group).orderBy(F.desc("__first")), "__n"))
    offset = within.join(values.drop("__n"), [*group, "__first"]).select(*key, (F.col("__ahead") + F.col("__more")).alias("__before"))
    inside = told.withColumn("__inside", F.row_number().over(Window.partitionBy(*key).orderBy(*rest)))
    return inside.join(offset, key).withColumn(name, F.col("__inside") + F.col("__before")).drop("__first", "__then", "__block", "__inside", "__before")
