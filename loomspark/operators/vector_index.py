"""An inverted-list vector index with exact answers.

Vectors are dealt to the nearest of a number of coarse centroids. A list stores its vectors in blocks, as Parquet partitioned by `list`,
and the table of lists keeps each centroid c and radius r, the largest distance of a member. For any query q and member x

    q . x  =  q . c + q . (x - c)  <=  q . c + |q| r,

so a list whose bound is below the k-th best score found so far holds none of the k nearest. A search reads for each
query the list with the largest bound, takes the k-th score from there, and then the lists whose bounds reach it. Nothing is approximated.

Only the centroids come from a sample: at most SAMPLE vectors, those with the smallest hashes of their keys, equal ones once, through a
few rounds of k-means. Every vector is indexed. Vectors of another length than most, and those with null, infinite or NaN components,
are in the list OTHERS, which each search reads.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..sources.stores import open_table, save_schema
from .retrieval import packed, scores_of

#: Vectors that the centroids are fitted on, rounds of k-means, most lists, and the list of the vectors without a bound.
SAMPLE, ROUNDS, LISTS, OTHERS = 1 << 14, 5, 4096, -1
#: Relative slack of the bounds, far above the rounding of a sum of products.
SLACK = 1e-9
#: Vectors of a block, queries of a block, and blocks of a list that meet queries in one task.
BLOCK, ASKED, PART = 2048, 64, 64


def centroids(sample: np.ndarray, lists: int) -> np.ndarray:
    """Lloyd's rounds from the first `lists` rows; a centroid that loses all its vectors stays where it is."""
    at = sample[:lists].copy()
    for _ in range(ROUNDS):
        of = assigned(sample, at)
        count = np.bincount(of, minlength=len(at))
        sums = np.zeros_like(at)
        np.add.at(sums, of, sample)
        at[count > 0] = sums[count > 0] / count[count > 0][:, None]
    return at


def assigned(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    out, half = np.empty(len(x), np.int64), (at * at).sum(axis=1) / 2
    for i in range(0, len(x), BLOCK):
        out[i : i + BLOCK] = (x[i : i + BLOCK] @ at.T - half).argmax(axis=1)
    return out


def sound(vectors: list, dim: int) -> np.ndarray:
    """Which vectors have that length and finite components only."""
    return np.array([v is not None and len(v) == dim and None not in v and all(map(math.isfinite, v)) for v in vectors], bool)


class VectorIndex:
    """An index below a path, over rows with a key and a vector column."""

    def __init__(self, spark: SparkSession, path: str, key: str) -> None:
        self.path, self.key = path, key
        self.blocks = open_table(spark, f"{path}/blocks")
        self.lists = spark.read.schema("list int, centroid array<double>, radius double, n long").parquet(f"{path}/lists")

    @classmethod
    def build(cls, rows: DataFrame, path: str, key: str, vector: str = "vec", lists: int | None = None) -> VectorIndex:
        """Index all rows. `lists` is the square root of the rows unless given, LISTS at most."""
        spark = rows.sparkSession
        rows = rows.select(F.col(key), F.col(vector).alias("vec"))
        common = rows.where("vec IS NOT NULL").groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
        dim, n = (common["dim"], common["n"]) if common else (0, 0)
        lists = max(1, min(lists or math.isqrt(n), LISTS))
        finite = F.forall("vec", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
        few = rows.where((F.size("vec") == dim) & finite).orderBy(F.xxhash64(key), key).limit(SAMPLE).select("vec").toArrow()
        flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in few.column(0).chunks] or [np.zeros(0)]).astype(np.float64)
        sample = np.unique(flat.reshape(-1, max(dim, 1)), axis=0)
        at = centroids(np.random.default_rng(0).permutation(sample), lists)
        shared = spark.sparkContext.broadcast(at)  # LISTS centroids at most

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                vectors = batch.column(1).to_pylist()
                ok = sound(vectors, dim) & (len(shared.value) > 0)
                of, far = np.full(len(ok), OTHERS, np.int32), np.full(len(ok), np.inf)
                if ok.any():
                    x = np.array([v for v, good in zip(vectors, ok, strict=True) if good], np.float64)
                    near = assigned(x, shared.value)
                    of[ok], far[ok] = near, np.sqrt(((x - shared.value[near]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(of), pa.array(far)], names=["key", "vec", "list", "far"])

        kind = T.StructType([T.StructField("key", rows.schema[key].dataType), rows.schema["vec"], T.StructField("list", T.IntegerType()), T.StructField("far", T.DoubleType())])
        dealt = rows.mapInArrow(deal, kind)
        dealt.write.parquet(f"{path}/dealt")
        dealt = spark.read.schema(kind).parquet(f"{path}/dealt")
        radii = dealt.groupBy("list").agg(F.max("far").alias("radius"), F.count("*").alias("n"))
        table = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(at)] + [(OTHERS, None)], "list int, centroid array<double>")
        table.join(radii, "list").coalesce(1).write.parquet(f"{path}/lists")
        parts = max(1, -(-(n + 1) // (BLOCK * 16)))
        ranged = dealt.repartitionByRange(parts, "list", F.xxhash64("key")).sortWithinPartitions("list")
        sizes = F.broadcast(spark.read.parquet(f"{path}/lists").select("list", shares(F.col("n")).alias("parts")))  # LISTS + 1 rows at most
        made = packed(ranged, "key", "vec", BLOCK, of="list").join(sizes, "list")
        made = made.select("keys", "dim", "data", F.pmod(F.xxhash64(F.col("keys")[0]), F.col("parts")).cast("int").alias("part"), "list")
        made.write.partitionBy("list").parquet(f"{path}/blocks")
        save_schema(spark, made.schema, f"{path}/blocks")
        return cls(spark, path, key)

    def wanted(self, queries: DataFrame, query_key: str, vector: str, least: str | None = None) -> DataFrame:
        """(query_key, list): the list with the largest bound for each query or, given the column `least`, all lists whose bounds reach it.

        OTHERS has no bound, so it is left out of the first and in each of the second. Queries without a bound of their own want all lists.
        """
        held = self.lists.orderBy("list").collect()  # LISTS + 1 rows at most
        real = [r for r in held if r["centroid"] is not None]
        at, radius = np.array([r["centroid"] for r in real], np.float64), np.array([r["radius"] for r in real], np.float64)
        shared = queries.sparkSession.sparkContext.broadcast((np.array([r["list"] for r in held], np.int32), np.array([r["list"] for r in real], np.int32), at, radius))

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            every, number, at, radius = shared.value
            for batch in batches:
                of, lists = [], []
                bounds = batch.column(2).to_pylist()
                for i, v in enumerate(batch.column(1).to_pylist()):
                    mine = every
                    if at.ndim == 2 and sound([v], at.shape[1])[0]:
                        q = np.array(v, np.float64)
                        size = np.sqrt(q @ q)
                        bound = at @ q + size * radius + SLACK * size * (np.sqrt((at * at).sum(axis=1)) + radius)
                        if least is None:
                            mine = number[[int(np.argmax(bound))]]
                        elif bounds[i] is not None:
                            mine = np.union1d(number[~(bound < bounds[i])], every[every == OTHERS])
                    elif least is None:
                        mine = number[:1]
                    of.append(np.full(len(mine), i))
                    lists.append(mine)
                picked = np.concatenate([*of, np.zeros(0, np.int64)]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(picked)), pa.array(np.concatenate([*lists, np.zeros(0, np.int32)]).astype(np.int32))], names=[query_key, "list"])

        schema = T.StructType([queries.schema[query_key], T.StructField("list", T.IntegerType())])
        return queries.select(query_key, vector, F.col(least) if least else F.lit(None).cast("double")).mapInArrow(choose, schema)

    def probed(self, queries: DataFrame, wanted: DataFrame, k: int, query_key: str, vector: str, only: Sequence[int] | None = None) -> DataFrame:
        """(query_key, key, score): the k best of each block of the lists wanted, (query_key, list), by a query.

        Queries that want a list are packed per list and meet its blocks part by part, so a large list is many tasks. `only` names all lists
        wanted, if they are known: then no other partition is read.
        """
        asked = queries.select(query_key, F.col(vector).alias("__q")).join(wanted, query_key)
        parts = asked.repartition("list", F.pmod(F.xxhash64(query_key), F.lit(ASKED))).sortWithinPartitions("list")
        q = packed(parts, query_key, "__q", ASKED, of="list").toDF("list", "asked", "asked_dim", "wanted")
        spread = q.join(F.broadcast(self.lists.select("list", shares(F.col("n")).alias("parts"))), "list").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        schema = T.StructType([queries.schema[query_key], T.StructField(self.key, self.blocks.schema["keys"].dataType.elementType), T.StructField("score", T.DoubleType())])
        names = schema.names
        blocks = self.blocks if only is None else self.blocks.where(F.col("list").isin(*only))
        meet = blocks.join(spread, ["list", "part"]).select("keys", "dim", "data", "asked", "asked_dim", "wanted")
        return meet.mapInArrow(lambda batches: scores_of(batches, k, names), schema)

    def least(self, near: DataFrame, k: int, query_key: str) -> DataFrame:
        """(query_key, __least): the k-th score of the queries that have k scores."""
        return self.ranked(near, k, query_key).where((F.col("rank") == k) & F.col("score").isNotNull() & ~F.isnan("score")).select(query_key, F.col("score").alias("__least"))

    def ranked(self, near: DataFrame, k: int, query_key: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("score"), F.col(self.key)))
        return near.withColumn("rank", place).where(F.col("rank") <= k).select(query_key, "rank", self.key, "score")

    def search(self, queries: DataFrame, k: int, query_key: str, vector: str = "vec") -> tuple[DataFrame, DataFrame]:
        """The answers of top_k_batch, and (query_key, lists, read): how many lists there are and how many the query reads."""
        first = self.probed(queries, self.wanted(queries, query_key, vector), k, query_key, vector)
        known = queries.join(self.least(first, k, query_key), query_key, "left")
        wanted = self.wanted(known, query_key, vector, "__least")
        read = wanted.groupBy(query_key).agg(F.count("*").alias("read")).withColumn("lists", F.lit(self.lists.count()).cast("long"))
        return self.ranked(self.probed(queries, wanted, k, query_key, vector), k, query_key), read.select(query_key, "lists", "read")

    def top_k_batch(self, queries: DataFrame, k: int, query_key: str, vector: str = "vec") -> DataFrame:
        """(query_key, rank, key, score): the k vectors with the largest inner product for each query, ties by key; as retrieval.top_k_batch."""
        return self.search(queries, k, query_key, vector)[0]

    def top_k(self, query: Sequence[float], k: int) -> DataFrame:
        """(rank, key, score): the k nearest vectors of one query. Only the partitions of the lists it wants are read."""
        one = self.blocks.sparkSession.createDataFrame([(0, [float(x) for x in query])], "__query int, vec array<double>")
        some = [r["list"] for r in self.wanted(one, "__query", "vec").collect()]
        wanted = lambda lists: one.select("__query", F.explode(F.lit(lists)).alias("list")) if lists else one.select("__query", F.lit(OTHERS).alias("list"))
        known = one.join(self.least(self.probed(one, wanted(some), k, "__query", "vec", some), k, "__query"), "__query", "left")
        lists = [r["list"] for r in self.wanted(known, "__query", "vec", "__least").collect()]
        return self.ranked(self.probed(one, wanted(lists), k, "__query", "vec", lists), k, "__query").drop("__query")


def shares(n: Column) -> Column:
    """In how many parts a list of n vectors is."""
    return F.ceil(n / (BLOCK * PART)).cast("int")
