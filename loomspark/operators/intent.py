"""Intent classification: generated training rows, TF-IDF blocks, multinomial logistic regression, reject option."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType
from pyspark.sql.window import Window

#: Ranges of nearest_rank; a given number keeps both reads of the ranges alike.
PARTS = 32
CLASSES = ("reminder", "emotional-support", "action-item", "small-talk")
#: Own default templates and slot values; both are arguments.
TEMPLATES = {
    "reminder": ("remind me to {task} {when}", "i must not forget to {task} {when}, remind me", "a reminder {when}: {task}", "please remember that i have to {task} {when}", "can you ping me {when} about {topic}", "i need an alert {when} so i {task}"),
    "emotional-support": ("{topic} leaves me {feeling}", "everything feels {feeling} since {topic} went wrong", "i'm {feeling} and don't know what to do", "it hurts, i am really {feeling}", "nobody understands how {feeling} i am about {topic}", "i can't sleep, i'm too {feeling}"),
    "action-item": ("we should {task} and send {person} the result", "please {task} and report to {person}", "{person} has to {task} by {when}", "action point: {task}", "next step is that {person} will {task}", "assign {person} to {task} before {when}"),
    "small-talk": ("hey, how was your weekend", "did you see {topic} last night", "nice weather, {person} said it stays sunny", "what music do you like these days", "haha {person} told me the same about {topic}", "how is {person} doing, long time no see"),
}
SLOTS = {
    "task": ("call the bank", "buy milk", "finish the report", "book the flight", "water the plants", "review the draft", "pay the rent", "fix the printer", "clean the kitchen", "update the slides"),
    "when": ("tomorrow", "at noon", "on friday", "next week", "tonight", "in an hour", "on monday morning", "by five"),
    "topic": ("the exam", "my job", "the match", "the move", "the new show", "my sister", "the project", "the party"),
    "feeling": ("sad", "lonely", "anxious", "overwhelmed", "hopeless", "worried", "hurt", "exhausted"),
    "person": ("anna", "ben", "the team", "my boss", "carla", "david", "the trainee", "my neighbour"),
}
OPENERS = ("", "hey, ", "um, ", "so ", "okay, ", "well, ")
TAILS = ("", "!", ".", " please", "...")
#: Own rows on the border of two classes; each is added as it is and once more augmented.
HARD_CASES = {
    "reminder": ("don't let it slip my mind", "i always forget the bins, nudge me", "put friday's deadline in my calendar", "wake me before the call"),
    "emotional-support": ("i just need someone to listen", "nothing went right and i want to cry", "the report broke me today", "i miss how things were"),
    "action-item": ("i'll take the slides, you take the numbers", "the contract has to be out by five", "let's close this ticket today", "someone has to call the client"),
    "small-talk": ("i forgot how good that show is", "i'm not sad it rained, it was nice", "the meeting was funny today", "anything fun planned"),
}
#: Words and what the augmentation may put in their place, and its fillers; both are arguments.
SYNONYMS = {"report": ("memo", "write-up"), "call": ("phone", "speak to"), "we should": ("we ought to", "it is time to"), "tomorrow": ("the day after today",), "really": ("truly", "deeply")}
FILLERS = ("er", "actually", "anyway", "you know", "right then", "by the way")


def picked(values: Sequence[str], salt: str, seed: int) -> Column:
    """One of values, by a seeded hash of the row's intent, template and number."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(F.xxhash64("intent", "i", "n", F.lit(salt), F.lit(seed)), F.lit(len(values))) + 1).cast("int"))


def changed(text: Column, turn: str, seed: int, synonyms: Mapping[str, Sequence[str]], fillers: Sequence[str]) -> Column:
    """One change of a text, or none: a synonym, a filler at an end, another case, other punctuation."""
    swaps = [F.when(F.lower(text).contains(w), F.regexp_replace(text, f"(?i){w}", picked(to, f"{turn} {w}", seed))) for w, to in synonyms.items()]
    filler = picked(fillers, f"{turn} filler", seed)
    placed = F.when(picked(("front", "end"), f"{turn} place", seed) == "front", F.concat_ws(" ", filler, text)).otherwise(F.concat_ws(" ", text, filler))
    first = F.concat(F.upper(F.left(text, F.lit(1))), F.substring(text, 2, 1_000_000))
    cased = F.when(picked(("first", "all"), f"{turn} case", seed) == "first", first).otherwise(F.upper(text))
    ended = F.concat(F.rtrim(text), picked((" ?!", " :)", ";", " -", ".."), f"{turn} end", seed))
    change = picked(("none", "synonym", "filler", "case", "end"), f"{turn} change", seed)
    return F.when(change == "synonym", F.coalesce(*swaps, text)).when(change == "filler", placed).when(change == "case", cased).when(change == "end", ended).otherwise(text)


def augmented(text: Column, seed: int, synonyms: Mapping[str, Sequence[str]] = SYNONYMS, fillers: Sequence[str] = FILLERS) -> Column:
    """Up to two changes of a text, each computed once a row (bound by an array of one)."""

    def once(value: Column, turn: str) -> Column:
        return F.transform(F.array(value), lambda x: changed(x, turn, seed, synonyms, fillers))[0]

    return F.trim(once(once(text, "first"), "second"))


def generated(spark: SparkSession, per_class: int = 300, seed: int = 42, templates: Mapping[str, Sequence[str]] = TEMPLATES, slots: Mapping[str, Sequence[str]] = SLOTS, hard: Mapping[str, Sequence[str]] = HARD_CASES) -> DataFrame:
    """(id, text, intent): per_class distinct augmented fillings of the templates of each class, picked by a seeded hash, and the hard cases plain and augmented; same rows on every run."""
    rows = spark.createDataFrame([(k, i, t) for k, ts in templates.items() for i, t in enumerate(ts)], "intent string, i int, template string")
    text = F.concat(picked(OPENERS, "opener", seed), F.col("template"), picked(TAILS, "tail", seed))
    for name, values in slots.items():
        text = F.replace(text, F.lit("{" + name + "}"), picked(values, name, seed))
    numbered = rows.join(F.broadcast(spark.range(4 * per_class).withColumnRenamed("id", "n")), F.lit(True))
    filled = numbered.withColumn("text", text).select("intent", augmented(F.col("text"), seed).alias("text")).distinct()
    place = F.row_number().over(Window.partitionBy("intent").orderBy(F.xxhash64("text", F.lit(seed)), "text"))
    kept = filled.withColumn("n", place).where(F.col("n") <= per_class).select("intent", "text", F.lit("template").alias("kind"))
    if hard:
        cases = spark.createDataFrame([(k, i, 0, t) for k, ts in hard.items() for i, t in enumerate(ts)], "intent string, i int, n long, text string")
        kept = kept.union(cases.select("intent", "text", F.lit("hard"))).union(cases.select("intent", augmented(F.col("text"), seed), F.lit("augmented")))
    return kept.select(F.xxhash64("intent", "text", "kind").alias("id"), "text", "intent")


def split(rows: DataFrame, share: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Exactly stratified training and test rows, by a seeded hash within each label."""
    w = Window.partitionBy("intent")
    marked = rows.withColumns({"r": F.row_number().over(w.orderBy(F.xxhash64("id", F.lit(seed)), "id")), "n": F.count("*").over(w)}).withColumn("train", F.col("r") <= F.round(F.col("n") * share)).drop("r", "n")
    return marked.where("train").drop("train"), marked.where("NOT train").drop("train")


def grams(tokens: Column, sizes: Sequence[int], glue: str) -> Column:
    return F.concat(*[slices(tokens, n, glue) for n in sizes])


def slices(tokens: Column, n: int, glue: str) -> Column:
    at = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.array_join(F.slice(tokens, i, n), glue))


def features(rows: DataFrame) -> DataFrame:
    """rows with word 1-2-grams and padded character 3-5-grams of each word."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    blanks = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")
    letters = F.flatten(F.transform(blanks, lambda w: grams(F.split(F.concat(F.lit(" "), w, F.lit(" ")), ""), (3, 4, 5), "")))
    return rows.withColumns({"words": grams(words, (1, 2), " "), "letters": letters})


def weights(train: DataFrame, column: str, max_df: float, most: int) -> tuple[list[str], list[float]]:
    """Vocabulary (the most frequent terms, bounded by `most`) and idf = ln((1+n)/(1+df)) + 1 of each."""
    n = train.count()
    every = train.select(F.explode(column).alias("t"), F.lit(0).alias("df"), F.lit(1).alias("tf"))
    once = train.select(F.explode(F.array_distinct(column)).alias("t"), F.lit(1).alias("df"), F.lit(0).alias("tf"))
    terms = every.union(once).groupBy("t").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))
    kept = terms.where(F.col("df") <= max_df * n).orderBy(F.desc("tf"), "t").limit(most).withColumn("idf", F.log((1 + n) / (1 + F.col("df"))) + 1).orderBy("t").collect()
    return [r["t"] for r in kept], [float(r["idf"]) for r in kept]


class IntentModel:
    """A fitted classifier with its two TF-IDF blocks; save() and load() keep all of it."""

    def __init__(self, blocks: dict[str, tuple[list[str], list[float]]], model: PipelineModel, classes: Sequence[str]) -> None:
        self.blocks, self.model, self.classes = blocks, model, tuple(classes)

    def vectors(self, rows: DataFrame) -> DataFrame:
        return vectorised(rows, self.blocks)

    def save(self, spark: SparkSession, path: str) -> None:
        """The regression, the vocabularies with their idf values and the class names, as folders below path."""
        self.model.write().overwrite().save(f"{path}/regression")
        terms = [(b, i, t, idf) for b, (ts, idfs) in self.blocks.items() for i, (t, idf) in enumerate(zip(ts, idfs, strict=True))]
        spark.createDataFrame(terms, "block string, place int, term string, idf double").write.mode("overwrite").parquet(f"{path}/terms")
        spark.createDataFrame(list(enumerate(self.classes)), "place int, class string").write.mode("overwrite").parquet(f"{path}/classes")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> IntentModel:
        blocks: dict[str, tuple[list[str], list[float]]] = {"words": ([], []), "letters": ([], [])}
        for r in spark.read.parquet(f"{path}/terms").orderBy("block", "place").collect():  # bounded by the vocabularies
            blocks[r["block"]][0].append(r["term"])
            blocks[r["block"]][1].append(r["idf"])
        classes = [r["class"] for r in spark.read.parquet(f"{path}/classes").orderBy("place").collect()]
        return cls(blocks, PipelineModel.load(f"{path}/regression"), classes)

    def predict(self, rows: DataFrame, reject: float = 0.45) -> DataFrame:
        """rows with intent_pred, confidence and all_probabilities; below `reject` the intent is unknown."""
        p = self.model.transform(self.vectors(rows)).withColumn("p", vector_to_array("probability"))
        names = F.array(*[F.lit(c) for c in self.classes])
        best = F.array_max("p")
        label = F.when(best < reject, "unknown").otherwise(F.element_at(names, F.array_position("p", best).cast("int")))
        return p.select(*rows.columns, label.alias("intent_pred"), F.round(best, 4).alias("confidence"), F.map_from_arrays(names, F.transform("p", lambda x: F.round(x, 4))).alias("all_probabilities"))


def vectorised(rows: DataFrame, blocks: dict[str, tuple[list[str], list[float]]]) -> DataFrame:
    """rows with the TF-IDF blocks end to end as a sparse vector: (1 + ln tf) idf, each block scaled to unit length.

    Terms are looked up in Arrow batches; the vocabularies, bounded by `most`, travel with the tasks.
    """
    places, size = [], 0
    for terms, idfs in blocks.values():
        places.append({t: (size + i, idf) for i, (t, idf) in enumerate(zip(terms, idfs, strict=True))})
        size += len(terms)
    held = features(rows)
    kept, names = list(rows.columns), list(blocks)
    n = len(kept)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, values = [], []
            for terms in zip(*[batch.column(n + i).to_pylist() for i in range(len(names))], strict=True):
                row: list[tuple[int, float]] = []
                for found, place in zip(terms, places, strict=True):
                    some = [(place[t][0], (1 + math.log(k)) * place[t][1]) for t, k in Counter(found or ()).items() if t in place]
                    norm = math.sqrt(sum(x * x for _, x in some)) or 1.0
                    row += sorted((i, x / norm) for i, x in some)
                at.append([i for i, _ in row])
                values.append([x for _, x in row])
            columns = [*batch.columns[:n], pa.array(at, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "at", "values"])

    schema = StructType([*rows.schema.fields, StructField("at", ArrayType(IntegerType())), StructField("values", ArrayType(DoubleType()))])
    vector = F.udf(lambda at, values: SparseVector(size, at, values), VectorUDT())
    return held.select(*kept, *names).mapInArrow(look_up, schema).withColumn("features", vector("at", "values")).drop("at", "values")


def train(rows: DataFrame, classes: Sequence[str] = CLASSES, c: float = 1.0, max_df: float = 0.95, most: int = 30_000, iterations: int = 100) -> IntentModel:
    """Multinomial logistic regression with the inverse regularisation c, as the usual libraries define it."""
    held = features(rows).cache()
    blocks = {name: weights(held, name, max_df, most) for name in ("words", "letters")}
    number = F.array_position(F.array(*[F.lit(x) for x in classes]), F.col("intent")) - 1
    data = vectorised(rows, blocks).withColumn("label", number.cast("double")).cache()
    model = LogisticRegression(family="multinomial", regParam=1.0 / (c * max(1, data.count())), elasticNetParam=0.0, standardization=False, maxIter=iterations)
    fitted = Pipeline(stages=[model]).fit(data)
    held.unpersist(), data.unpersist()
    return IntentModel(blocks, fitted, classes)


def label_histogram(rows: DataFrame, label: str = "intent") -> DataFrame:
    return rows.groupBy(label).agg(F.count("*").alias("n"))


def confusion(rows: DataFrame, actual: str, predicted: str) -> DataFrame:
    return rows.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def class_metrics(matrix: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support) from a confusion table (actual, predicted, n)."""
    each = matrix.select(F.explode(F.array(F.struct(F.col("actual").alias("label"), F.col("n").alias("a"), F.lit(0).alias("p")), F.struct(F.col("predicted").alias("label"), F.lit(0).alias("a"), F.col("n").alias("p")))).alias("x"), "actual", "predicted", "n")
    hit = F.sum(F.when((F.col("actual") == F.col("predicted")) & (F.col("x.a") > 0), F.col("n")).otherwise(0))
    s = each.groupBy("x.label").agg(F.sum("x.a").alias("support"), F.sum("x.p").alias("named"), hit.alias("hit"))
    precision, recall = F.when(F.col("named") > 0, F.col("hit") / F.col("named")).otherwise(0.0), F.when(F.col("support") > 0, F.col("hit") / F.col("support")).otherwise(0.0)
    return s.select("label", precision.alias("precision"), recall.alias("recall"), F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0).alias("f1"), "support")


def overall(metrics: DataFrame, matrix: DataFrame) -> DataFrame:
    """One row: accuracy, macro and weighted averages."""
    a = matrix.agg((F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    m = metrics.where("support > 0").agg(*[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")], *[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")])
    return a.crossJoin(F.broadcast(m))


def nearest_rank(rows: DataFrame, value: str, shares: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    """(n, p50, ...): the value at 0-based place int(n q) of the sorted values, not interpolated.

    Values are counted first; places come from running counts over the distinct values, so equal
    values cost one row.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("k"))
    ranged = counted.repartitionByRange(PARTS, "v").withColumn("part", F.spark_partition_id())
    parts = ranged.groupBy("part").agg(F.sum("k").alias("k"))
    before = parts.select("part", F.coalesce(F.sum("k").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("k").over(Window.partitionBy(F.lit(1))).alias("n"))
    upto = F.sum("k").over(Window.partitionBy("part").orderBy("v"))
    placed = ranged.withColumn("upto", upto).join(F.broadcast(before), "part").withColumn("upto", F.col("upto") + F.col("before"))
    picks = [F.min(F.when(F.col("upto") > F.floor(F.col("n") * q), F.col("v"))).alias(f"p{round(q * 100)}") for q in shares]
    return placed.agg(F.max("n").alias("n"), *picks)
