"""The public functions: each request as a function of stored tables, returning plain values or DataFrames."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.sentiment import Scorer
from ..functions.vectors import Embedder, hashing_embedder
from ..operators import checkpoints as ck
from ..operators import conflict, intent, mood, persona, postings, retrieval, segmentation
from ..operators.intent import IntentModel
from ..operators.postings import Postings
from ..sources import sinks
from ..sources.conversations import from_csv, scenarios
from ..sources.stores import OrderedTable
from . import answers

#: The suggested questions by category.
SUGGESTIONS = {
    "Persona": (
        "What kind of person is User 1?",
        "What kind of person is User 2?",
        "What are User 1's habits?",
        "What are User 2's habits?",
        "How does User 1 talk?",
        "How does User 2 communicate?",
        "What are User 1's personality traits?",
        "Describe User 2's personality",
    ),
    "Facts & Interests": (
        "What do users talk about most?",
        "What hobbies are mentioned?",
        "What pets do users have?",
        "What jobs are discussed?",
        "Tell me about relationships mentioned",
        "What places are discussed?",
    ),
    "Conversation Topics": (
        "What are the main topics discussed?",
        "Tell me about cooking discussions",
        "What music do they discuss?",
        "Any discussions about travel?",
        "What sports are mentioned?",
        "Tell me about family discussions",
    ),
}


@dataclass
class Engine:
    """The stored tables of a corpus. Absent ones make the requests that need them fail with LookupError."""

    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)
    embedder: Embedder = field(default_factory=hashing_embedder)
    scorer: Scorer | None = None
    model: IntentModel | None = None
    #: Pages come from here where a table is stored in order, mentions from the index where there is one.
    pages: dict[str, OrderedTable] = field(default_factory=dict)
    postings: Postings | None = None

    def table(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise LookupError(f"no table {name}; build it first")
        return self.tables[name]

    def embed(self, question: str) -> list[float]:
        return self.spark.range(1).select(self.embedder(F.lit(question))).first()[0]

    def retrieve(self, question: str, top: int = 5) -> dict[str, DataFrame]:
        return retrieval.retrieve(question, self.embed(question), self.table("topic_index"), self.table("chunk_index"), self.table("checkpoint_index"), top)

    def chat(self, question: str, top: int = 5) -> dict:
        """Answer, sources and scores (three digits, previews of 200 characters)."""
        if not question.strip():
            raise ValueError("the question is empty")
        one = self.spark.range(1).select(tx.is_persona_query(F.lit(question)).alias("p"), tx.target_user(F.lit(question)).alias("u"), tx.aspect(F.lit(question)).alias("a")).first()
        found = self.retrieve(question, top)
        if one["p"] and "personas" in self.tables:
            people = self.table("personas") if one["u"] is None else self.table("personas").where(F.col("user_id") == one["u"])
            text = answers.persona_text(people.collect(), one["a"], found["topics"].limit(3).collect())
        else:
            text = answers.contextual_text(question, found)
        shown = found["topics"].select("topic_id", "topic_label", F.left("summary", F.lit(200)).alias("preview"), F.round("relevance_score", 3).alias("relevance"))
        return {"answer": text, "persona_query": one["p"], "topics": [r.asDict() for r in shown.collect()]}

    def persona(self, user: str | None = None) -> list[dict]:
        rows = self.table("personas") if user is None else self.table("personas").where(F.col("user_id") == user)
        found = [r.asDict(True) for r in rows.collect()]
        if user is not None and not found:
            raise LookupError(f"no persona {user}")
        return found

    def persona_summary(self) -> DataFrame:
        return persona.persona_summary(self.table("personas"))

    def page(self, name: str, by: str, number: int = 1, size: int = 20, drop: Sequence[str] = ("messages",)) -> dict:
        """One page in order of `by`. Tables stored in that order are read in the page's ranges only, and counted by their directory."""
        stored = self.pages.get(name)
        if stored is not None and stored.by == [by]:
            total, found = stored.total(), stored.page(number, size).drop(*drop)
        else:
            rows = self.table(name)
            total, found = rows.count(), retrieval.page(rows.drop(*drop), by, number, size)
        return {"rows": [r.asDict(True) for r in found.collect()], "page": number, "total": total, "total_pages": math.ceil(total / size)}

    def topics(self, number: int = 1, size: int = 20, named: str | None = None) -> dict:
        """A page of topics; `named` keeps those of the page whose label holds it, in any case."""
        found = self.page("topics", "topic_id", number, size)
        return found if named is None else found | {"rows": [r for r in found["rows"] if named.lower() in (r["topic_label"] or "").lower()]}

    def checkpoints(self, number: int = 1, size: int = 20) -> dict:
        return self.page("checkpoints", "checkpoint_id", number, size)

    def drift_timeline(self, number: int = 1, size: int = 100) -> dict:
        drifted = self.table("mood_timeline").where("drift_from_prev").count()
        return self.page("mood_timeline", "day", number, size) | {"drift_count": drifted}

    def drift_summary(self) -> dict:
        t = self.table("mood_timeline")
        first = t.where("drift_from_prev").orderBy("day").limit(20)
        return mood.drift_summary(t).first().asDict() | {"trigger_types": {r["type"]: r["n"] for r in mood.trigger_histogram(t).collect()}, "drifts": [r.asDict(True) for r in first.collect()]}

    def stats(self) -> dict:
        """Rows of each stored table, and whose personas there are."""
        people = self.tables.get("personas")
        loaded = [] if people is None else [r[0] for r in people.select("user_id").orderBy("user_id").collect()]
        return {name: table.count() for name, table in self.tables.items()} | {"personas_loaded": loaded}

    def health(self) -> dict[str, str]:
        return {"status": "ok"}

    def suggestions(self, most: int | None = None) -> dict[str, tuple[str, ...]]:
        """The suggested questions, the first `most` of each category."""
        return {k: v[:most] for k, v in SUGGESTIONS.items()}

    def intent(self, text: str) -> dict:
        """The prediction for one text, its probabilities in falling order."""
        if self.model is None:
            raise LookupError("no intent model; train or load one first")
        found = self.model.predict(self.spark.createDataFrame([(text,)], "text string")).first().asDict(True)
        return found | {"all_probabilities": dict(sorted(found["all_probabilities"].items(), key=lambda x: (-x[1], x[0])))}

    def intent_metrics(self) -> dict:
        """The report that train_intent() stored: sizes, overall figures, figures by class, the confusion table."""
        classes = [r.asDict() for r in self.table("intent_classes").orderBy("label").collect()]
        matrix = [r.asDict() for r in self.table("intent_confusion").orderBy("actual", "predicted").collect()]
        return self.table("intent_overall").first().asDict() | {"classes": classes, "confusion": matrix}

    def conflict_demo(self) -> list[dict]:
        """The stored scenarios: for each its entity, messages in order of place, and topics."""
        rows, topics = self.table("scenario_messages"), self.table("scenario_topics")
        keys = ("scenario_id", "entity")
        listed = lambda df, by, name: df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(by, *[c for c in df.columns if c not in (*keys, by)]))).alias(name))
        both = listed(rows, "global_index", "messages").join(listed(topics, "topic_id", "topics"), list(keys), "full")
        return [r.asDict(True) for r in both.orderBy("scenario_id").collect()]

    def resolve(self, question: str, most: int = 10) -> dict:
        """Mentions of the entity that a question is about, and their contradictions."""
        entity = self.spark.range(1).select(tx.entity_of(F.lit(question))).first()[0]
        if not entity:
            return {"entity": None, "answer": answers.merged_text(None, [], []), "mentions": [], "contradictions": []}
        if self.postings is not None:
            found = postings.mentions_by_index(entity, self.postings, self.table("messages"), self.tables.get("topics"), self.scorer)
        else:
            found = conflict.mentions_of(entity, self.table("messages"), self.tables.get("topics"), self.scorer)
        first = found.where(F.col("pos") <= most)
        top, shown = first.orderBy("pos").collect(), conflict.summarised(first).collect()
        pairs = conflict.strongest(found, most).orderBy("place").drop("place").collect()
        return {"entity": entity, "answer": answers.merged_text(entity, top, pairs), "mentions": [r.asDict() for r in shown], "contradictions": [r.asDict(True) for r in pairs]}


#: Tables whose pages are asked for, and the column that orders them.
PAGED = {"topics": "topic_id", "checkpoints": "checkpoint_id", "mood_timeline": "day"}


def build(spark: SparkSession, csv: str, out: str, embedder: Embedder | None = None, threshold: float = segmentation.THRESHOLD) -> Engine:
    """Parse transcripts, write every artifact as Parquet under `out`, and open an engine on them."""
    embed = embedder or hashing_embedder()
    blocked = from_csv(spark, csv).withColumn("block", F.floor(F.col("global_index") / postings.MESSAGES).cast("int"))
    blocked.write.mode("overwrite").partitionBy("block").parquet(f"{out}/messages")
    messages = spark.read.parquet(f"{out}/messages")
    sinks.save(segmentation.topics(segmentation.detect_topics(retrieval.vector_index(messages, F.col("text"), embed), "vec", threshold=threshold)), f"{out}/topics")
    topics = spark.read.parquet(f"{out}/topics")
    sinks.save(ck.checkpoints(messages), f"{out}/checkpoints")
    sinks.save(persona.personas(messages), f"{out}/personas")
    sinks.save(mood.mood_timeline(messages, topics), f"{out}/mood_timeline")
    for name, by in PAGED.items():
        OrderedTable.write(spark.read.parquet(f"{out}/{name}"), f"{out}/pages/{name}", [by])
    Postings(spark, f"{out}/postings").append(postings.of_messages(messages)).append(postings.of_topics(topics))
    sinks.save(retrieval.topic_index(topics.drop("messages"), embed), f"{out}/topic_index")
    sinks.save(retrieval.chunk_index(ck.chunks(messages), embed), f"{out}/chunk_index")
    sinks.save(retrieval.checkpoint_index(spark.read.parquet(f"{out}/checkpoints"), embed), f"{out}/checkpoint_index")
    return load(spark, out, embed)


def train_intent(spark: SparkSession, out: str, rows: DataFrame | None = None, **settings: float) -> Engine:
    """Train on stored or generated rows, write the training CSV, the classifier and its report below `out`, and open an engine on them."""
    sinks.save_csv(rows if rows is not None else intent.generated(spark), f"{out}/intent_training")
    stored = spark.read.option("header", True).option("escape", '"').schema("id long, text string, intent string").csv(f"{out}/intent_training")
    train, test = intent.split(stored)
    model = intent.train(train, **settings)
    sinks.save_model(model, spark, f"{out}/intent_model")
    sinks.save(intent.confusion(model.predict(test), "intent", "intent_pred"), f"{out}/intent_confusion")
    matrix = spark.read.parquet(f"{out}/intent_confusion")
    sinks.save(intent.class_metrics(matrix), f"{out}/intent_classes")
    sizes = {"train_rows": F.lit(train.count()), "test_rows": F.lit(test.count())}
    sinks.save(intent.overall(spark.read.parquet(f"{out}/intent_classes"), matrix).withColumns(sizes), f"{out}/intent_overall")
    return load_intent(spark, out)


def load_intent(spark: SparkSession, out: str, engine: Engine | None = None) -> Engine:
    """An engine, or the given one, with the classifier and its report."""
    found = engine or Engine(spark)
    found.model = sinks.load_model(spark, f"{out}/intent_model")
    found.tables |= {n: spark.read.parquet(f"{out}/{n}") for n in ("intent_overall", "intent_classes", "intent_confusion")}
    return found


def load_scenarios(engine: Engine, path: str) -> Engine:
    """The engine with the scenarios of a JSON file for conflict_demo()."""
    messages, topics = scenarios(engine.spark, path)
    engine.tables |= {"scenario_messages": messages, "scenario_topics": topics}
    return engine


def load(spark: SparkSession, out: str, embedder: Embedder | None = None, lite: bool = False) -> Engine:
    names = ["topics", "checkpoints", "personas", "mood_timeline", "topic_index", "chunk_index", "checkpoint_index"] + ([] if lite else ["messages"])
    pages = {name: OrderedTable(spark, f"{out}/pages/{name}", [by]) for name, by in PAGED.items()}
    return Engine(spark, {n: spark.read.parquet(f"{out}/{n}") for n in names}, embedder or hashing_embedder(), pages=pages, postings=None if lite else Postings(spark, f"{out}/postings"))
