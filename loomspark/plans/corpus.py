"""A corpus that conversations are appended to: artifacts in versions, the last blocks made anew, everything published at once.

Each append writes one version of every artifact and then one line in the manifest; a reader that opened the corpus before sees the old
state, a failed append is never seen. An artifact's rows are those of all versions, each up to the key from which a later version made them anew:

* messages and day vectors are only added to;
* checkpoints and chunks (and their indexes) are made anew from the one that the old end cut short: up to 99 and 4 old messages are read;
* topics are made anew from the last one whose start can't depend on what comes after: boundaries more than the similarity's width before the
  old end are final, and the greedy gap rule needs only the last accepted one. The old messages of that topic and a halo are read;
* drift depends on the mean over all days, so the timeline is made from all day vectors (a row a conversation), but triggers are looked for
  only on days that drift now and didn't before, that are new, or that lie near new topics: only their messages are read;
* the word index gets a batch; personas are first entries and sums over all messages and are made from all of them.

What was read is in the manifest: `reread`, the old messages read for checkpoints, chunks and topics.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sentiment import Scorer
from ..functions.vectors import Embedder, hashing_embedder
from ..operators import checkpoints as ck
from ..operators import mood, persona, postings, retrieval, segmentation
from ..operators.postings import Postings

#: Artifacts and the key by which later versions replace rows of earlier ones.
KEYS = {"messages": "global_index", "topics": "topic_id", "topic_index": "topic_id", "checkpoints": "checkpoint_id", "checkpoint_index": "checkpoint_id", "chunk_index": "chunk_id", "mood_days": "day", "mood_timeline": "day", "personas": "message_count"}
LINE = "version int, name string, messages long, conversations long, reread long, cuts map<string,long>"


@dataclass
class Version:
    """One line of the manifest; before the first append all is empty."""

    version: int = 0
    name: str = ""
    messages: int = 0
    conversations: int = 0
    reread: int = 0


class Corpus:
    """The artifacts below a path as of the newest version when it was opened."""

    def __init__(self, spark: SparkSession, out: str, embedder: Embedder | None = None, scorer: Scorer | None = None, threshold: float = segmentation.THRESHOLD, max_days: int | None = 500) -> None:
        self.spark, self.out, self.embedder, self.scorer = spark, out, embedder or hashing_embedder(), scorer
        self.threshold, self.max_days = threshold, max_days
        try:
            self.lines = spark.read.schema(LINE).parquet(f"{out}/manifest").orderBy("version").collect()  # a line for each append
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            self.lines = []
        last = self.lines[-1] if self.lines else None
        self.now = Version(*[last[c] for c in ("version", "name", "messages", "conversations", "reread")]) if last else Version()

    def table(self, name: str) -> DataFrame:
        """The rows of an artifact, from the versions that hold them."""
        if not self.lines:
            raise LookupError("nothing has been appended yet")
        key, out, bound = KEYS[name], None, None
        for line in reversed(self.lines):
            part = self.spark.read.parquet(f"{self.out}/{name}/{line['name']}")
            mine = part if bound is None else part.where(F.col(key) < bound)
            out = mine if out is None else mine.unionByName(out)
            cut = line["cuts"][name]
            bound = cut if bound is None else min(bound, cut)
            if bound <= 0:
                break
        return out

    def since(self, new: DataFrame, first: int) -> DataFrame:
        """The old messages from a place on, and the new ones."""
        return new if not self.lines or first >= self.now.messages else self.table("messages").where(F.col("global_index") >= first).unionByName(new)

    def append(self, messages: DataFrame) -> Corpus:
        """The corpus with further conversations, message rows as sources.conversations.indexed() numbers them from 0. Without rows nothing is written."""
        was, name = self.now, f"v{self.now.version + 1}-{uuid.uuid4().hex}"
        path = lambda artifact: f"{self.out}/{artifact}/{name}"
        placed = messages.withColumns({"global_index": F.col("global_index") + was.messages, "conversation_index": F.col("conversation_index") + was.conversations})
        placed.repartitionByRange("global_index").sortWithinPartitions("global_index").write.parquet(path("messages"))
        new = self.spark.read.parquet(path("messages"))
        n, c = new.agg(F.count("*"), F.count_distinct("conversation_index")).first()
        if not n:
            return self
        cuts = {artifact: 0 for artifact in KEYS} | {"messages": was.messages, "mood_days": was.conversations}

        def write(artifact: str, rows: DataFrame, cut: int) -> DataFrame:
            rows.write.parquet(path(artifact))
            cuts[artifact] = cut
            return self.spark.read.parquet(path(artifact))

        first, chunk = was.messages // 100 * 100, was.messages // 5 * 5
        made = write("checkpoints", ck.checkpoints(self.since(new, first)), first // 100)
        write("checkpoint_index", retrieval.checkpoint_index(made, self.embedder), first // 100)
        write("chunk_index", retrieval.chunk_index(ck.chunks(self.since(new, chunk)), self.embedder), chunk // 5)
        start, topic = self.last_topic()
        topics = write("topics", self.topics(new, start, topic, path("vectors")), topic)
        write("topic_index", retrieval.topic_index(topics.drop("messages"), self.embedder), topic)
        spans = new.groupBy(F.col(mood.DAY).alias("day")).agg(F.max("global_index").alias("last_index"))
        write("mood_days", mood.mood_vectors(new, self.scorer).join(spans, "day"), was.conversations)
        line = self.spark.createDataFrame([(was.version + 1, name, was.messages + n, was.conversations + c, was.messages - min(first, chunk, max(0, start - segmentation.WIDTH - 1)), cuts)], LINE)
        whole = Corpus(self.spark, self.out, self.embedder, self.scorer, self.threshold, self.max_days)
        whole.lines, whole.now = [*self.lines, line.first()], Version(was.version + 1, name, was.messages + n, was.conversations + c)
        whole.timeline(self, start, was.conversations).write.parquet(path("mood_timeline"))
        persona.personas(whole.table("messages")).write.parquet(path("personas"))
        Postings(self.spark, f"{self.out}/postings/messages").append(postings.of_messages(new))
        line.coalesce(1).write.mode("append").parquet(f"{self.out}/manifest")
        return Corpus(self.spark, self.out, self.embedder, self.scorer, self.threshold, self.max_days)

    def last_topic(self) -> tuple[int, int]:
        """(start, topic_id) of the last topic whose start later messages can't move."""
        if not self.lines:
            return 0, 0
        stable = self.table("topics").where(F.col("start_msg_index") <= self.now.messages - segmentation.WIDTH - 1)
        found = stable.agg(F.max(F.struct("start_msg_index", F.col("topic_id").cast("long").alias("topic_id"))).alias("x")).first()["x"]
        return (found["start_msg_index"], found["topic_id"]) if found else (0, 0)

    def topics(self, new: DataFrame, start: int, topic: int, vectors: str) -> DataFrame:
        """The topics from that start on; the similarity needs a halo before it."""
        retrieval.vector_index(self.since(new, max(0, start - segmentation.WIDTH - 1)), F.col("text"), self.embedder).write.parquet(vectors)
        m = self.spark.read.parquet(vectors)
        sims = segmentation.smoothed(segmentation.centroid_similarity(m, "global_index", "vec"), "global_index").where(F.col("global_index") >= start)
        own = m.where(F.col("global_index") >= start)
        starts = own.where((F.col("local_index") == 0) | (F.col("global_index") == start)).select("global_index")
        cut = segmentation.segmented(own, segmentation.boundaries(sims, starts, "global_index", self.threshold), "global_index")
        return segmentation.topics(cut.withColumn("topic_id", F.col("topic_id") + topic))

    def timeline(self, before: Corpus, start: int, conversations: int) -> DataFrame:
        """The timeline over all days; triggers of days that drifted before and lie before the new topics are kept."""
        days = self.table("mood_days")
        kept = days if self.max_days is None else days.where(F.col("day") < self.max_days)
        drifted = mood.drifts(kept.drop("last_index").withColumn("mood_labels", mood.labels()))
        told = drifted.join(kept.select("day", "last_index"), "day")
        if before.lines:
            told = told.join(before.table("mood_timeline").select("day", F.col("trigger").alias("was")), "day", "left")
            kept_trigger = F.col("was").isNotNull() & (F.col("day") < conversations) & (F.col("last_index") + 5 < start)
            told = told.withColumn("was", F.when(kept_trigger, F.col("was")))
        todo = told.where("drift_from_prev" + (" AND was IS NULL" if before.lines else "")).select("day")
        near = todo.union(todo.select(F.col("day") - 1)).distinct()
        some = drifted.join(near, "day", "left_semi").join(todo.withColumn("__todo", F.lit(True)), "day", "left").withColumn("drift_from_prev", F.coalesce("__todo", F.lit(False))).drop("__todo")
        said = self.table("messages").join(near.withColumnRenamed("day", mood.DAY), mood.DAY, "left_semi")
        found = mood.with_triggers(some, said, self.table("topics"), scorer=self.scorer).where("drift_from_prev").select("day", F.col("trigger").alias("found"))
        full = told.join(found, "day", "left")
        trigger = F.coalesce("was", "found") if before.lines else F.col("found")
        scores = F.create_map(*[x for d in mood.lex.MOOD_DIMS for x in (F.lit(d), F.col(d))])
        return full.select("day", "message_count", "mood_labels", scores.alias("mood_scores"), "drift_from_prev", "drift_distance", "drift_threshold", F.when(F.col("drift_from_prev"), trigger).alias("trigger"))

    def mentions(self, entity: str, scorer: Scorer | None = None) -> DataFrame:
        return postings.mentions_by_index(entity, Postings(self.spark, f"{self.out}/postings/messages"), self.table("messages"), None, scorer or self.scorer)
