"""Conversation memory: turns as an index of each conversation, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators.index import BAG
from textloom.operators.lexical import BM25, PLACES, Flavour


def exchanges(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, text) of messages (conv_id, turn, role, text): each user message with the
    assistant's reply, if that comes next."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    nxt = messages.withColumn("__r", F.lead("role").over(w)).withColumn("__t", F.lead("text").over(w)).filter("role = 'user'")
    reply = F.when(F.col("__r") == "assistant", F.col("__t")).otherwise("")
    return nxt.select("conv_id", "turn", F.concat(F.lit("Q: "), F.coalesce("text", F.lit("")), F.lit("\nA: "), F.coalesce(reply, F.lit(""))).alias("text"))


def postings(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, dl, b: array of (term, tf)): what an exchange adds to its conversation's index. Each row is
    made from its own exchange alone, so a stream can append it."""
    kinds = ", ".join(f"{n} {turns.schema[n].dataType.simpleString()}" for n in ("conv_id", "turn"))
    return turns.select("conv_id", "turn", "text").mapInArrow(T.count_terms(["conv_id", "turn"]), f"{kinds}, dl int, b {BAG}")


def retrieve(posted: DataFrame, questions: DataFrame, k: int = 3, flavour: Flavour = BM25) -> DataFrame:
    """(qid, conv_id, turn, score, rank): each question (qid, conv_id, question) against its own
    conversation; frequencies and lengths are those of the conversation. Later turns win ties. Exchanges are
    shuffled once, to their conversations; only the terms asked for become rows."""
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms = pa.array([T.bm25_list(t) for t in b.column("question").to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([b.column("qid"), b.column("conv_id"), terms], ["qid", "conv_id", "asked"])

    kinds = ", ".join(f"{n} {questions.schema[n].dataType.simpleString()}" for n in ("qid", "conv_id"))
    asked = questions.select("qid", "conv_id", "question").mapInArrow(ask, f"{kinds}, asked array<string>")
    whole = Window.partitionBy("conv_id")
    own = posted.withColumn("N", F.count(F.lit(1)).over(whole)).withColumn("avgdl", F.avg("dl").over(whole)).join(asked, "conv_id")
    hits = own.select("qid", "conv_id", "turn", "dl", "N", "avgdl", "asked", F.explode("b").alias("x")).filter(F.array_contains("asked", F.col("x.term")))
    hits = hits.select("qid", "conv_id", "turn", "dl", "N", "avgdl", F.col("x.term").alias("term"), F.col("x.tf").alias("tf"),
                       F.size(F.filter("asked", lambda t: t == F.col("x.term"))).alias("qf"))
    df = F.count(F.lit(1)).over(Window.partitionBy("conv_id", "qid", "term"))
    j = hits.withColumn("df", df)
    idf = F.log(1 + (F.col("N") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + flavour.k1 * (1 - flavour.b + flavour.b * F.col("dl") / F.col("avgdl"))
    s = j.groupBy("conv_id", "qid", "turn").agg(F.round(F.sum(F.col("qf") * idf * F.col("tf") * (flavour.k1 + 1) / norm), PLACES).alias("score"))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("turn"))
    return s.withColumn("rank", F.row_number().over(w) - 1).filter(F.col("rank") < k).select("qid", "conv_id", "turn", "score", "rank")


def stream_postings(turns: DataFrame, path: str, checkpoint: str):
    """Append the postings of a stream of exchanges below ``path``; returns the running query. Each
    batch has a folder of its own that a repeated batch overwrites, so nothing is counted twice."""
    def add(batch: DataFrame, number: int) -> None:
        postings(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return turns.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("batch")


class ChatMemory:
    """Turns of conversations, kept as rows and asked in batches."""

    def __init__(self, spark: SparkSession, k: int = 3):
        self.spark, self.k, self.rows = spark, k, []

    def add_turn(self, conv_id: int, user: str, assistant: str = "") -> None:
        n = sum(r[0] == conv_id for r in self.rows)
        self.rows.append((conv_id, n, f"Q: {user}\nA: {assistant}"))

    def add_turns(self, conv_id: int, turns: list[tuple[str, str]]) -> None:
        for user, assistant in turns:
            self.add_turn(conv_id, user, assistant)

    def table(self) -> DataFrame:
        return self.spark.createDataFrame(self.rows, "conv_id bigint, turn bigint, text string")

    def retrieve(self, conv_id: int, question: str, k: int | None = None) -> list[tuple[int, str, float]]:
        """(turn, text, score), best first; empty without turns."""
        if not self.rows:
            return []
        turns = self.table()
        q = self.spark.createDataFrame([(0, conv_id, question)], "qid int, conv_id bigint, question string")
        hits = retrieve(postings(turns), q, k or self.k).join(turns, ["conv_id", "turn"]).orderBy("rank")
        return [(r.turn, r.text, r.score) for r in hits.collect()]

    def context(self, conv_id: int, question: str, k: int | None = None) -> str:
        return "\n\n".join(f"[turn {t}]\n{x}" for t, x, _ in self.retrieve(conv_id, question, k))
