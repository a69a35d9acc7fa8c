"""Reading what doesn't fit: batches, candidate answers, hierarchical summaries.

Models are injected functions; they run in executors, for all questions at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators.chunking import char_windows, pack_batches
from textloom.operators.storage import materialize

MAP_PROMPT = "Summarise the following part, {label}, in a few sentences, from its text alone.\n\n{text}\n\nSummary:"
REDUCE_PROMPT = "Combine these partial summaries into one answer to \"{request}\", in their order, adding nothing.\n\n{text}\n\nSummary:"


def read_batches(hits: DataFrame, questions: DataFrame, reader: Callable[[str, list[tuple]], str], budget: int) -> DataFrame:
    """(qid, batch, answer, context): one call of the reader for each batch of each question."""
    rows = pack_batches(hits, budget).join(questions.select("qid", "question"), "qid")
    grouped = rows.groupBy("qid", "batch", "question").agg(F.sort_array(F.collect_list(F.struct("rank", "cid", "text", "score"))).alias("h"))
    kind = hits.schema["qid"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(q, n, reader(ask, [(x["cid"], x["text"], x["score"]) for x in h]), " ".join(x["text"] for x in h))
                   for q, n, ask, h in zip(b["qid"], b["batch"], b["question"], b["h"])]
            yield pd.DataFrame(out, columns=["qid", "batch", "answer", "context"])

    return grouped.mapInPandas(run, f"qid {kind}, batch int, answer string, context string")


def select_answer(candidates: DataFrame, verify: Column | None = None) -> DataFrame:
    """(qid, answer): of each question's real answers the one with the highest ``verify``, by default
    whether its batch has it word for word; ties go to the earliest batch. If all refuse, the
    first one's answer."""
    real = T.is_answer(F.col("answer"))
    merit = verify if verify is not None else T.is_grounded(F.col("answer"), F.col("context")).cast("int")
    w = Window.partitionBy("qid").orderBy(F.desc("real"), F.when(F.col("real"), F.col("merit")).desc_nulls_last(), "batch")
    ranked = candidates.withColumn("real", real).withColumn("merit", merit).withColumn("n", F.row_number().over(w))
    return ranked.filter("n = 1").select("qid", "answer")


def answer(hits: DataFrame, questions: DataFrame, reader: Callable, budget: int, verify: Column | None = None) -> DataFrame:
    """Map over batches and select; a question whose hits fit one batch is one call."""
    return select_answer(materialize(read_batches(hits, questions, reader, budget), "answers"), verify)


def _call(df: DataFrame, llm: Callable[[str], str]) -> DataFrame:
    """``df`` (doc, n, label, prompt) with ``text``, the model's reply; a null prompt keeps its text."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.copy()
            b["text"] = [t if p is None else llm(p) for p, t in zip(b["prompt"], b["text"])]
            yield b[["doc", "n", "label", "text"]]

    return df.select("doc", "n", "label", "prompt", "text").mapInPandas(run, "doc string, n int, label string, text string")


def summarize(segments: DataFrame, llm: Callable[[str], str], budget: int, request: str = "Summarise this.") -> DataFrame:
    """(doc, summary) of segments (doc, n, label, text): each is summarised, longer ones than the
    budget by windows, then groups of summaries that fit the budget are combined, level by level,
    until there is one. A level that no longer groups anything combines in halves."""
    rows = segments.filter(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", "") != "").select("doc", F.col("n").cast("int"), "label", "text")

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for d, n, label, t in zip(b["doc"], b["n"], b["label"], b["text"]):
                parts = char_windows(t, budget) if len(t) > budget else [t]
                out += [(d, n, k, label if len(parts) == 1 else f"{label} part {k + 1}", p) for k, p in enumerate(parts)]
            yield pd.DataFrame(out, columns=["doc", "n", "k", "label", "text"])

    parts = rows.mapInPandas(split, "doc string, n int, k int, label string, text string")
    prompt = F.concat(*[F.lit(x) if i % 2 == 0 else F.col(("label", "text")[i // 2]) for i, x in enumerate(_pieces(MAP_PROMPT, ("label", "text")))])
    order = Window.partitionBy("doc").orderBy("n", "k")
    level = materialize(_call(parts.withColumn("n", F.row_number().over(order)).withColumn("prompt", prompt), llm), "summaries")
    while True:
        most = level.groupBy("doc").count().agg(F.max("count")).first()[0]
        if most is None or most == 1:
            return level.select("doc", F.col("text").alias("summary"))
        sized = level.withColumn("line", F.concat(F.lit("["), F.col("label"), F.lit("]\n"), F.col("text")))
        packed = pack_batches(sized.withColumnRenamed("doc", "qid").withColumnRenamed("n", "rank"), budget, text="line")
        per = Window.partitionBy("qid")
        packed = packed.withColumn("all", F.count(F.lit(1)).over(per)).withColumn("groups", F.max("batch").over(per) + 1)
        half = F.row_number().over(per.orderBy("rank")) > F.floor(F.col("all") / 2)
        packed = packed.withColumn("batch", F.when((F.col("groups") == F.col("all")) & (F.col("all") > 1), half.cast("int")).otherwise(F.col("batch")))
        merged = packed.groupBy("qid", "batch").agg(F.sort_array(F.collect_list(F.struct("rank", "line", "text", "label"))).alias("h"))
        text = F.array_join(F.transform("h", lambda x: x.line), "\n\n")
        ask = F.concat(*[F.lit(x) if i % 2 == 0 else (F.lit(request), text)[i // 2] for i, x in enumerate(_pieces(REDUCE_PROMPT, ("request", "text")))])
        nxt = merged.select(F.col("qid").alias("doc"), F.col("batch").alias("n"),
                            F.when(F.size("h") == 1, F.col("h")[0]["label"]).otherwise(F.concat(F.lit("batch "), (F.col("batch") + 1).cast("string"))).alias("label"),
                            F.when(F.size("h") > 1, ask).alias("prompt"), F.col("h")[0]["text"].alias("text"))
        level = materialize(_call(nxt, llm), "summaries")


def _pieces(template: str, names: tuple[str, str]) -> list:
    """The template cut at its two fields: literal, field, literal, field, literal."""
    a, rest = template.split("{" + names[0] + "}")
    b, c = rest.split("{" + names[1] + "}")
    return [a, 0, b, 1, c]


def regex_reader(question: str, batch: list[tuple]) -> str:
    """An offline reader: the seven digits bound to the entity that the question names, else the
    last seven-digit number."""
    import re

    text = "\n".join(t for _, t, _ in batch)
    asked = re.findall("entity ([a-z]+-[0-9]+)", question)[:1]
    bound = next((re.search(f"entity {x}[^0-9]*([0-9]{{7}})", text) for x in asked), None)
    every = re.findall(r"\b[0-9]{7}\b", text)
    return bound.group(1) if bound else every[-1] if every else ""


def resilient(ask: Callable[[int, int], str], budget: int, hits: int, tries: int = 5, floor: int = 600) -> tuple[str, int, int]:
    """(reply, budget, hits): ``ask(budget, hits)`` again with half of both, as long as it fails for
    want of capacity, and at last with no context at all."""
    import re

    for _ in range(tries):
        try:
            return ask(budget, hits), budget, hits
        except Exception as e:
            if not re.search(T.INTENTS["capacity"], str(e), re.I):
                raise
            budget, hits = max(floor, budget // 2), max(1, hits // 2)
    return ask(0, 0), 0, 0
