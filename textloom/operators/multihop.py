"""Iterative retrieval: following one variable at a time to its definition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.index import Index
from textloom.operators.lexical import FTS, Flavour, search, with_text
from textloom.operators.storage import materialize

REFERENCE = r"variable ([a-z0-9]+)"


def iterative(index: Index, questions: DataFrame, k: int = 5, max_hops: int = 24, per_hop: int = 5, flavour: Flavour = FTS) -> DataFrame:
    """(qid, cid, score, rank): all questions walk at once, one search a hop.

    Each hop searches "variable <x>" and takes the first hit that equates x to another variable
    (which the next hop follows) or gives it a value (the end); if there is none, the best hit
    and the end. A variable seen before ends the walk. The latest hop comes first; what is missing
    to k comes from a search of the question itself. The loop runs over hops, not over rows, and each
    hop's result is written, so that plans stay short."""
    every = F.regexp_extract_all("question", F.lit(REFERENCE), F.lit(1))
    state = materialize(questions.select("qid", F.try_element_at(every, F.lit(-1)).alias("x"), F.array().cast("array<string>").alias("seen")).filter("x IS NOT NULL"), "hop")
    collected = None
    for hop in range(max_hops):
        if state.isEmpty():
            break
        ask = state.select("qid", F.concat(F.lit("variable "), F.col("x")).alias("question"))
        hits = with_text(index, search(index, ask, per_hop, flavour)).select("qid", "cid", "score", "rank", "text").join(state, "qid")
        to = F.call_function("regexp_extract", F.col("text"), F.concat(F.lit("variable "), F.col("x"), F.lit(" equal variable ([a-z0-9]+)")), F.lit(1))
        is_ = F.rlike(F.col("text"), F.concat(F.lit("variable "), F.col("x"), F.lit(" (be|is|=) ")))
        hits = hits.withColumn("to", to).withColumn("defines", (F.col("to") != "") | is_)
        w = Window.partitionBy("qid").orderBy(F.desc("defines"), "rank")
        best = materialize(hits.withColumn("n", F.row_number().over(w)).filter("n = 1").select("qid", "cid", "score", F.lit(hop).alias("hop"), "to", "defines", "x", "seen"), "hop")
        found = best.select("qid", "cid", "score", "hop")
        collected = found if collected is None else collected.unionByName(found)
        state = best.filter("defines AND to <> ''").select("qid", F.col("to").alias("x"), F.array_append("seen", F.col("x")).alias("seen")).filter(~F.array_contains("seen", F.col("x")))
    direct = search(index, questions, k, flavour)
    pad = direct.select("qid", "cid", "score", F.lit(-1).alias("hop"), F.col("rank").alias("r"))
    if collected is None:
        return direct
    first = collected.groupBy("qid", "cid").agg(F.min_by("score", "hop").alias("score"), F.min("hop").alias("hop"))
    pad = pad.join(first.select("qid", "cid"), ["qid", "cid"], "left_anti")
    both = first.withColumn("r", F.lit(0)).unionByName(pad)
    w = Window.partitionBy("qid").orderBy(F.desc("hop"), F.when(F.col("hop") >= 0, -F.col("score")), "r", "cid")
    return both.withColumn("rank", F.row_number().over(w) - 1).filter(F.col("rank") < k).select("qid", "cid", "score", "rank")


def chase(edges: DataFrame, seeds: DataFrame, max_hops: int = 24) -> DataFrame:
    """(seed, hop, node) along ``edges`` (src, dst), one outgoing edge a node, from ``seeds`` (seed):
    the same walk where the references are already a table. Cycles end where they close."""
    front = materialize(seeds.select("seed", F.lit(0).alias("hop"), F.col("seed").alias("node"), F.array("seed").alias("path")), "chase")
    out = front
    for hop in range(1, max_hops + 1):
        front = materialize(front.join(edges, front.node == edges.src).filter(~F.array_contains("path", F.col("dst")))
                            .select("seed", F.lit(hop).alias("hop"), F.col("dst").alias("node"), F.array_append("path", F.col("dst")).alias("path")), "chase")
        if front.isEmpty():
            break
        out = out.unionByName(front)
    return out.drop("path")
