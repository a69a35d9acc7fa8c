"""BM25 over an index, for all questions of a table at once."""

from __future__ import annotations

import hashlib
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import scoring
from textloom.operators.index import Index
from textloom.operators.storage import discard, materialize

#: Scores are rounded to so many places before they are ranked, as the order in which partial
#: sums are added must not decide a tie.
PLACES = 9


class Flavour(NamedTuple):
    k1: float
    b: float
    smooth: bool        # idf of ln(1 + x), else of ln(x) with a floor
    repeats: bool       # whether a repeated question term counts again
    later_first: bool   # ties


BM25 = Flavour(1.5, 0.75, True, True, True)
FTS = Flavour(1.2, 0.75, False, False, False)
FLOOR = 1e-6


def question_terms(questions: DataFrame, flavour: Flavour, qid: str = "qid", question: str = "question") -> DataFrame:
    """(qid, term, qf)."""
    tokens = T.bm25_terms(F.col(question)) if flavour.repeats else T.fts_terms(F.col(question))
    return questions.select(F.col(qid).alias("qid"), F.explode(tokens).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qf"))


def score(index: Index, questions: DataFrame, flavour: Flavour = BM25, qid: str = "qid", question: str = "question") -> DataFrame:
    """(qid, cid, score) of every chunk that has a term of the question. Text isn't touched; the
    postings are read twice for all questions of the table: for their hits, and for the frequencies of the terms asked for."""
    asked = question_terms(questions, flavour, qid, question)
    hits = index.postings.join(asked, "term")
    wanted = asked.select("term").distinct()
    stats = index.postings.join(wanted, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n, df, tf, dl = F.col("N"), F.col("df"), F.col("tf"), F.col("dl")
    ratio = (n - df + 0.5) / (df + 0.5)
    idf = F.log(1 + ratio) if flavour.smooth else F.greatest(F.log(ratio), F.lit(FLOOR))
    norm = tf + flavour.k1 * (1 - flavour.b + flavour.b * dl / F.col("avgdl"))
    part = F.col("qf") * idf * tf * (flavour.k1 + 1) / norm if flavour.repeats else idf * tf * (flavour.k1 + 1) / norm
    hits = hits if "dl" in index.postings.columns else hits.join(index.doclen, "cid")
    joined = hits.join(stats, "term").crossJoin(F.broadcast(index.corpus))  # one row
    return joined.groupBy("qid", "cid").agg(F.round(F.sum(part), PLACES).alias("score")).filter("score > 0")


def ranked(scores: DataFrame, k: int, *tie: Column, keys: tuple[str, ...] = ("qid",)) -> DataFrame:
    """The k best of each question with a 0-based rank."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), *tie)
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)


def with_text(index: Index, hits: DataFrame) -> DataFrame:
    """Text and source joined back, after the cut to k."""
    return hits.join(index.chunks.select("cid", "text", *[c for c in ("source", "repo") if c in index.chunks.columns]), "cid")


def search(index: Index, questions: DataFrame, k: int = 5, flavour: Flavour = BM25, qid: str = "qid", question: str = "question") -> DataFrame:
    """(qid, cid, score, rank): ties go to the later chunk in BM25, to the earlier one in FTS. Chunks are
    scored where their rows are, and the hits, k of each question, are written."""
    tie = F.desc("cid") if flavour.later_first else F.asc("cid")
    asked = question_terms(questions, flavour, qid, question)
    found = [materialize(ranked(_slice(index, a, k, flavour), k, tie), "hits") for a in scoring.slices(asked.withColumnRenamed("qf", "n"))]
    return reduce(DataFrame.unionByName, found) if found else ranked(score(index, questions, flavour, qid, question), k, tie)


def _slice(index: Index, asked: scoring.Asked, k: int, flavour: Flavour) -> DataFrame:
    """(qid, cid, score): each task's k best of the questions of a slice."""
    rows = _chosen(index, asked.terms)
    n, avgdl = index.corpus.first() if index.counted else rows.agg(F.count(F.lit(1)), F.coalesce(F.avg("dl"), F.lit(0.0))).first()
    df = scoring.document_counts(rows, asked.terms)
    ratio = (n - df + 0.5) / (df + 0.5)
    idf = np.log(1 + ratio) if flavour.smooth else np.maximum(np.log(ratio, where=ratio > 0, out=np.full(len(ratio), FLOOR)), FLOOR)
    weight = (asked.n if flavour.repeats else 1.0) * idf[asked.t]
    k1, b = flavour.k1, flavour.b
    value = lambda tf, dl: tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))
    return scoring.best(rows, asked, weight, scoring.chosen_entries(asked.terms, value), k, flavour.later_first, PLACES)


def _chosen(index: Index, terms: pa.Array) -> DataFrame:
    """The rows of ``scoring.chosen``. Those of the latest terms are kept, as searches of one batch of questions
    ask for the same ones."""
    key = hashlib.sha256("\0".join(terms.to_pylist()).encode()).digest()
    if key not in index.latest:
        for old in index.latest.values():
            discard(old)
        index.latest.clear()
        rows = index.chunks.select("cid", "text") if not index.counted else index.bags if index.bags is not None else _regrouped(index, terms)
        index.latest[key] = scoring.chosen(rows, terms)
    return index.latest[key]


def _regrouped(index: Index, terms: pa.Array) -> DataFrame:
    """(cid, dl, b) from the postings of ``terms`` alone, for an index without bags."""
    wanted = index.postings.sparkSession.createDataFrame(pa.table({"term": terms}))
    hits = index.postings.join(F.broadcast(wanted), "term", "left_semi")  # a slice's terms
    hits = hits if "dl" in index.postings.columns else hits.join(index.doclen, "cid")
    return hits.groupBy("cid").agg(F.first("dl").alias("dl"), F.collect_list(F.struct("term", "tf")).alias("b"))
