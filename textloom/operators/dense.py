"""Dense retrieval: hashed bags of words by a sparse join, and vectors of an injected encoder."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import scoring
from textloom.operators.lexical import PLACES, ranked
from textloom.operators.storage import materialize


def hashed(texts: DataFrame, id_col: str, text_col: str, dim: int = 2048) -> DataFrame:
    """(id, bucket, w): unit vectors of hashed tokens, only the buckets that aren't zero."""
    counts = (texts.select(F.col(id_col).alias("id"), F.explode(T.terms(F.col(text_col))).alias("t"))
              .groupBy("id", T.bucket(F.col("t"), dim).alias("bucket")).agg(F.count(F.lit(1)).alias("n")))
    norms = counts.groupBy("id").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return counts.join(norms, "id").select("id", "bucket", (F.col("n") / F.col("norm")).alias("w"))


def hash_search(chunks: DataFrame, questions: DataFrame, k: int = 5, dim: int = 2048) -> DataFrame:
    """(qid, cid, score, rank) by cosine of hashed bags; ties go to the earlier chunk. Chunks that
    share no bucket have score 0 and fill up where there are fewer than k others: only the k
    first chunks can be among those."""
    asked = hashed(questions, "qid", "question", dim).select(F.col("id").alias("qid"), F.col("bucket").alias("term"), F.col("w").alias("n"))
    texts = chunks.select("cid", "text")
    found = [materialize(ranked(scoring.best(texts, a, a.n, _bag(a.terms.to_numpy(), dim), k, False, PLACES), k, F.asc("cid")), "hits") for a in scoring.slices(asked)]
    none = questions.select("qid", F.lit(0).cast("bigint").alias("cid"), F.lit(0.0).alias("score")).filter("false")
    return ranked(fill(reduce(DataFrame.unionByName, [x.drop("rank") for x in found]) if found else none, chunks, questions, k), k, F.asc("cid"))


def _bag(buckets: np.ndarray, dim: int) -> Callable[[pa.RecordBatch], scoring.Entries]:
    """Entries of rows (cid, text): of their unit vectors of hashed words, the ``buckets`` asked for."""
    at = np.full(dim, -1)
    at[buckets] = np.arange(len(buckets))

    def of(b: pa.RecordBatch) -> scoring.Entries:
        _, ends, names, counts = T.tally(b.column("text").to_pylist())
        place = np.array([zlib.crc32(x.encode()) % dim for x in names], np.int64) + np.repeat(np.arange(len(b)), np.diff(ends)) * dim
        cell, back = np.unique(place, return_inverse=True)
        n = np.bincount(back, weights=counts, minlength=len(cell)) if len(cell) else np.zeros(0)
        row = cell // dim
        norm = np.sqrt(np.bincount(row, weights=n * n, minlength=len(b)))
        term = at[cell % dim]
        has = term >= 0
        return scoring.Entries(b.column("cid").to_numpy(zero_copy_only=False).astype(np.int64), row[has], term[has], (n / norm[row])[has])

    return of


def fill(scores: DataFrame, chunks: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """Scores with zeros for chunks that may be needed to make k: of those without a score, the
    first k, so k + the number of scored ones among the first ones."""
    best = ranked(scores, k, F.asc("cid")).drop("rank")
    short = questions.select("qid").join(best.groupBy("qid").count(), "qid", "left").filter(F.coalesce(F.col("count"), F.lit(0)) < k).select("qid")
    first = chunks.select("cid").orderBy("cid").limit(2 * k)
    zeros = short.crossJoin(first).join(best.select("qid", "cid"), ["qid", "cid"], "left_anti").withColumn("score", F.lit(0.0))
    return best.unionByName(zeros)


class HashEncoder:
    """An offline encoder: unit vectors of hashed lower-case words."""

    def __init__(self, dim: int = 512):
        self.dim = dim

    def __call__(self, texts: list[str], is_query: bool = False) -> list[list[float]]:
        out = np.zeros((len(texts), self.dim))
        for row, t in zip(out, texts):
            places = [zlib.crc32(bytes(w, "utf-8")) % self.dim for w in re.split("[^0-9a-z]+", t.lower()) if w]
            np.add.at(row, places, 1)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm == 0, 1, norm)).tolist()


def call_encoder(encoder: Callable, texts: list[str], is_query: bool) -> np.ndarray:
    """Encoders may or may not know ``is_query``. Rows are made unit vectors."""
    try:
        rows = encoder(texts, is_query=is_query)
    except TypeError:
        rows = encoder(texts)
    x = np.asarray(rows, np.float64).reshape(len(texts), -1)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm == 0, 1, norm)


def encode(texts: DataFrame, id_col: str, text_col: str, encoder: Callable, is_query: bool = False, batch: int = 64) -> DataFrame:
    """(id, vec): Arrow batches through the encoder, ``batch`` texts a call."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), batch):
                part = b.iloc[at : at + batch]
                yield pd.DataFrame({"id": part["id"], "vec": list(call_encoder(encoder, part["text"].tolist(), is_query))})

    kind = texts.schema[id_col].dataType.simpleString()
    return texts.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInPandas(run, f"id {kind}, vec array<double>").withColumnRenamed("id", id_col)


#: Numbers of the questions that are sent to all tasks at a time, and of a matrix of scores.
SENT, CELLS = 1 << 21, 1 << 22


def unit_rows(vectors: pa.Array) -> np.ndarray:
    """Vectors without nulls as rows of length 1; zero vectors stay zero."""
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm == 0, 1, norm)


def spread(df: DataFrame, what: str) -> DataFrame:
    """``df`` written in twice as many parts as there are cores, as a small file would be one task's work."""
    return materialize(df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism), what)


def vector_search(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "cid", vec_col: str = "vec", qid: str = "qid", qvec: str = "qvec") -> DataFrame:
    """(qid, id, score, rank) by cosine. All pairs are compared, as matrix products: questions are sent to all
    tasks, SENT numbers at a time, each task keeps its k best of each question, and only these are shuffled. Ties go
    to the smaller id."""
    rows = spread(vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).filter("vec IS NOT NULL"), "vectors")
    asked = materialize(queries.select(F.col(qid).alias("qid"), F.col(qvec).cast("array<double>").alias("vec")).filter("vec IS NOT NULL"), "asked")
    count = -(-(asked.agg(F.sum(F.size("vec"))).first()[0] or 0) // SENT)
    found = [_nearest(rows, asked if count == 1 else asked.filter(F.pmod(F.hash("qid"), F.lit(count)) == i), k) for i in range(count)]
    if not found:
        found = [rows.crossJoin(asked).select("qid", F.col("id").alias("cid"), F.lit(0.0).alias("score"), F.lit(0).alias("rank"))]
    return reduce(DataFrame.unionByName, found).withColumnRenamed("cid", id_col)


def _nearest(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(qid, cid, score, rank) of questions (qid, vec) that are sent to all tasks."""
    part = asked.toArrow().combine_chunks()
    qids = part["qid"].combine_chunks()
    q = np.ascontiguousarray(unit_rows(part["vec"].combine_chunks()).T) if part.num_rows else np.zeros((0, 0))
    kind = rows.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = scoring.Best(len(qids), k, False, PLACES)
        step, arrow = max(1, CELLS // max(1, len(qids))), pa.int64()
        for b in batches if len(qids) else ():
            arrow, ids = b.column("id").type, b.column("id").to_numpy(zero_copy_only=False)
            ids = np.array(ids.tolist()) if ids.dtype == object else ids
            x = unit_rows(b.column("vec"))
            for at in range(0, len(ids), step):
                top.add(x[at : at + step] @ q, ids[at : at + step], 0)
        yield from top.batch(qids, arrow)

    local = rows.mapInArrow(run, scoring.out_schema(qids, kind))
    return materialize(ranked(local, k, F.asc("cid")), "nearest")
