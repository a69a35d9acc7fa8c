"""Best-fit packing by patterns (operator 3).

Lengths are rounded up to ``BINS`` bins of the context, and a pattern is a multiset of a few
bins that fills it exactly. Non-negative least squares on the histogram of all lengths says how
often each pattern is to be repeated; the counts are rounded down, and what is left is packed
best fit, bin by bin. All of this works on the histogram, whatever the number of documents; each
document then finds its place by its rank within its bin.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import materialize, prefix_sums
from textloom.llm.counting import VOCABULARY, token_counts

CONTEXT, BINS, PARTS = 2048, 64, 4


@lru_cache(maxsize=4)
def patterns(bins: int = BINS, parts: int = PARTS) -> np.ndarray:
    """All multisets of at most ``parts`` bins that sum to ``bins``: a row for each with the
    number of documents of each bin 1..bins."""
    found: list[tuple[int, ...]] = []

    def extend(left: int, largest: int, taken: tuple[int, ...]) -> None:
        if left == 0:
            found.append(taken)
        elif len(taken) < parts:
            for b in range(min(left, largest), 0, -1):
                if b * (parts - len(taken)) >= left:
                    extend(left - b, b, (*taken, b))

    extend(bins, bins, ())
    out = np.zeros((len(found), bins))
    for i, p in enumerate(found):
        for b in p:
            out[i, b - 1] += 1
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """x >= 0 that makes |a x - b| smallest, by active sets (Lawson and Hanson)."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    tol = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(rounds):
        w = a.T @ (b - a @ x)
        w[passive] = -np.inf
        j = int(np.argmax(w)) if n else 0
        if not n or w[j] <= tol:
            break
        passive[j] = True
        while True:
            k = np.flatnonzero(passive)
            z = np.linalg.lstsq(a[:, k], b, rcond=None)[0]
            if (z > tol * 1e-6).all():
                x[:] = 0
                x[k] = z
                break
            low = z <= tol * 1e-6
            step = np.min(x[k][low] / np.maximum(x[k][low] - z[low], 1e-300))
            x[k] += min(1.0, max(0.0, step)) * (z - x[k])
            drop = low & (x[k] <= 1e-9 * max(1.0, x.max(initial=0)))
            if not drop.any():
                drop = low
            x[k[drop]] = 0
            passive[k[drop]] = False
            if not passive.any():
                break
    return x


def plan(histogram: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """(documents of each bin, repeats) that use up ``histogram`` (counts of bins 1..)."""
    left = histogram.astype(np.int64).copy()
    if not left.any():
        return []
    shapes = patterns(len(left))
    wanted = np.floor(nnls(shapes.T, left / left.max()) * left.max()).astype(np.int64)
    out = []
    for p in np.argsort(-wanted, kind="stable"):
        use = shapes[p].astype(np.int64)
        n = min(int(wanted[p]), int((left[use > 0] // use[use > 0]).min()))
        if n > 0:
            left -= n * use
            out.append((use, n))
    while left.any():
        use, room = np.zeros(len(left), np.int64), len(left)
        while room:
            fit = np.flatnonzero(left[:room] - use[:room] > 0)
            if not len(fit):
                break
            use[fit[-1]] += 1
            room -= fit[-1] + 1
        n = int((left[use > 0] // use[use > 0]).min())
        left -= n * use
        out.append((use, n))
    return out


def places(packs: list[tuple[np.ndarray, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(bin, first rank, end rank, first pack, documents of the bin in a pack, first slot)."""
    rows, base = [], 0
    start = np.zeros(len(packs[0][0]), np.int64) if packs else np.zeros(0, np.int64)
    for use, n in packs:
        slot = 0
        for b in np.flatnonzero(use)[::-1]:
            m = int(use[b])
            rows.append((int(b) + 1, int(start[b]), int(start[b]) + n * m, base, m, slot))
            start[b] += n * m
            slot += m
        base += n
    return rows


def pack(lengths: DataFrame, id_col: str = "doc_id", length_col: str = "n_tokens", context: int = CONTEXT,
         bins: int = BINS) -> DataFrame:
    """(pack_id, slot, id, piece, start, n_tokens): where each document, or each piece of one that
    is longer than the context, goes. Every token is in exactly one pack, and no pack holds
    more than ``context`` of them.

    Rows with a null or non-positive length aren't packed; a null id is an id. Rows that repeat
    an id are documents of their own. The order within a bin is that of ids and pieces.
    """
    spark = lengths.sparkSession
    width = -(-context // bins)
    n = F.col("__n")
    pieces = (lengths.select(F.col(id_col).alias("__id"), F.col(length_col).cast("bigint").alias("__n")).filter("__n > 0")
              .withColumn("__piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(__n - 1) div {context}"))))
              .withColumn("__start", F.col("__piece") * context)
              .withColumn("__len", F.least(n - F.col("__start"), F.lit(context).cast("bigint")))
              .withColumn("__bin", F.expr(f"cast((__len + {width - 1}) div {width} as int)"))
              .select("__id", "__piece", "__start", "__len", "__bin"))
    ranked = materialize(prefix_sums(pieces, "__bin", ["__id", "__piece"]), "ranked")
    histogram = np.zeros(bins, np.int64)
    for r in ranked.groupBy("__bin").count().collect():  # at most one row for each bin
        histogram[r["__bin"] - 1] = r["count"]
    rows = places(plan(histogram))
    table = spark.createDataFrame(rows, "bin int, r0 bigint, r1 bigint, base bigint, m bigint, slot bigint")
    out = ranked.join(F.broadcast(table), (F.col("__bin") == F.col("bin")) & (F.col("rank") >= F.col("r0")) & (F.col("rank") < F.col("r1")))
    return out.select(
        F.expr("base + (rank - r0) div m").alias("pack_id"), F.expr("slot + (rank - r0) % m").alias("slot"),
        F.col("__id").alias(id_col), F.col("__piece").alias("piece"), F.col("__start").alias("start"), F.col("__len").alias("n_tokens"))


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", context: int = CONTEXT,
                   vocabulary: str = VOCABULARY) -> DataFrame:
    """``pack`` by the documents' token counts."""
    lengths = materialize(token_counts(docs, text_col, "__tokens", vocabulary, [id_col]), "lengths")
    return pack(lengths, id_col, "__tokens", context)


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """The places of all documents' tokens in packs of the context length."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op3_best_fit_packing": op3_best_fit_packing}
SQL: dict[str, str] = {}
