"""Mixing sources to target weights by systematic sampling (operator 2)."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import prefix_sums, without

#: Expected copies are whole numbers of this unit, so that sums don't depend on their order.
SCALE = 1_000_000
SEED = 20240607
#: Shares of the characters that named sources are to have; the others share the rest equally.
WEIGHTS = {"src0": 0.15, "src1": 0.10}


def draw(seed: int = SEED) -> int:
    """The one random offset, in units of 1 / SCALE."""
    return random.Random(seed).randrange(SCALE)


def expected(docs: DataFrame, weights: dict[str, float] | None, epochs: float,
             source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(source, __e): the copies, in units of 1 / SCALE, that each document of a source is to
    have for the source to reach its weight in an output of ``epochs`` times the input."""
    weights = weights or {}
    sizes = docs.groupBy(F.col(source_col).alias("__source")).agg(F.sum(F.length(text_col).cast("bigint")).alias("__size"))
    named = F.col("__source").isin(*weights) if weights else F.lit(False)
    named = F.coalesce(named, F.lit(False))
    rest = max(0.0, 1.0 - sum(weights.values()))
    weight = F.lit(rest) / F.greatest(F.col("__others"), F.lit(1))
    for name, w in weights.items():
        weight = F.when(F.col("__source") == name, F.lit(float(w))).otherwise(weight)
    totals = sizes.agg(F.sum("__size").alias("__total"), F.sum(F.when(named, 0).otherwise(1)).alias("__others"))
    copies = F.round(weight * F.col("__total") * F.lit(float(epochs)) / F.col("__size") * SCALE).cast("bigint")
    return sizes.crossJoin(F.broadcast(totals)).filter("__size > 0").select("__source", copies.alias("__e"))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, seed: int = SEED,
                id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
                copy_col: str | None = "copy") -> DataFrame:
    """Every document as often as the running sum of expected copies within its source, in
    the order of ids and shifted by the offset, passes a whole number; ``copy_col`` numbers
    the copies from 1 (None: no such column).

    Sources not in ``weights`` share what is left of 1 equally; a null source is a source.
    Rows with a null or empty text have no size and aren't emitted. Rows that repeat an id
    within a source share its copies evenly. A column called like ``copy_col`` is replaced.
    """
    offset = draw(seed)
    real = docs.filter(F.length(text_col) > 0)
    each = expected(real, weights, epochs, source_col, text_col)
    rows = real.groupBy(F.col(source_col).alias("__source"), F.col(id_col).alias("__id")).agg(F.count(F.lit(1)).alias("__m"))
    rows = (rows.join(each.withColumnRenamed("__source", "__s"), F.col("__source").eqNullSafe(F.col("__s")))
            .select("__source", "__id", "__m", (F.col("__m") * F.col("__e")).alias("__e")))
    summed = prefix_sums(rows, "__source", ["__id"], "__e", "__rank", "__before")
    passed = F.expr(f"(__before + __e + {offset}) div {SCALE} - (__before + {offset}) div {SCALE}")
    chosen = summed.select("__source", "__id", "__m", passed.alias("__c")).filter("__c > 0")
    # Keys without nulls: a plain equality, so that the join's partitioning serves the window as well.
    keys = lambda i, s: {"__k1": F.coalesce(i.cast("string"), F.lit("")), "__k2": F.coalesce(s.cast("string"), F.lit("")),
                         "__k3": F.when(i.isNull(), 1).otherwise(0) + F.when(s.isNull(), 2).otherwise(0)}
    base = (without(real, [copy_col]) if copy_col else real).withColumns(keys(F.col(id_col), F.col(source_col)))
    chosen = chosen.withColumns(keys(F.col("__id"), F.col("__source"))).select("__k1", "__k2", "__k3", "__m", "__c")
    out = base.join(chosen, ["__k1", "__k2", "__k3"])
    twin = Window.partitionBy("__k1", "__k2", "__k3").orderBy("__k1", "__k2", "__k3")
    out = out.withColumn("__r", F.row_number().over(twin)).withColumn("__c", F.expr("(__c + __m - __r) div __m")).filter("__c > 0")
    out = out.withColumn(copy_col or "__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__c"))))
    return out.drop("__k1", "__k2", "__k3", "__m", "__c", "__r", "__copy")


def op2_mix_sources(spark, sf_dir: str) -> DataFrame:
    """All emitted copies of documents, whole."""
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"), WEIGHTS)


def _sql() -> str:
    case = " ".join(f"WHEN source = '{k}' THEN {v!r}::DOUBLE" for k, v in WEIGHTS.items())
    names = ", ".join(f"'{k}'" for k in WEIGHTS)
    rest = max(0.0, 1.0 - sum(WEIGHTS.values()))
    u = draw()
    return f"""
WITH real AS (SELECT * FROM documents WHERE length(text) > 0),
sizes AS (SELECT source, sum(length(text))::BIGINT AS size FROM real GROUP BY source),
totals AS (SELECT sum(size)::BIGINT AS total, sum(CASE WHEN source IN ({names}) THEN 0 ELSE 1 END) AS others FROM sizes),
each AS (SELECT source, round((CASE {case} ELSE {rest!r}::DOUBLE / greatest(others, 1) END) * total * 1.0::DOUBLE / size * {SCALE})::BIGINT AS e
         FROM sizes, totals),
summed AS (SELECT r.*, e, coalesce(sum(e) OVER (PARTITION BY r.source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b
           FROM real r JOIN each ON r.source IS NOT DISTINCT FROM each.source)
SELECT doc_id, text, lang, source, n_chars, unnest(range(1, (b + e + {u}) // {SCALE} - (b + {u}) // {SCALE} + 1)) AS copy
FROM summed"""


QUERIES = {"op2_mix_sources": op2_mix_sources}
SQL = {"op2_mix_sources": _sql()}
