"""The inverted index as tables, its snapshots, and appends.

``postings(term, cid, tf, dl)``, ``doclen(cid, dl)`` and ``chunks`` are stored; document frequencies, N and
the average length are aggregated from them, so that an append needs no rewrite. A chunk
without a token has a row in ``doclen`` and counts in N and the average.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators.storage import materialize

BAG = "array<struct<term: string, tf: bigint>>"


@dataclass
class Index:
    """Tables of one version of an index."""

    chunks: DataFrame
    postings: DataFrame
    doclen: DataFrame
    verified: DataFrame | None = None
    meta: dict = field(default_factory=dict)
    bags: DataFrame | None = None
    #: Whether the terms are counted and written, or counted from the texts whenever they are needed.
    counted: bool = True
    latest: dict = field(default_factory=dict, repr=False)

    @property
    def term_stats(self) -> DataFrame:
        return self.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))

    @property
    def corpus(self) -> DataFrame:
        """One row: N and avgdl."""
        return self.doclen.agg(F.count(F.lit(1)).alias("N"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))

    def get(self, cid: int) -> str | None:
        row = self.chunks.filter(F.col("cid") == cid).select("text").first()
        return row[0] if row else None

    def source_of(self, cid: int) -> str | None:
        row = self.chunks.filter(F.col("cid") == cid).select("source").first()
        return row[0] if row else None

    def status(self) -> DataFrame:
        """Chunks, text bytes and a token estimate."""
        return self.chunks.agg(F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).withColumn("tokens", F.floor(F.col("bytes") / 4))


def build(chunks: DataFrame, verified: DataFrame | None = None, stored: bool = True) -> Index:
    """Index ``chunks`` (cid, text, ... ). Their terms are counted once and written or, for an index that is read
    once or twice, counted as they are read: writing and reading all bags takes longer than counting."""
    return replace(of_bags(chunks, materialize(bags(chunks), "bags") if stored else bags(chunks), verified), counted=stored)


def bags(chunks: DataFrame) -> DataFrame:
    """(cid, dl, b): how often each chunk has each of its terms. A chunk is one row, so that nothing
    is shuffled; terms are counted in Python, by Arrow batches."""
    kind = chunks.schema["cid"].dataType.simpleString()
    return chunks.select("cid", "text").mapInArrow(T.count_terms(["cid"]), f"cid {kind}, dl int, b {BAG}")


def of_bags(chunks: DataFrame, bags: DataFrame, verified: DataFrame | None = None) -> Index:
    """An index over bags (cid, dl, b: array of (term, tf)), the form in which tokens are counted once."""
    postings = bags.select("cid", "dl", F.explode("b").alias("x")).select(F.col("x.term").alias("term"), "cid", F.col("x.tf").alias("tf"), "dl")
    return Index(chunks, postings, bags.select("cid", "dl"), verified, bags=bags)


def save(index: Index, path: str) -> str:
    """Write a new version below ``path`` and make it the current one. Readers of an older version
    aren't disturbed; returns the version."""
    spark = index.chunks.sparkSession
    version = uuid.uuid4().hex
    index.chunks.write.parquet(f"{path}/{version}/chunks")
    index.postings.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/{version}/postings")
    index.doclen.write.parquet(f"{path}/{version}/doclen")
    if index.verified is not None:
        index.verified.write.parquet(f"{path}/{version}/verified")
    meta = json.dumps({"version": version, "verified": index.verified is not None, **index.meta})
    spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{version}/meta")
    spark.createDataFrame([(version,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/current")
    return version


def load(spark: SparkSession, path: str, version: str | None = None) -> Index:
    """A version, by default the current one."""
    version = version or spark.read.text(f"{path}/current").first()[0]
    meta = json.loads(spark.read.text(f"{path}/{version}/meta").first()[0])
    read = lambda t: spark.read.parquet(f"{path}/{version}/{t}")
    return Index(read("chunks"), read("postings"), read("doclen"), read("verified") if meta["verified"] else None, meta)


def append(index: Index, chunks: DataFrame) -> Index:
    """The index with further chunks, whose ids have to be new."""
    new = build(chunks)
    both = index.bags.unionByName(new.bags) if index.bags is not None else None
    return Index(index.chunks.unionByName(chunks, allowMissingColumns=True), index.postings.unionByName(new.postings, allowMissingColumns=True), index.doclen.unionByName(new.doclen), index.verified, dict(index.meta), both)
