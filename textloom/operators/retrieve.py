"""Retrieval as a whole: pool, scope, tests, guide, verified results, stitching."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators.index import Index

MAX_SPAN, PULL = 2600, 1


def rerank_by(df: DataFrame, *keys, qid: str = "qid") -> DataFrame:
    """A stable reordering: new ranks by ``keys``, the old rank last."""
    w = Window.partitionBy(qid).orderBy(*keys, F.col("rank"))
    return df.withColumn("rank", F.row_number().over(w) - 1)


def scopes(questions: DataFrame, repos: DataFrame, scope_col: str | None = None) -> DataFrame:
    """(qid, repo): repositories that the question names or, where it names none, its default scope
    if that is one."""
    r = repos.select("repo").distinct()
    named = questions.crossJoin(F.broadcast(r)).filter(F.lower("question").contains(F.lower("repo"))).select("qid", "repo")
    if scope_col is None:
        return named
    rest = questions.join(named.select("qid").distinct(), "qid", "left_anti").join(r, questions[scope_col] == r.repo).select("qid", "repo")
    return named.unionByName(rest)


def scope_first(pool: DataFrame, wide: DataFrame, scoped: DataFrame, k: int) -> DataFrame:
    """``pool`` and ``wide`` are (qid, cid, score, rank, source). Of questions with a scope the hits in
    it come first; where these are fewer than k, the wider list adds its hits, in scope and out."""
    inside = scoped.groupBy("qid").agg(F.collect_set("repo").alias("__repos"))

    def mark(df: DataFrame) -> DataFrame:
        j = df.join(inside, "qid", "left")
        return j.withColumn("__in", F.coalesce(F.exists("__repos", lambda r: F.startswith(F.col("source"), F.concat(r, F.lit("/")))), F.lit(False)))

    p, w = mark(pool).withColumn("__wide", F.lit(0)), mark(wide).withColumn("__wide", F.lit(1))
    short = p.groupBy("qid").agg(F.sum(F.col("__in").cast("int")).alias("n"), F.max(F.col("__repos").isNotNull()).alias("has")).filter((F.col("n") < k) & F.col("has"))
    extra = w.join(short.select("qid"), "qid", "left_semi").join(pool.select("qid", "cid"), ["qid", "cid"], "left_anti")
    both = p.unionByName(extra)
    first = F.when(F.col("__repos").isNotNull() & ~F.col("__in"), 1).otherwise(0)
    out = both.withColumn("__w", first)
    order = Window.partitionBy("qid").orderBy("__w", "__wide", "rank")
    return out.withColumn("rank", F.row_number().over(order) - 1).drop("__w", "__wide", "__repos").withColumnRenamed("__in", "in_scope")


def tests_down(pool: DataFrame, questions: DataFrame) -> DataFrame:
    """Sources of tests and examples behind the others, unless the question is about tests."""
    q = questions.select("qid", F.lower("question").contains("test").alias("__t"))
    j = pool.join(q, "qid")
    return rerank_by(j.withColumn("__k", F.when(~F.col("__t") & T.is_testlike(F.col("source")), 1).otherwise(0)), F.col("__k")).drop("__k", "__t")


def guide_slot(pool: DataFrame, k: int) -> DataFrame:
    """If no guide is among the first k of more than k hits, the best one (in scope before others)
    takes place k; the hit that was there is dropped."""
    w = Window.partitionBy("qid")
    g = T.is_guide(F.col("source"))
    scope = F.col("in_scope") if "in_scope" in pool.columns else F.lit(False)
    j = pool.withColumn("__g", g).withColumn("__has", F.max(F.when(F.col("rank") < k, F.col("__g")).otherwise(False)).over(w)).withColumn("__n", F.count(F.lit(1)).over(w))
    best = F.min(F.when(F.col("__g") & (F.col("rank") >= k), F.struct((~scope).alias("o"), F.col("rank").alias("r")))).over(w)
    j = j.withColumn("__b", F.when(~F.col("__has") & (F.col("__n") > k), best.getField("r")))
    j = j.filter(F.col("__b").isNull() | (F.col("rank") != k - 1))
    j = j.withColumn("rank", F.when(F.col("rank") == F.col("__b"), k - 1).otherwise(F.col("rank")))
    return rerank_by(j).drop("__g", "__has", "__n", "__b")


def verified_first(pool: DataFrame, verified: DataFrame) -> DataFrame:
    """Sources with score 2, or none, before the others; ``verified`` is (source, score)."""
    v = verified.groupBy("source").agg(F.max("score").alias("__v"))
    j = pool.join(v, "source", "left")
    return rerank_by(j.withColumn("__k", F.when(F.coalesce("__v", F.lit(2)) == 2, 0).otherwise(1)), F.col("__k")).drop("__k", "__v")


def stitch_rows(rows: list[dict], k: int, pull: int = PULL, max_span: int = MAX_SPAN) -> list[tuple]:
    """(cid, cids, text, score, source) of one question. ``rows`` are its pool (rank not None) in any
    order, with the chunks next to it (rank None)."""
    known = {r["cid"]: r for r in rows}
    pool = sorted((r for r in rows if r["rank"] is not None), key=lambda r: r["rank"])
    used: set = set()
    out = []
    for seed in pool:
        if len(out) == k:
            break
        if seed["cid"] in used:
            continue
        span, size = [seed["cid"]], len(seed["text"])
        for step in (1, -1):
            at, pulled = seed["cid"] + step, 0
            while seed["source"] is not None and at in known and at not in used:
                n = known[at]
                if n["source"] != seed["source"] or n["text"] is None or size + len(n["text"]) > max_span:
                    break
                if n["rank"] is None:
                    if not seed["is_code"] or pulled >= pull:
                        break
                    pulled += 1
                span.append(at)
                size += len(n["text"])
                at += step
        span.sort()
        used.update(span)
        texts = [known[c]["text"] for c in span if known[c]["text"]] if len(span) > 1 else [seed["text"]]
        rest = [t.split("\n", 1)[1] if t.startswith("# file:") and "\n" in t else t for t in texts[1:]]
        out.append((span[0], span, "\n".join(texts[:1] + rest), seed["score"], seed["source"]))
    return out


def stitch(pool: DataFrame, index: Index, k: int, pull: int = PULL, max_span: int = MAX_SPAN) -> DataFrame:
    """(qid, rank, cid, cids, text, score, source): neighbours of one source in the pool become one
    passage of at most ``max_span`` characters; code also gets up to ``pull`` chunks on either side
    that weren't found. Greedy in the order of ranks, so it runs in Python for each question, on its
    pool and the chunks next to that."""
    p = pool.select("qid", "cid", "score", "rank")
    reach = range(-pull, pull + 1)
    near = p.select("qid", F.explode(F.array(*[F.col("cid") + d for d in reach])).alias("cid")).distinct()
    code = T.is_code(F.col("source")).alias("is_code")
    rows = near.join(p, ["qid", "cid"], "left").join(index.chunks.select("cid", "text", "source", code), "cid")
    kind = pool.schema["qid"].dataType.simpleString()

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        records = pdf.astype(object).where(pdf.notna(), None).to_dict("records")
        got = stitch_rows(records, k, pull, max_span)
        return pd.DataFrame([(key[0], i, *g) for i, g in enumerate(got)], columns=["qid", "rank", "cid", "cids", "text", "score", "source"])

    return rows.groupBy("qid").applyInPandas(run, f"qid {kind}, rank int, cid bigint, cids array<bigint>, text string, score double, source string")


def retrieve(index: Index, questions: DataFrame, search: Callable[[DataFrame, int], DataFrame], k: int = 5, repos: DataFrame | None = None,
             scope_col: str | None = None, reranker: Callable[[DataFrame], DataFrame] | None = None, stitched: bool = True) -> DataFrame:
    """All steps for all questions (qid, question). ``search(questions, n)`` gives (qid, cid, score, rank);
    ``reranker`` reorders such a table."""
    def pooled(n: int) -> DataFrame:
        hits = search(questions, n)
        hits = reranker(hits) if reranker else hits
        return hits.join(index.chunks.select("cid", "source"), "cid").select("qid", "cid", "score", "rank", "source")

    pool = pooled(3 * k)
    if repos is not None:
        scoped = scopes(questions, repos, scope_col)
        pool = scope_first(pool, pooled(max(12 * k, 60)), scoped, k)
        pool = guide_slot(tests_down(pool, questions), k)
    if index.verified is not None:
        pool = verified_first(pool, index.verified)
    return stitch(pool, index, k) if stitched else pool.filter(F.col("rank") < k)


def neighbours(hits: DataFrame, chunks: DataFrame, width: int = 1) -> DataFrame:
    """(qid, cid, near, text): chunks of the same document up to ``width`` away from each hit; an
    equi-join on document and chunk number, one row for each distance."""
    own = hits.select("qid", "cid").join(chunks.select("cid", "doc_seq", "chunk_no"), "cid")
    steps = F.explode(F.array(*[F.lit(d) for d in range(-width, width + 1) if d])).alias("d")
    want = own.select("qid", "cid", "doc_seq", "chunk_no", steps).withColumn("chunk_no", F.col("chunk_no") + F.col("d")).drop("d")
    return want.join(chunks.select("doc_seq", "chunk_no", F.col("cid").alias("near"), "text"), ["doc_seq", "chunk_no"]).select("qid", "cid", "near", "text")


# == output

def context_block(hits: DataFrame, separator: str = "\n\n---\n\n", label: str = "[{}] ", qid: str = "qid") -> DataFrame:
    """(qid, context): labelled texts (source, text, rank), best first. Untitled ones have no label."""
    head, tail = label.split("{}")
    line = F.concat(F.when(F.col("source").isNotNull(), F.concat(F.lit(head), F.col("source"), F.lit(tail))).otherwise(""), F.col("text"))
    rows = hits.groupBy(qid).agg(F.sort_array(F.collect_list(F.struct("rank", line.alias("t")))).alias("h"))
    return rows.select(qid, F.array_join(F.transform("h", lambda x: x.t), separator).alias("context"))


def source_footer(hits: DataFrame, qid: str = "qid") -> DataFrame:
    """(qid, footer): chunk ids by title, titles in the order in which they first come."""
    titles = hits.groupBy(qid, F.coalesce("source", F.lit("(untitled)")).alias("title")).agg(
        F.min("rank").alias("r"), F.sort_array(F.collect_list(F.struct("rank", "cid"))).alias("c"))
    line = F.concat("title", F.lit(" "), F.array_join(F.transform("c", lambda x: F.concat(F.lit("#"), x.cid)), " "))
    rows = titles.groupBy(qid).agg(F.sort_array(F.collect_list(F.struct("r", line.alias("t")))).alias("x"))
    return rows.select(qid, F.array_join(F.transform("x", lambda x: x.t), " · ").alias("footer"))
