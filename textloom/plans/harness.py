"""Tasks with planted answers, and the metrics that say how many are found again."""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import text as T

DEPTHS = tuple(x / 100 for x in (0, 10, 25, 50, 75, 90, 100))
SEED = 7
FILLER = ("river stone lantern harvest quiet morning window paper garden wooden bridge winter candle market distant engine copper village "
          "shadow orchard letter ribbon valley thunder basket mirror kettle saddle meadow harbor").split()
ENTITIES = ("falcon", "cedar", "onyx", "maple", "quartz", "heron", "basil", "ember", "lotus", "raven")
#: What is asked, and how the text says it without the question's words.
PARAPHRASES = (("Which traveller has been to Japan?", "{who} spent a spring beneath the slopes of Mount Fuji."),
               ("Who doesn't eat meat?", "{who} keeps to lentils and greens at every meal."),
               ("Who plays a string instrument?", "{who} tunes a cello before breakfast."),
               ("Who is afraid of heights?", "{who} turned pale on the second rung of the ladder."))


def filler(target_tokens: int, rng: random.Random) -> list[str]:
    """Sentences of 10 to 20 words until there are target_tokens / 1.3 words."""
    out, words = [], 0
    while words < target_tokens / 1.3:
        n = rng.randint(10, 20)
        out.append(" ".join(rng.choices(FILLER, k=n)).capitalize() + ".")
        words += n
    return out


def tasks(kind: str, rng: random.Random, depths=DEPTHS, hops: int = 2) -> list[dict]:
    """Items (question, gold, depth, entity, supports [(depth, sentence)]) of a kind: single, multihop
    or paraphrase."""
    if not depths:
        raise ValueError("depths must not be empty")
    out = []
    for i, depth in enumerate(depths):
        if kind == "single":
            entity, gold = f"{rng.choice(ENTITIES)}-{rng.randint(100, 999)}", str(rng.randint(1000000, 9999999))
            out.append({"question": f"What is the registry number of entity {entity}?", "gold": gold, "depth": depth, "entity": entity,
                        "supports": [(depth, f"The registry number of entity {entity} is {gold}.")]})
        elif kind == "multihop":
            names = [f"v{i}x{h}{rng.choice('abcdef')}" for h in range(hops)]
            gold = str(rng.randint(1000000, 9999999))
            s = [(rng.random(), f"variable {a} equal variable {b}.") for a, b in zip(names, names[1:])]
            out.append({"question": f"What is the value of variable {names[0]}", "gold": gold, "depth": depth, "entity": None,
                        "supports": [*s, (depth, f"variable {names[-1]} be {gold}.")]})
        elif kind == "paraphrase":
            ask, say = PARAPHRASES[i % len(PARAPHRASES)]
            who = rng.choice(ENTITIES).capitalize()
            out.append({"question": ask, "gold": who, "depth": depth, "entity": None, "supports": [(depth, say.format(who=who))]})
        else:
            raise ValueError(f"unknown task {kind!r}")
    return out


def distractors(n: int, rng: random.Random) -> list[str]:
    """Exactly n sentences like those of the single task, about other entities."""
    return [f"The registry number of entity {rng.choice(ENTITIES)}-{rng.randint(1000, 9999)} is {rng.randint(1000000, 9999999)}." for _ in range(n)]


def plant(sentences: list[str], supports: list[tuple[float, str]]) -> list[str]:
    """Supports at their depths of the text as it was, deepest first so that places don't move."""
    n, out = len(sentences), list(sentences)
    for at, s in sorted(((int(depth * n), s) for depth, s in supports), reverse=True):
        out.insert(at, s)
    return out


def haystack(spark: SparkSession, kind: str, tokens: int, n_distractors: int = 0, seed: int = SEED, depths=DEPTHS, hops: int = 2) -> tuple[DataFrame, DataFrame]:
    """Documents (one text) and questions (qid, question, gold, depth, entity)."""
    rng = random.Random(seed)
    items = tasks(kind, rng, depths, hops)
    s = filler(tokens, rng)
    for d in distractors(n_distractors, rng):
        s.insert(rng.randint(0, len(s)), d)
    s = plant(s, [x for i in items for x in i["supports"]])
    docs = spark.createDataFrame([(0, "haystack", " ".join(s), "prose", None)], "doc_seq bigint, title string, text string, kind string, repo string")
    return docs, spark.createDataFrame([(i, x["question"], x["gold"], float(x["depth"]), x["entity"]) for i, x in enumerate(items)], "qid bigint, question string, gold string, depth double, entity string")


def recall(hits: DataFrame, questions: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """One row: items, recall, answer recall, and what was found at each depth."""
    text = hits.groupBy("qid").agg(F.array_join(F.collect_list("text"), "\n").alias("t"))
    j = questions.join(text, "qid", "left").withColumn("found", F.coalesce(F.col("t").contains(F.col("gold")), F.lit(False)))
    j = j.join(answers, "qid", "left").withColumn("answered", F.coalesce(F.trim("answer") == F.col("gold"), F.lit(False))) if answers is not None else j.withColumn("answered", F.lit(None).cast("boolean"))
    return j.agg(F.count(F.lit(1)).alias("items"), F.avg(F.col("found").cast("int")).alias("recall"), F.avg(F.col("answered").cast("int")).alias("answer_recall"),
                 F.sort_array(F.collect_list(F.struct("depth", "found", "answered"))).alias("per_depth"))


def run_one(spark: SparkSession, kind: str, tokens: int, search: Callable[[DataFrame, DataFrame], DataFrame], **task) -> DataFrame:
    """Generate, plant, chunk, index and search: ``search(index, questions)`` gives (qid, cid, ...)."""
    from textloom.operators import chunking, index

    docs, q = haystack(spark, kind, tokens, **task)
    x = index.build(chunking.chunk(docs))
    return recall(search(x, q).join(x.chunks.select("cid", "text"), "cid"), q).withColumn("task", F.lit(kind)).withColumn("tokens", F.lit(tokens))


def rubric_recall(facts: DataFrame, hits: DataFrame, share: float = 0.8) -> DataFrame:
    """(ability, facts, recall), with a row of all (null): a fact (qid, ability, fact) counts as recalled
    when ``share`` of its tokens are in the question's hits (qid, text)."""
    have = hits.groupBy("qid").agg(F.array_distinct(F.flatten(F.collect_list(T.terms(F.col("text"))))).alias("have"))
    j = facts.join(have, "qid").withColumn("want", F.array_distinct(T.terms(F.col("fact"))))
    ok = F.size(F.array_intersect("want", "have")) >= F.greatest(F.lit(1), F.ceil(share * F.size("want")))
    return j.rollup("ability").agg(F.count(F.lit(1)).alias("facts"), F.round(F.avg(ok.cast("int")), 6).alias("recall"))


def anchor_hits(hits: DataFrame, anchors: DataFrame) -> DataFrame:
    """(qid, hits, top1): how many hits have the folded anchor, and whether the best one does."""
    j = hits.join(anchors, "qid").withColumn("ok", T.fold(F.col("text")).contains(F.col("anchor")))
    got = j.groupBy("qid").agg(F.sum(F.col("ok").cast("bigint")).alias("hits"), F.max((F.col("ok") & (F.col("rank") == 0)).cast("int")).alias("top1"))
    return anchors.select("qid").join(got, "qid", "left").select("qid", F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("top1", F.lit(0)).alias("top1"))


def stale_anchors(anchors: DataFrame, chunks: DataFrame) -> DataFrame:
    """Anchors (qid, anchor) that no chunk has; they say nothing about a search."""
    t = chunks.select(T.fold(F.col("text")).alias("t"))
    return anchors.join(t, F.col("t").contains(F.col("anchor")), "left_anti")


def retrieval_metrics(hits: DataFrame, items: DataFrame) -> DataFrame:
    """(scope, items, hit, top1_in_scope) of items (qid, scope, gold array, anchor) and hits (qid, rank,
    text, source), with a row of all."""
    j = items.join(hits, "qid", "left")
    ok = T.any_gold(F.col("text"), F.col("gold")).isNotNull() | T.fold(F.col("text")).contains(T.fold(F.col("anchor")))
    top = (F.col("rank") == 0) & F.startswith(F.col("source"), F.concat("scope", F.lit("/")))
    per = j.groupBy("qid", "scope").agg(F.max(F.coalesce(ok, F.lit(False)).cast("int")).alias("hit"), F.max(F.coalesce(top, F.lit(False)).cast("int")).alias("top1"))
    return per.rollup("scope").agg(F.count(F.lit(1)).alias("items"), F.sum("hit").alias("hit"), F.sum("top1").alias("top1_in_scope"))


def memory_cost(spark: SparkSession, contexts: list[int], layers: int = 28, kv_heads: int = 4, head_dim: int = 128, bytes_: int = 2, weights_gb: float = 15.2) -> DataFrame:
    """(context, kv_gb, total_gb): a key and a value for each layer and head, the weights, and 1 GB."""
    kv = F.col("context") * (2 * layers * kv_heads * head_dim * bytes_) / 1e9
    return spark.createDataFrame([(c,) for c in contexts], "context bigint").select("context", kv.alias("kv_gb"), (kv + weights_gb + 1).alias("total_gb"))


def sweep(spark: SparkSession, kinds: list[str], sizes: list[int], searches: dict[str, Callable], **task) -> DataFrame:
    """One row (condition, task, tokens, items, recall, ...) for each condition, task and size: texts,
    chunks and questions are the same for all conditions."""
    from functools import reduce as fold

    rows = [run_one(spark, kind, size, f, **task).withColumn("condition", F.lit(name)) for name, f in searches.items() for kind in kinds for size in sizes]
    return fold(DataFrame.unionByName, rows)


def report(rows: DataFrame) -> str:
    """A table of recalls and, for the largest size of each condition and task, the depths."""
    out = []
    for r in rows.orderBy("condition", "task", "tokens").collect():
        answered = "".join(f"{100 * a:.0f}%" for a in (r["answer_recall"],) if a is not None) or "-"
        out.append(f"{r['condition']:<12} {r['task']:<10} {r['tokens']:>9} {100 * r['recall']:>4.0f}% {answered:>5}")
    best = rows.groupBy("condition", "task").agg(F.max_by("per_depth", "tokens").alias("d")).orderBy("condition", "task").collect()
    out += [f"{r['condition']} {r['task']}: " + ", ".join(f"{d['depth']:.2f} {'OK' if d['found'] else 'MISS'}" for d in r["d"]) for r in best]
    return "\n".join(out)


def naive_answers(chunks: DataFrame, questions: DataFrame, k: int = 5) -> DataFrame:
    """(qid, answer) of the simplest system: hashed vectors and the regular-expression reader."""
    from textloom.operators import dense, reduce

    hits = dense.hash_search(chunks, questions, k).join(chunks.select("cid", "text"), "cid")
    return reduce.answer(hits, questions, reduce.regex_reader, 1 << 30)
