"""Embedding near-duplicates by epsilon grid order (operator 9).

Unit vectors within cosine ``COSINE`` are within a distance eps of each other. They are rotated to
their principal axes, which keeps distances, and sorted by the grid cells of width eps on the
leading ``AXES`` of them. The sequence is cut into blocks; two blocks whose boxes are further apart
than eps hold no pair. Blocks that may are joined by halving both intervals again and again, with
the same test, down to leaves that are compared by one matrix product.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import materialize

COSINE, AXES, BLOCK, LEAF = 0.95, 8, 4096, 256


def epsilon(cosine: float) -> float:
    return math.sqrt(max(0.0, 2 - 2 * cosine))


def _unit(column, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the usable rows of an Arrow list column, and which rows these are."""
    sizes = np.diff(column.offsets.to_numpy().astype(np.int64))
    ok = (sizes == dim) & column.is_valid().to_numpy(zero_copy_only=False)
    flat = column.filter(pa.array(ok)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become nan
    x = flat.reshape(-1, dim)
    with np.errstate(all="ignore"):
        norm = np.sqrt((x * x).sum(1))
    good = np.isfinite(norm) & (norm > 0)
    ok[np.flatnonzero(ok)[~good]] = False
    return x[good] / norm[good, None], ok


def principal_axes(vectors: DataFrame, dim: int, vec_col: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean, the AXES leading principal axes (dim x AXES) and the number of usable vectors. Tasks
    send sums; what is collected are dim * (dim + 1) + 1 numbers."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dim * (dim + 1) + 1)
        for batch in batches:
            x, _ = _unit(batch.column(0), dim)
            total += np.concatenate([(x.T @ x).ravel(), x.sum(0), [len(x)]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["i", "s"])

    got = vectors.select(F.col(vec_col)).mapInArrow(sums, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()
    total = np.zeros(dim * (dim + 1) + 1)
    for r in got:
        total[r["i"]] = r["s"]
    n = int(total[-1])
    mean = total[dim * dim : -1] / max(n, 1)
    _, axes = np.linalg.eigh(total[: dim * dim].reshape(dim, dim) / max(n, 1) - np.outer(mean, mean))
    return mean, axes[:, ::-1][:, :AXES], n


def _apart(lo_a, hi_a, lo_b, hi_b) -> float:
    """Squared distance of two boxes."""
    gap = np.maximum(0, np.maximum(lo_a - hi_b, lo_b - hi_a))
    return float((gap * gap).sum())


def join_blocks(xa, ya, ia, xb, yb, ib, cosine: float) -> dict[int, int]:
    """For each id of either block the smallest smaller id of the other within ``cosine``; x are
    unit vectors, y their coordinates on the leading axes, i their ids. A block joined with
    itself finds its own pairs."""
    limit = epsilon(cosine) ** 2 * (1 + 1e-6) + 1e-9
    best: dict[int, int] = {}

    def boxes(y):
        k = range(0, len(y), LEAF)
        return np.array([y[i : i + LEAF].min(0) for i in k]), np.array([y[i : i + LEAF].max(0) for i in k])

    (la, ha), (lb, hb) = boxes(ya), boxes(yb)

    def note(ids, least):
        for i, v in zip(ids.tolist(), least.tolist()):
            if v < i and v < best.get(i, i):
                best[i] = v

    stack = [(0, len(la), 0, len(lb))]
    none = np.iinfo(np.int64).max
    while stack:
        a0, a1, b0, b1 = stack.pop()
        if a0 >= a1 or b0 >= b1 or _apart(la[a0:a1].min(0), ha[a0:a1].max(0), lb[b0:b1].min(0), hb[b0:b1].max(0)) > limit:
            continue
        if a1 - a0 == b1 - b0 == 1:
            pa_, pb = slice(a0 * LEAF, a1 * LEAF), slice(b0 * LEAF, b1 * LEAF)
            near = xa[pa_] @ xb[pb].T >= cosine
            if near.any():
                note(ia[pa_], np.where(near, ib[pb][None], none).min(1))
                note(ib[pb], np.where(near, ia[pa_][:, None], none).min(0))
        elif a1 - a0 >= b1 - b0:
            m = (a0 + a1) // 2
            stack += [(a0, m, b0, b1), (m, a1, b0, b1)]
        else:
            m = (b0 + b1) // 2
            stack += [(a0, a1, b0, m), (a0, a1, m, b1)]
    return best


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = COSINE,
                    block: int = BLOCK) -> DataFrame:
    """(id, first_id): every vector that has one with a smaller id within ``cosine``, and the
    smallest such id. What isn't listed can be kept without a near-duplicate of it before it.

    Equal vectors are one in the join, that of the smallest id, so that many copies of one don't meet each other.
    Rows without an id, and vectors that are null, zero, not finite, or of another length than
    the commonest one (of equally common ones the shortest), are left out. Rows that repeat an id aren't duplicates of each other.
    A pair at the threshold counts as near, within the error of double precision. An empty table has no
    rows; other columns are ignored; ids are cast to bigint.
    """
    spark = vectors.sparkSession
    usable = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).filter("id IS NOT NULL AND size(v) > 0")
    head = usable.select(F.size("v").alias("n")).groupBy("n").count().orderBy(F.desc("count"), "n").first()
    if head is None:
        return spark.createDataFrame([], "id bigint, first_id bigint")
    dim = int(head["n"])
    usable = usable.withColumn("h", F.xxhash64("v"))
    same = materialize(usable.groupBy("h").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "same")
    copies = materialize(usable.join(same, "h").filter("id <> rep").select("id", "h", "rep").distinct(), "copies")
    usable = usable.join(copies.select("id", "h"), ["id", "h"], "left_anti").select("id", "v")
    mean, axes, n = principal_axes(usable, dim, "v")
    eps = epsilon(cosine)
    k = axes.shape[1]

    def rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, ok = _unit(batch.column(1), dim)
            y = (x - mean) @ axes
            lists = lambda m, kind: pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel(), kind))
            cells = np.floor(y / max(eps, 1e-6)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), lists(cells, pa.int32()), lists(y, pa.float64()), lists(x, pa.float64())], ["id", "g", "y", "x"])

    grid = usable.mapInArrow(rotate, "id bigint, g array<int>, y array<double>, x array<double>")
    parts = max(1, math.ceil(n / block))
    order = [F.col("g")[i] for i in range(k)]
    placed = grid.repartitionByRange(parts, *order, F.col("y")[0], F.xxhash64("id")).sortWithinPartitions(*order, F.col("y")[0])
    blocks = materialize(placed.withColumn("__block", F.spark_partition_id()).select("__block", "id", "y", "x"), "grid")
    boxes = blocks.groupBy("__block").agg(*[f(F.col("y")[i]).alias(f"{n}{i}") for i in range(k) for n, f in (("lo", F.min), ("hi", F.max))])
    boxes = materialize(boxes, "boxes")
    width = max(eps, 1e-6)
    cell = lambda c, d: (F.floor(F.col(c) / width) + d).cast("bigint")
    left = boxes.select(*[F.col(c).alias(f"a_{c}") for c in boxes.columns], F.explode(F.sequence(cell("lo0", -1), cell("hi0", 1))).alias("cell"))
    right = boxes.select(*[F.col(c).alias(f"b_{c}") for c in boxes.columns], F.explode(F.sequence(cell("lo0", 0), cell("hi0", 0))).alias("cell"))
    gap = F.lit(0.0)
    for i in range(k):
        g = F.greatest(F.lit(0.0), F.col(f"a_lo{i}") - F.col(f"b_hi{i}"), F.col(f"b_lo{i}") - F.col(f"a_hi{i}"))
        gap = gap + g * g
    pairs = (left.join(right, "cell").filter("a___block <= b___block").filter(gap <= eps * eps * (1 + 1e-6) + 1e-9)
             .select(F.col("a___block").alias("ba"), F.col("b___block").alias("bb")).distinct())
    content = blocks.groupBy("__block").agg(F.sort_array(F.collect_list(F.struct("y", "id", "x"))).alias("rows"))
    content = materialize(content, "content")
    tasks = (pairs.join(content.select(F.col("__block").alias("ba"), F.col("rows").alias("ra")), "ba")
             .join(content.select(F.col("__block").alias("bb"), F.col("rows").alias("rb")), "bb").select("ra", "rb"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def unpack(column, i):
            s = column[i].values
            flat = lambda f, m: np.asarray(s.field(f).flatten()).reshape(-1, m)
            return flat("x", dim), flat("y", k), np.asarray(s.field("id"))

        for batch in batches:
            for i in range(batch.num_rows):
                best = join_blocks(*unpack(batch.column(0), i), *unpack(batch.column(1), i), cosine)
                yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int64()), pa.array(list(best.values()), pa.int64())], ["id", "first_id"])

    found = materialize(tasks.mapInArrow(joined, "id bigint, first_id bigint").groupBy("id").agg(F.min("first_id").alias("first_id")), "near")
    again = copies.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("id", F.coalesce("first_id", "rep").alias("first_id"))
    return found.unionByName(again).groupBy("id").agg(F.min("first_id").alias("first_id"))


def op9_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    """The vectors with an earlier near-duplicate, and that one."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.select(F.col("id").alias("vec_id"), F.col("first_id").alias("first_vec_id"))


QUERIES = {"op9_embedding_near_dedup": op9_embedding_near_dedup}
SQL = {"op9_embedding_near_dedup": f"""
SELECT b.vec_id, min(a.vec_id) AS first_vec_id
FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= {COSINE}
GROUP BY b.vec_id"""}
