"""SimHash near-duplicates (operator 5).

The fingerprint is the sign pattern of random hyperplanes on the set of a document's
words. Its bits are put into ``TABLES`` orders, each split into ``BLOCKS`` blocks of
``BLOCK_BITS`` bits. Any two fingerprints that differ in fewer bits than there are blocks agree
on one block of each order at least (pigeonhole). A pair at the threshold, which differs in
18 % of its bits, shares a given block with probability 0.82 ** 24 = 0.0085 and one of all
TABLES * BLOCKS with more than 0.9.
Documents meet in a join on blocks and are then verified by Hamming distance.

A document has TABLES * BLOCKS blocks, of which nearly all are its own alone. So block values
aren't shuffled as rows but packed: a row has the values (three bytes each) of some thousand
documents for one block, and what meets in a part of the values is found by sorting arrays. The
parts are cut so that each has some PART values, whatever the table's size; values that a sample
shows to be widespread go around the parts, spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import buffers, materialize, mix, slices, words
from textloom.llm.components import connect

BLOCKS, BLOCK_BITS = 64, 24
#: Orders of the bits that are split into blocks; the first is the bits' own.
TABLES = 5
#: Bits that verification compares, and the most that may differ.
VERIFY_BITS, MAX_DISTANCE = 512, 92
#: Words of fewer bytes are mostly function words, which all texts of a language share.
MIN_WORD_BYTES = 4
SKETCH = 1024
#: Values that meet in one array; documents of a packed row.
PART, BATCH = 1 << 21, 2048
#: A block value that more than 1 / HOT of a sample of documents (one of SAMPLE) have is spread.
HOT, SAMPLE = 200, 256
#: Rounds of stars end where the blocks have at most so many open pairs a row, or where a round
#: left more than the share SLOW of them.
FEW_PAIRS, SLOW = 4, 0.8

_plane: list[np.ndarray] = []


def _planes() -> np.ndarray:
    if not _plane:
        rng = np.random.default_rng(20240521)
        _plane.append(rng.standard_normal((SKETCH, BLOCKS * BLOCK_BITS)).astype(np.float32))
    return _plane[0]


def fingerprints(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits (rows x BLOCKS*BLOCK_BITS, bool) of the texts at ``offsets``. Each distinct word
    adds one signed unit to one of SKETCH coordinates, which keeps angles; the hyperplanes
    then apply to that vector. A text without long words uses its short ones, and one
    without any word its raw bytes as one word."""
    n = len(offsets) - 1
    start, end, row, h = words(raw, offsets)
    long = end - start >= MIN_WORD_BYTES
    has_long = np.bincount(row[long], minlength=n) > 0
    keep = long | ~has_long[row]
    row, h = row[keep], h[keep]
    bare = np.flatnonzero(np.bincount(row, minlength=n) == 0)
    if len(bare):
        extra = [hash_bytes(raw[offsets[i] : offsets[i + 1]].tobytes()) for i in bare]
        row, h = np.concatenate([row, bare]), np.concatenate([h, np.array(extra, np.uint64)])
    key = mix(h + row.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))  # distinct within the row
    _, first = np.unique(key, return_index=True)
    row, h = row[first], h[first]
    cell = (h & np.uint64(SKETCH - 1)).astype(np.int64)
    sign = ((h >> np.uint64(40)) & np.uint64(1)).astype(np.float64) * 2 - 1
    x = np.bincount(row * SKETCH + cell, weights=sign, minlength=n * SKETCH).reshape(n, SKETCH)
    return x.astype(np.float32) @ _planes() > 0


def hash_bytes(b: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(b)


def _orders() -> np.ndarray:
    rng = np.random.default_rng(20240522)
    n = BLOCKS * BLOCK_BITS
    return np.concatenate([np.arange(n), *[rng.permutation(n) for _ in range(TABLES - 1)]])


_ORDERS = _orders()


def block_values(bits: np.ndarray) -> np.ndarray:
    """Value of each block (rows x TABLES*BLOCKS, uint32)."""
    n = len(bits)
    b = np.packbits(bits[:, _ORDERS].reshape(n, TABLES * BLOCKS, BLOCK_BITS), axis=2).astype(np.uint32)
    out = b[:, :, 0]
    for k in range(1, b.shape[2]):
        out = out | b[:, :, k] << np.uint32(8 * k)
    return out


WORDS = [f"__f{i}" for i in range(VERIFY_BITS // 64)]
BITS_BYTES = BLOCKS * BLOCK_BITS // 8


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets, raw = buffers(batch.column(2))
        for a, b in slices(offsets):
            for c in range(a, b, 512):
                d = min(b, c + 512)
                bits = np.packbits(fingerprints(raw, offsets[c : d + 1]), axis=1)
                fp = np.ascontiguousarray(bits[:, : VERIFY_BITS // 8]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(c, d - c), batch.column(1).slice(c, d - c), _binary(bits), *[pa.array(np.ascontiguousarray(fp[:, i])) for i in range(fp.shape[1])]],
                    ["id", "hash", "__bits", *WORDS])


def _binary(rows: np.ndarray) -> pa.Array:
    """The rows of a two-dimensional array as a binary array."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * (rows.shape[1] * rows.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(uid, id, hash, __bits, __f0...) of every row with an id and a text that isn't empty; uid
    numbers the rows, hash is that of the text."""
    text = F.col(text_col).cast("string")
    kept = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    kept = kept.filter("id IS NOT NULL AND length(text) > 0")
    fields = ", ".join(f"{w} bigint" for w in WORDS)
    return kept.mapInArrow(_prints, f"id bigint, hash bigint, __bits binary, {fields}").withColumn("uid", F.monotonically_increasing_id())


_PACKED = "part int, base bigint, vals binary, locs binary"
_MET = "k bigint, id bigint, m bigint, n int"


def _pack(fold: int, hot: list[int]):
    """Packed rows of the nodes (uid, __bits): for each block, and each of the 2**fold ranges of its
    values, the values that a run of documents has. Hot keys go to parts below 0."""
    per: dict[int, np.ndarray] = {}
    for k in hot:
        per.setdefault(k >> BLOCK_BITS, []).append(k & (1 << BLOCK_BITS) - 1)
    per = {t: np.array(sorted(v), np.uint32) for t, v in per.items()}
    size = BATCH << min(fold, 4)

    def bytes_of(v: np.ndarray) -> bytes:
        return v.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid = batch.column(0).to_numpy()
            offsets, raw = buffers(batch.column(1))
            cuts = np.flatnonzero(np.diff(uid) != 1) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(uid)]):
                for c in range(lo, hi, size):
                    d = min(hi, c + size)
                    n = d - c
                    vals = np.concatenate([block_values(np.unpackbits(raw[offsets[x] : offsets[min(d, x + 512)]].reshape(-1, BITS_BYTES), axis=1)) for x in range(c, d, 512)])
                    rows = []
                    for t in range(TABLES * BLOCKS):
                        v, loc = vals[:, t], None
                        if t in per:
                            is_hot = per[t][np.minimum(np.searchsorted(per[t], v), len(per[t]) - 1)] == v
                            at = np.flatnonzero(is_hot)
                            if len(at):
                                keys = np.int64(t) << BLOCK_BITS | v[at].astype(np.int64)
                                rows.append((-1 - (int(uid[c]) // size * 31 + t) % 4096, keys.tobytes(), at.astype(np.uint16).tobytes()))
                            loc = np.flatnonzero(~is_hot)
                            v = v[loc]
                        if not fold:
                            rows.append((t, bytes_of(v), b"" if loc is None else loc.astype(np.uint16).tobytes()))
                            continue
                        loc = np.arange(n) if loc is None else loc
                        sub = v >> np.uint32(BLOCK_BITS - fold)
                        order = np.argsort(sub, kind="stable")
                        edge = np.flatnonzero(np.diff(sub[order])) + 1
                        for o in np.split(order, edge) if len(order) else []:
                            rows.append(((t << fold) + int(sub[o[0]]), bytes_of(v[o]), loc[o].astype(np.uint16).tobytes()))
                    part, v, at = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(np.full(len(part), uid[c])), pa.array(v, pa.binary()), pa.array(at, pa.binary())], ["part", "base", "vals", "locs"])

    return run


def _meet(fold: int):
    """Of packed rows in the order of their parts, the members (k, id) of values that two or more documents
    have, with the smallest id m of them and their number n; both 0 for hot keys."""

    def shared(part: int, vals: list, ids: list) -> pa.RecordBatch | None:
        v, i = np.concatenate(vals), np.concatenate(ids)
        order = np.argsort(v, kind="stable")
        v, i = v[order], i[order]
        starts = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.zeros(0, np.int64)
        n = np.diff(np.append(starts, len(v)))
        many = np.repeat(n, n) > 1
        if not many.any():
            return None
        least = np.repeat(np.minimum.reduceat(i, starts), n)[many]
        k = np.int64(part >> fold) << BLOCK_BITS | v[many].astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(k), pa.array(i[many]), pa.array(least), pa.array(np.repeat(n, n)[many].astype(np.int32))], ["k", "id", "m", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, vals, ids = None, [], []
        for batch in batches:
            for part, base, v, at in zip(*(c.to_pylist() for c in batch.columns)):
                locs = np.frombuffer(at, np.uint16).astype(np.int64)
                if part < 0:
                    zero = np.zeros(len(locs), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(v, np.int64)), pa.array(base + locs), pa.array(zero), pa.array(zero.astype(np.int32))], ["k", "id", "m", "n"])
                    continue
                if part != now and vals:
                    if (out := shared(now, vals, ids)) is not None:
                        yield out
                    vals, ids = [], []
                now = part
                b = np.frombuffer(v, np.uint8).reshape(-1, 3).astype(np.uint32)
                vals.append(b[:, 0] | b[:, 1] << np.uint32(8) | b[:, 2] << np.uint32(16))
                ids.append(base + (locs if len(locs) else np.arange(len(b))))
        if vals and (out := shared(now, vals, ids)) is not None:
            yield out

    return run


def _hot(nodes: DataFrame) -> list[int]:
    """Block keys of more than 1 / HOT of a sample; as a document has TABLES * BLOCKS of them, they
    are at most HOT times as many, whatever the table's size. What is found doesn't
    change the result."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, raw = buffers(batch.column(0))
            for c in range(0, batch.num_rows, 512):
                v = block_values(np.unpackbits(raw[offsets[c] : offsets[min(batch.num_rows, c + 512)]].reshape(-1, BITS_BYTES), axis=1))
                yield pa.RecordBatch.from_arrays([pa.array((v.astype(np.int64) | np.arange(v.shape[1], dtype=np.int64)[None] << BLOCK_BITS).ravel())], ["k"])

    part = nodes.filter(F.pmod(F.xxhash64("uid"), F.lit(SAMPLE)) == 0).select("__bits")
    least = max(50, part.count() // HOT)
    return [r["k"] for r in part.mapInArrow(keys, "k bigint").groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("k").collect()]


def blocks(nodes: DataFrame) -> DataFrame:
    """(k, id, m, n) of the block values that two or more nodes (uid, __bits) have: the node, the
    smallest of them, and their number."""
    fold = 0
    count = nodes.count()
    while count >> fold > PART and fold < 16:
        fold += 1
    hot = _hot(nodes)
    packed = nodes.select("uid", "__bits").mapInArrow(_pack(fold, hot), _PACKED)
    met = packed.repartition("part").sortWithinPartitions("part").mapInArrow(_meet(fold), _MET)
    if not hot:
        return materialize(met, "blocks")
    met = materialize(met, "met")
    of = met.filter("n = 0").groupBy("k").agg(F.min("id").alias("__m"), F.count(F.lit(1)).cast("int").alias("__n"))
    return met.join(F.broadcast(of), "k", "left").select("k", "id", F.coalesce("__m", "m").alias("m"), F.coalesce("__n", "n").alias("n")).filter("n > 1")  # as many rows as _hot() has


def _distance(a: str, b: str):
    d = F.lit(0)
    for w in WORDS:
        d = d + F.bit_count(F.col(f"{a}.{w}").bitwiseXOR(F.col(f"{b}.{w}")))
    return d


def _verified(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those (a, b) of ``pairs`` within MAX_DISTANCE."""
    fp = nodes.select("uid", F.struct(*WORDS).alias("f"))
    return (
        pairs.join(fp.select(F.col("uid").alias("a"), F.col("f").alias("fa")), "a")
        .join(fp.select(F.col("uid").alias("b"), F.col("f").alias("fb")), "b")
        .filter(_distance("fa", "fb") <= MAX_DISTANCE)
        .select("a", "b"))


def _open(shared: DataFrame) -> tuple[DataFrame, int, int]:
    """Rows (k, id, c) of the blocks whose members aren't all of one component c, how many they
    are, and how many pairs of two components those blocks have."""
    mixed = shared.groupBy("k").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("k")
    left = materialize(shared.join(mixed, "k", "left_semi").select("k", "id", "c"), "blocks")
    of = left.groupBy("k", "c").agg(F.count(F.lit(1)).alias("n"))
    of = of.groupBy("k").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own"))
    rows, pairs = of.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum((F.col("n") * F.col("n") - F.col("own")) / 2), F.lit(0))).first()
    return left, int(rows), int(pairs)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, hash, class_size, keep, keep_hash) of every row that has a near-duplicate or a copy: how many
    rows its class has, and the id and text hash of the one that stays, the smallest id of the class (of several texts
    with that id the one of the smallest hash).

    Classes are the connected components of the pairs within MAX_DISTANCE of VERIFY_BITS that
    share a block. Rows of one fingerprint are one node. Each block's smallest node is
    compared with its others and, while the blocks have many pairs of nodes that aren't known to
    be connected, another one each round with those of other components, which keeps hot groups
    linear. In the end every pair that shares a block and isn't in one component yet is compared.
    """
    prints = materialize(fingerprint(docs, id_col, text_col), "simhash")
    same = prints.groupBy(*WORDS).agg(F.min("uid").alias("rep"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    exact = materialize(prints.select("uid", *WORDS).join(same, WORDS).filter("uid <> rep").select("uid", "rep"), "exact")
    nodes = prints.join(exact.select("uid"), "uid", "left_anti").withColumnRenamed("uid", "row").withColumn("uid", F.monotonically_increasing_id())
    nodes = materialize(nodes.select("uid", "row", "__bits", *WORDS), "nodes")
    shared = blocks(nodes)
    edges = prints.sparkSession.createDataFrame([], "a bigint, b bigint")
    star = shared.filter("id <> m").select(F.col("m").alias("a"), F.col("id").alias("b")).distinct()
    shared = shared.filter("n > 2")  # the only pair of a block of two is in the star
    turn, before = 0, None
    while True:
        edges = materialize(edges.unionByName(_verified(star, nodes)), "stars")
        part = connect(edges)
        shared = (shared.select("k", "id").join(part, "id", "left")
                  .select("k", "id", F.coalesce("keep", "id").alias("c")))
        shared, rows, pairs = _open(shared)
        if pairs <= FEW_PAIRS * rows or (before is not None and pairs > SLOW * before):
            break
        turn, before = turn + 1, pairs
        hub = shared.groupBy("k").agg(F.min_by(F.struct("id", "c"), F.struct(F.xxhash64("id", F.lit(turn)), "id")).alias("m"))
        star = (shared.join(hub, "k").filter("m.c <> c")
                .select(F.least("m.id", "id").alias("a"), F.greatest("m.id", "id").alias("b")).distinct())
    pairs = (shared.select("k", F.col("id").alias("a"), F.col("c").alias("ca"))
             .join(shared.select("k", F.col("id").alias("b"), F.col("c").alias("cb")), "k")
             .filter("a < b AND ca <> cb").select("a", "b").distinct())
    part = connect(edges.unionByName(_verified(pairs, nodes)))
    member = part.select(F.col("id").alias("uid"), "keep").unionByName(part.select(F.col("keep").alias("uid"), "keep").distinct())
    of = nodes.select("uid", F.col("row").alias("rep")).join(member, "uid").select("rep", F.col("keep").alias("class"))
    rows = prints.select("uid", "id", "hash").join(exact, "uid", "left").withColumn("rep", F.coalesce("rep", "uid")).join(of, "rep", "left")
    rows = materialize(rows.select("id", "hash", F.coalesce("class", -1 - F.col("rep")).alias("class")), "members")
    first = rows.groupBy("class").agg(F.count(F.lit(1)).alias("class_size"), F.min(F.struct("id", "hash")).alias("f")).filter("class_size > 1")
    return rows.join(first, "class").select("id", "hash", "class_size", F.col("f.id").alias("keep"), F.col("f.hash").alias("keep_hash"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keep, class_size): every document that isn't the first of its class of near-duplicates (see
    ``classes``), the smallest id of that class, which stays, and how many rows the class has.

    Rows without id or text belong to no class, and other columns are ignored. Rows that repeat an id
    and a text are copies of each other, listed only where another id stays for them; rows that
    repeat an id with another text are rows of their own. Ids are cast to bigint. An empty table
    has no classes; a text of any length is used whole.
    """
    return classes(docs, id_col, text_col).filter("id <> keep").select("id", "keep", "class_size").distinct()


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class: the smallest id's, of several texts with it the one of
    the smallest hash, of equal rows any (they are equal in id and text). Rows without id or text stay."""
    found = classes(docs, id_col, text_col)
    stay = (F.col("id") == F.col("keep")) & (F.col("hash") == F.col("keep_hash"))
    verdict = found.groupBy("id", "hash").agg(F.max(stay).alias("__stay"), F.count(F.lit(1)).alias("__rows")).filter("NOT __stay OR __rows > 1")
    verdict = verdict.select(F.col("id").alias("__id"), F.col("hash").alias("__hash"), "__stay")
    text = F.col(text_col).cast("string")
    whole = F.coalesce(F.col(id_col).cast("bigint").isNotNull() & (F.length(text) > 0), F.lit(False))
    joined = docs.filter(whole).withColumns({"__id": F.col(id_col).cast("bigint"), "__hash": F.xxhash64(text)}).join(verdict, ["__id", "__hash"], "left")
    # rows without a verdict are single, so one window over the join's own keys serves all: texts are shuffled once
    one = Window.partitionBy("__id", "__hash").orderBy("__id", "__hash")
    kept = joined.filter("coalesce(__stay, true)").withColumn("__n", F.row_number().over(one)).filter("__n = 1")
    return kept.drop("__id", "__hash", "__stay", "__n").unionByName(docs.filter(~whole))


def op5_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """(doc_id, keep_doc_id, class_size) of every near-duplicate, the document that stays for it, and
    the number of documents of its class."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return groups(docs).select(F.col("id").alias("doc_id"), F.col("keep").alias("keep_doc_id"), "class_size")


QUERIES = {"op5_simhash_near_dedup": op5_simhash_near_dedup}
SQL: dict[str, str] = {}
