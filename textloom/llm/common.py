"""Shared helpers: byte-level word hashing in numpy, materialisation in the shared
folder, and rank / prefix sums that don't put a hot key into one task."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that a numpy kernel works on at once; longer texts make a slice of their own.
SLICE_BYTES = 1 << 21

_MULT = np.uint64(0x9E3779B97F4A7C15)  # odd, hence invertible modulo 2**64
_MULT_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; only where that is
    unset (tests, a local session) is a temporary folder set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = "file://" + tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


#: Shuffle files of a query go when it has ended; else they stay until the driver collects its garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, what: str = "table", compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back. The copy doesn't
    depend on any executor, so a lost one costs no recomputation of the lineage, and the shuffles that made it aren't
    needed any more."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of materialised tables that nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._written)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` less its columns that clash (in any case) with ``names``."""
    low = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in low])


# == words

def _classes() -> tuple[np.ndarray, np.ndarray]:
    word = np.zeros(256, bool)
    word[128:] = True
    lower = np.arange(256, dtype=np.uint8)
    for lo, hi in ((48, 58), (65, 91), (97, 123)):
        word[lo:hi] = True
    lower[65:91] += 32
    return word, lower


_WORD, _LOWER = _classes()
_VISIBLE = np.ones(256, bool)
_VISIBLE[[9, 10, 11, 12, 13, 32]] = False
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64 for i < n, kept between calls."""
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES)
        for k, base in enumerate((_MULT, _MULT_INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply-xorshift rounds)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(arr) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64) and bytes of an Arrow string array, without a copy of the bytes."""
    kind = np.int64 if "large" in str(arr.type) else np.int32
    _, offs, data = arr.buffers()
    offsets = np.frombuffer(offs, kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return offsets, raw


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Row ranges [a, b) whose texts together have about ``limit`` bytes at most."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        b = min(b, n)
        yield a, b
        a = b


def words(raw: np.ndarray, offsets: np.ndarray, visible: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the texts raw[offsets[i]:offsets[i+1]]: first byte and end (positions in
    ``raw``), row, and 64-bit hash. A word is a maximal run of ASCII letters and digits and
    of bytes of other characters; ASCII case is folded, so the hash ignores it. With
    ``visible`` runs of any other visible characters are words too."""
    kind = _VISIBLE if visible else _WORD
    base, n = int(offsets[0]), int(offsets[-1] - offsets[0])
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    data = raw[base : base + n]
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = kind[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets - base] = True
    if visible:
        letter = _WORD[data]
        edge[1:-1] |= letter[1:] != letter[:-1]
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    p, inv = powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * p, out=total[1:])
    h = mix((total[end] - total[start]) * inv[start])
    row = np.searchsorted(offsets, start + base, "right") - 1
    return start + base, end + base, row, h


# == ranks and prefix sums

def prefix_sums(df: DataFrame, key: str, order: list[str], value: str | None = None,
                rank_name: str = "rank", sum_name: str = "before", parts: int | None = None) -> DataFrame:
    """Add to a narrow ``df`` the 0-based rank of each row within ``key`` in the order of
    ``order`` and, where ``value`` (a bigint) is given, the sum of it over the earlier rows.

    A window over ``key`` alone would bring a hot key into one task. Instead rows are range
    partitioned by (key, order), each range sums its own part, and the parts' offsets, one
    row for each key and range, are joined back. The ranges are written first, as both
    passes have to see the same ones. Null keys form a group of their own.
    """
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a hash of the whole row breaks ties, so that a hot (key, order) is spread as well
    tie = F.xxhash64(*[F.col(c) for c in df.columns])
    ranged = materialize(
        df.withColumn("__tie", tie).repartitionByRange(n, key, *order, "__tie").withColumn("__part", F.spark_partition_id()), "ranges")
    amount = F.sum(value) if value else F.lit(0).cast("bigint")
    offsets = ranged.groupBy(key, "__part").agg(F.count(F.lit(1)).alias("__n"), amount.alias("__s"))
    earlier = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select(
        F.col(key).alias("__key"), F.col("__part").alias("__p"),
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__n0"),
        F.coalesce(F.sum("__s").over(earlier), F.lit(0)).alias("__s0"))
    own = Window.partitionBy(key, "__part").orderBy(*order, "__tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = ranged.withColumn("__r", F.row_number().over(own))
    if value:
        out = out.withColumn("__v", F.sum(value).over(own) - F.col(value))
    out = out.join(offsets, (F.col("__part") == F.col("__p")) & F.col(key).eqNullSafe(F.col("__key")), "left")
    out = out.withColumn(rank_name, F.col("__r") - 1 + F.col("__n0"))
    if value:
        out = out.withColumn(sum_name, F.col("__v") + F.col("__s0"))
    return out.drop("__r", "__v", "__part", "__p", "__key", "__n0", "__s0", "__tie")


def is_whole(column: Column) -> Column:
    """True where a text column is neither null nor empty."""
    return column.isNotNull() & (F.length(column) > 0)
