"""Quality classifier by supervised subword embeddings (operator 10).

A text is the mean of the learned vectors of its words, a word (a run of letters and digits, or of
other visible characters) the mean of the hashed vectors of itself and its character n-grams; a word that repeats the one before
it stands for a mark of repetition. Two softmax outputs say whether the text is good and whether
it is toxic. numpy stochastic gradient descent (with AdaGrad steps) trains the vectors on labelled
documents. As the outputs are linear in the mean, scoring needs one number for each bucket and
output: tasks get a table of a fixed size, not the vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import buffers, mix, slices, words

BUCKETS, DIM, GRAMS = 1 << 17, 8, (3, 4)
EPOCHS, BATCH, RATE, SEED = 8, 64, 0.1, 7
#: Factor on the mean, so that single words among hundreds get steps that count.
GAIN = 30.0
#: Most labelled rows that training takes: those with the smallest hashes of their ids.
MAX_LABELLED = 6_000
HEADS = ("quality", "toxic")


def subwords(raw: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words at start:end (of hash h) and of their character n-grams, ASCII case
    folded and with marks at both ends, word by word; and where each word's begin."""
    n = len(start)
    size = end - start
    room = int(size.sum()) + 2 * n
    first = np.concatenate([[0], np.cumsum(size + 2)])[:-1]
    text = np.full(room, 1, np.uint64)  # the mark
    owner = np.repeat(np.arange(n), size + 2)
    inner = np.arange(room) - first[owner] - 1
    mid = (inner >= 0) & (inner < size[owner])
    b = raw[(start[owner] + inner)[mid]]
    text[mid] = (b + np.where((b >= 65) & (b < 91), 32, 0)).astype(np.uint64) + np.uint64(2)
    out, own = [(mix(h) & np.uint64(BUCKETS - 1)).astype(np.int64)], [np.arange(n)]
    for g in GRAMS:
        if room < g:
            continue
        v = np.zeros(room - g + 1, np.uint64)
        for k in range(g):
            v = v * np.uint64(0x100000001B3) + text[k : k + len(v)]
        ok = owner[: len(v)] == owner[g - 1 :]
        out.append((mix(v[ok] + np.uint64(g << 56)) & np.uint64(BUCKETS - 1)).astype(np.int64))
        own.append(owner[: len(v)][ok])
    bucket, word = np.concatenate(out), np.concatenate(own)
    order = np.argsort(word, kind="stable")
    return bucket[order], np.searchsorted(word[order], np.arange(n))


class Corpus(NamedTuple):
    """Distinct words with their buckets, and each text's words."""

    buckets: np.ndarray  # of all words, one after another
    begin: np.ndarray    # each word's first
    row: np.ndarray      # text of each (text, word)
    word: np.ndarray     # word of each
    weight: np.ndarray   # share of the word in the text
    n: int


def corpus(raw: np.ndarray, offsets: np.ndarray, hashes: bool = False):
    """The Corpus of the texts at ``offsets`` and, where asked for, the hashes of its words."""
    start, end, row, h = words(raw, offsets, visible=True)
    n = len(offsets) - 1
    again = np.r_[False, (h[1:] == h[:-1]) & (row[1:] == row[:-1])]
    h = np.where(again, np.uint64(0), h)
    end = np.where(again, start, end)  # no n-grams but that of the two marks
    _, first, word = np.unique(h, return_index=True, return_inverse=True)
    buckets, begin = subwords(raw, start[first], end[first], h[first])
    key, count = np.unique(row * max(len(first), 1) + word, return_counts=True)
    row, word = key // max(len(first), 1), key % max(len(first), 1)
    total = np.bincount(row, weights=count, minlength=n)
    out = Corpus(buckets, begin, row, word, count / np.maximum(total[row], 1), n)
    return (out, h[first]) if hashes else out


def training_corpus(raw: np.ndarray, offsets: np.ndarray) -> Corpus:
    """``corpus`` of many texts, made slice by slice, so that memory doesn't follow their bytes."""
    keys, sizes, buckets, rows, ids, weights = [], [], [], [], [], []
    for a, b in slices(offsets):
        c, h = corpus(raw, offsets[a : b + 1], hashes=True)
        keys.append(h)
        sizes.append(np.diff(np.append(c.begin, len(c.buckets))).astype(np.int32))
        buckets.append(c.buckets.astype(np.int32))
        rows.append((c.row + a).astype(np.int32))
        ids.append(h[c.word])
        weights.append(c.weight.astype(np.float32))
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    key, size, flat = join(keys, np.uint64), join(sizes, np.int32), join(buckets, np.int32)
    start = np.cumsum(size, dtype=np.int64) - size
    word, first = np.unique(key, return_index=True)
    span = size[first].astype(np.int64)
    begin = np.cumsum(span) - span
    flat = flat[np.arange(span.sum(), dtype=np.int32) + np.repeat((start[first] - begin).astype(np.int32), span)]
    return Corpus(flat, begin, join(rows, np.int32), np.searchsorted(word, join(ids, np.uint64)).astype(np.int32), join(weights, np.float32), len(offsets) - 1)


def _means(table: np.ndarray, buckets: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Each word's mean over its buckets."""
    if not len(begin):
        return np.zeros((0, table.shape[1]))
    size = np.diff(np.append(begin, len(buckets)))
    return np.add.reduceat(table[buckets], begin, axis=0) / size[:, None]


class Model(NamedTuple):
    table: np.ndarray  # BUCKETS x heads: each bucket's share of the log odds
    bias: np.ndarray


def train(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """``labels``: texts x heads of 0, 1, or -1 for unknown."""
    arr = pa.array(texts, pa.string())
    offsets, raw = buffers(arr)
    c = training_corpus(raw, offsets)
    rng = np.random.default_rng(seed)
    heads = labels.shape[1]
    vec = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out = np.zeros((DIM, 2 * heads), np.float32)
    bias = np.zeros(2 * heads, np.float32)
    sv, so, sb = np.full(BUCKETS, 1e-8, np.float32), np.full_like(out, 1e-8), np.full_like(bias, 1e-8)
    out += rng.uniform(-0.5, 0.5, out.shape).astype(np.float32)
    text_begin = np.searchsorted(c.row, np.arange(c.n + 1))
    size = np.diff(np.append(c.begin, len(c.buckets)))
    known = np.repeat(labels >= 0, 2, axis=1)
    target = np.zeros((c.n, 2 * heads), np.float32)
    for k in range(heads):
        for v in (0, 1):
            target[:, 2 * k + v] = labels[:, k] == v
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(c.n), max(1, c.n // BATCH)):
            parts = [np.arange(text_begin[t], text_begin[t + 1]) for t in at]
            sel = np.concatenate(parts) if len(parts) else np.zeros(0, np.int64)
            if not len(sel):
                continue
            doc = np.repeat(np.arange(len(at)), [len(p) for p in parts])
            uw, inv = np.unique(c.word[sel], return_inverse=True)
            span = size[uw]
            own = np.repeat(np.arange(len(uw)), span)
            flat = np.arange(span.sum()) - np.repeat(np.cumsum(span) - span, span) + np.repeat(c.begin[uw], span)
            bk = c.buckets[flat]
            wv = np.add.reduceat(vec[bk], np.cumsum(span) - span, axis=0) / span[:, None]
            share = c.weight[sel][:, None] * np.float32(GAIN)
            hid = np.zeros((len(at), DIM), np.float32)
            there = np.flatnonzero(np.diff(doc, prepend=-1))
            hid[doc[there]] = np.add.reduceat(wv[inv] * share, there, axis=0)
            score = hid @ out + bias
            e = np.exp(score - score.reshape(len(at), heads, 2).max(2).repeat(2, axis=1))
            prob = e / e.reshape(len(at), heads, 2).sum(2).repeat(2, axis=1)
            err = np.where(known[at], prob - target[at], 0) / len(at)
            g_out, g_bias, g_hid = hid.T @ err, err.sum(0), err @ out.T
            g_pair = g_hid[doc] * share
            g_word = np.stack([np.bincount(inv, g_pair[:, d], len(uw)) for d in range(DIM)], 1).astype(np.float32) / span[:, None]
            order = np.argsort(bk.astype(np.int32), kind="stable")
            there = np.flatnonzero(np.diff(bk[order], prepend=-1))
            ub = bk[order[there]]
            g_vec = np.add.reduceat(g_word[own[order]], there, axis=0)
            so += g_out**2
            sb += g_bias**2
            sv[ub] += (g_vec**2).mean(1)
            out -= RATE * g_out / np.sqrt(so)
            bias -= RATE * g_bias / np.sqrt(sb)
            vec[ub] -= RATE * g_vec / np.sqrt(sv[ub])[:, None]
    diff = out[:, 1::2] - out[:, ::2]
    return Model((vec @ diff * np.float32(GAIN)).astype(np.float32), (bias[1::2] - bias[::2]).astype(np.float64))


def scores(model: Model, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Probabilities (texts x heads)."""
    c = corpus(raw, offsets)
    word = _means(model.table, c.buckets, c.begin)
    odds = np.empty((c.n, len(model.bias)))
    for k in range(len(model.bias)):
        odds[:, k] = np.bincount(c.row, weights=c.weight * word[c.word, k], minlength=c.n) + model.bias[k]
    return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_LABELLED) -> tuple[list[str], np.ndarray]:
    """Texts and labels of at most ``most`` labelled documents. Labels of one document that
    differ count as unknown (-1), as null ones do."""
    one = lambda h: F.when(F.min(h) == F.max(h), F.max(h)).otherwise(-1).cast("int").alias(h)
    chosen = (labels.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(*[one(h) for h in HEADS])
              .orderBy(F.xxhash64(id_col), id_col).limit(most))
    rows = docs.select(id_col, text_col).filter(F.length(text_col) > 0).join(F.broadcast(chosen), id_col)
    t = rows.select(F.col(text_col).alias("text"), *HEADS, F.xxhash64(id_col, text_col).alias("k")).toArrow().sort_by("k")
    return t["text"].to_pylist(), np.stack([np.asarray(t[h]) for h in HEADS], 1) if t.num_rows else np.zeros((0, len(HEADS)), int)


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, quality, toxic): probabilities of every row. A null or wordless text has null ones."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # BUCKETS * heads numbers, whatever the data
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, raw = buffers(batch.column(1))
            for a, b in slices(offsets):
                p = scores(shared.value, raw, offsets[a : b + 1])
                has = np.bincount(words(raw, offsets[a : b + 1], True)[2], minlength=b - a) > 0
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *[pa.array(p[:, k], mask=~has) for k in range(p.shape[1])]], ["id", *HEADS])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = docs.select(F.col(id_col).alias("id"), text.alias("text")).mapInArrow(run, f"id {kind}, quality double, toxic double")
    return out.withColumnRenamed("id", id_col)


def op10_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps (good and not toxic), with both probabilities."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(*labelled(docs, labels))
    return classify(docs, model).filter("quality >= 0.5 AND toxic < 0.5")


QUERIES = {"op10_quality_classifier": op10_quality_classifier}
SQL: dict[str, str] = {}
