"""Documents that have given phrases: phrases are sent to the tasks, a slice at a time, and looked up by the words
that they have, so that no word of a document leaves its row."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators.storage import materialize

#: Characters of the phrases of a slice.
SLICE = 4_000_000
_ALNUM = frozenset("0123456789abcdefghijklmnopqrstuvwxyz")


def as_words(text: str, phrase: str) -> bool:
    """Whether ``phrase`` is in ``text`` with no letter or digit next to it."""
    at = text.find(phrase)
    while at >= 0:
        end = at + len(phrase)
        if (at == 0 or text[at - 1] not in _ALNUM) and (end == len(text) or text[end] not in _ALNUM):
            return True
        at = text.find(phrase, at + 1)
    return False


def found(docs: DataFrame, phrases: DataFrame, words: bool) -> DataFrame:
    """(item_id, doc_id), distinct, of documents (doc_id, text) whose folded text has a phrase (item_id, phrase, lead);
    ``words``: as whole words. ``lead`` are up to three neighbouring words that a text with the phrase has; of a phrase
    without any all texts are searched."""
    kept = materialize(phrases.filter("phrase IS NOT NULL").select("item_id", "phrase", "lead"), "phrases")
    count = -(-(kept.agg(F.sum(F.length("phrase") + 1)).first()[0] or 0) // SLICE)
    parts = [_found(docs, kept if count == 1 else kept.filter(F.pmod(F.hash("phrase", "item_id"), F.lit(count)) == i), words) for i in range(max(1, count))]
    return reduce(DataFrame.unionByName, parts).distinct()


def _found(docs: DataFrame, phrases: DataFrame, words: bool) -> DataFrame:
    by: dict[int, dict[tuple, list]] = {0: {}, 1: {}, 2: {}, 3: {}}
    rows = phrases.collect()
    for i, (_, phrase, lead) in enumerate(rows):
        by[len(lead)].setdefault(tuple(lead), []).append((i, phrase))
    items = pa.array([r[0] for r in rows], pa.int64())
    leads = {k: frozenset(v) for k, v in by.items() if v and k}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, item = [], []
            for n, text in enumerate(b.column("text").to_pylist()):
                if text is None:
                    continue
                t = T.folded(text)
                w = T.split_words(t)
                tried = list(by[0].get((), ()))
                for k, have in leads.items():
                    for lead in have.intersection(zip(*(w[j:] for j in range(k)))):
                        tried += by[k][lead]
                hit = {i for i, p in tried if (as_words(t, p) if words else p in t)}
                row += [n] * len(hit)
                item += hit
            yield pa.RecordBatch.from_arrays([items.take(pa.array(item, pa.int64())), b.column("doc_id").take(pa.array(row, pa.int64()))], ["item_id", "doc_id"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"item_id bigint, doc_id {kind}")
