"""Edit-aware token counts (operator 1).

A document's pre-tokens are grouped into leaves of some ``LEAF`` words; a segment tree holds
the token counts of the leaves and their sums. An edit is encoded again only from the last
leaf boundary that it can't reach to the first old boundary behind it that is a pre-token
boundary of the new text too; the other leaves keep their counts, and only the sums above the
changed leaves are added up again. This is exact for byte-level BPE: a merge never crosses a
pre-token, and where a pre-token starts decides all that follow.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern of the vocabulary's pre-tokens, as published with it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF = 32
#: How far behind its end a pre-token's match may look: the character that ends a run of
#: white space and the one before it.
LOOKAHEAD = 2
CACHE = 1 << 18
#: A count that says: this word can't be counted alone.
_UNSURE = 1 << 40


class _Counts(dict):
    """Pre-token -> number of tokens; starts afresh when it has CACHE entries."""

    def __init__(self, encoding):
        super().__init__()
        self.encode = encoding.encode_ordinary

    def __missing__(self, piece: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        n = self[piece] = len(self.encode(piece))
        return n


class _Words(_Counts):
    """Word -> number of tokens of a space and the word.

    Before a space between two other characters a pre-token always ends, so a text can be
    split at its spaces and each part counted alone. Where a word is empty or has white space at
    either end the space may belong to a longer run, hence _UNSURE.
    """

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        n = self[word] = _UNSURE if not word or word[0].isspace() or word[-1].isspace() else len(self.encode(" " + word))
        return n


class Tokenizer:
    """Counts tokens through dictionaries of the pre-tokens and words seen so far."""

    def __init__(self, vocabulary: str = VOCABULARY):
        import regex
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = regex.compile(PATTERN).findall
        self.counts = _Counts(self.encoding)
        self.words = _Words(self.encoding)

    def parts(self, text: str) -> tuple[list[str], list[int]]:
        """Parts that pre-tokens don't cross, and their tokens: what a space ends or, where
        white space makes that unsure, the pre-tokens."""
        split = text.split(" ")
        n = list(map(self.words.__getitem__, split))
        n[0] = self.slow(split[0])
        if len(split) > 1 and split[-1] and not split[-1][0].isspace():
            n[-1] = self.slow(" " + split[-1])
        if not split[0] or split[0][-1].isspace() or sum(n) >= _UNSURE:
            pieces = self.pieces(text)
            return pieces, list(map(self.counts.__getitem__, pieces))
        return split, n

    def slow(self, text: str) -> int:
        return sum(map(self.counts.__getitem__, self.pieces(text)))

    def count(self, text: str) -> int:
        return sum(self.parts(text)[1])


@lru_cache(maxsize=4)
def tokenizer(vocabulary: str = VOCABULARY) -> Tokenizer:
    """One tokenizer for each Python worker and vocabulary."""
    return Tokenizer(vocabulary)


def tree_of(leaves: list[int]) -> list[int]:
    """An implicit binary tree: the root at 1, the leaves at size..; 0 where there is none."""
    size = 1
    while size < len(leaves):
        size *= 2
    tree = [0] * size + leaves + [0] * (size - len(leaves))
    for i in range(size - 1, 0, -1):
        tree[i] = tree[2 * i] + tree[2 * i + 1]
    return tree


class SegmentTree:
    """Leaves (characters and tokens of each) of one text, with the sums of the tokens."""

    def __init__(self, tok: Tokenizer, text: str):
        self.tok, self.text = tok, text
        parts, counts = tok.parts(text)
        at = np.arange(0, len(counts), LEAF)
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        if parts and parts[0] != text and sum(map(len, parts)) != len(text):
            size[1:] += 1  # the spaces that were split at
        self.ends = np.cumsum(np.add.reduceat(size, at)).tolist() if text else []
        tokens = np.add.reduceat(np.array(counts), at).tolist() if text else []
        self.tree = tree_of(tokens)
        self.n = len(tokens)
        self.encoded = 0

    @classmethod
    def restore(cls, tok: Tokenizer, text: str, chars: list[int], tokens: list[int]) -> SegmentTree:
        """The tree of stored leaves, without encoding the text."""
        tree = cls.__new__(cls)
        tree.tok, tree.text, tree.n, tree.encoded = tok, text, len(tokens), 0
        tree.ends, tree.tree = np.cumsum(np.array(chars, np.int64)).tolist(), tree_of(list(tokens))
        return tree

    @property
    def total(self) -> int:
        return self.tree[1]

    @property
    def tokens(self) -> list[int]:
        size = len(self.tree) // 2
        return self.tree[size : size + self.n]

    def edit(self, start: int, end: int, put: str) -> None:
        """Replace text[start:end] by ``put``."""
        text = self.text[:start] + put + self.text[end:]
        shift = len(put) - (end - start)
        first = bisect_right(self.ends, start - LOOKAHEAD)  # leaves before it can't change
        at = self.ends[first - 1] if first else 0
        # Old boundaries are tried from the first one at or behind the edit's end.
        last = bisect_left(self.ends, end)
        ends, tokens, run, n, k = [], [], [], 0, self.tok.counts.__getitem__
        met = len(self.ends)
        goal = last
        for piece in self._scan(text, at):
            run.append(piece)
            n += len(piece)
            here = at + n
            while goal < len(self.ends) and self.ends[goal] + shift < here:
                goal += 1
            hit = goal < len(self.ends) and self.ends[goal] + shift == here and here >= start + len(put)
            if hit or len(run) == LEAF:
                ends.append(here)
                tokens.append(sum(map(k, run)))
                run = []
            if hit:
                met = goal + 1
                break
        if run:
            ends.append(at + n)
            tokens.append(sum(map(k, run)))
        self.encoded += n
        old = self.tokens
        self.text = text
        self.ends = self.ends[:first] + ends + [e + shift for e in self.ends[met:]]
        if len(tokens) == met - first:  # the same number of leaves: only the sums above them change
            size = len(self.tree) // 2
            for i, t in enumerate(tokens):
                j = size + first + i
                delta = t - self.tree[j]
                while delta and j:
                    self.tree[j] += delta
                    j //= 2
        else:
            leaves = old[:first] + tokens + old[met:]
            self.n = len(leaves)
            self.tree = tree_of(leaves)

    def _scan(self, text: str, at: int) -> Iterator[str]:
        for m in self.tok.pieces.__self__.finditer(text, at):
            yield m.group()


_MAIL = re.compile(r"[\w.+-]{1,64}@[\w-]{1,64}(?:\.[\w-]{1,64})+")
_NUMBER = re.compile(r"[0-9]{13,}")


def redactions(text: str) -> list[tuple[int, int, str]]:
    """Edits that take out mail addresses and card-like numbers: (start, end, replacement). A card has 13 to 16
    digits, so longer runs of digits aren't one; parts of an address have up to 64 characters, as the mail standard says."""
    found = [(*m.span(), "<mail>") for m in _MAIL.finditer(text)] if "@" in text else []
    return apart(found + [(*m.span(), "<number>") for m in _NUMBER.finditer(text) if len(m.group()) <= 16])


def apart(edits: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """In order, without those that begin before an earlier one ends."""
    out, reach = [], 0
    for a, b, put in sorted(edits):
        if a >= reach:
            reach = max(a, b)
            out.append((a, reach, put))
    return out


SCHEMA = "n_tokens bigint, n_edits int, n_tokens_after bigint, n_encoded bigint, leaf_chars array<int>, leaf_tokens array<int>"
OUT = tuple(x.split()[0] for x in SCHEMA.split(", "))


def edit_counts(docs: DataFrame, edits: str | Callable[[str], list] = redactions, id_col: str = "doc_id",
                text_col: str = "text", vocabulary: str = VOCABULARY, leaves: tuple[str, str] | None = None) -> DataFrame:
    """(id, n_tokens, n_edits, n_tokens_after, n_encoded, leaf_chars, leaf_tokens) of every row.

    ``edits`` is a function of the text or the name of a column of structs (start, end, put),
    character positions in the given text; they are applied from the last to the first. Of edits that overlap, the one
    that begins first counts, and the others are left out; so are null edits and those with a null position. ``leaves`` names
    columns of the leaves (characters, tokens) that an earlier call returned for this very text, which then isn't
    encoded again; rows where they are null are encoded. ``n_encoded`` is the number of characters encoded again for them; the leaves
    are those of the edited text, so that later edits can go on from them. A null text has null
    counts and no edits; an empty one has 0 tokens and no leaf. Positions outside the text are
    cut to it, a null ``put`` deletes. Repeated rows are counted each for itself. An empty table has no rows; other
    columns are dropped; an id column named like one of the output isn't possible (ValueError). Texts of any length are whole.
    """
    if id_col in OUT:
        raise ValueError(f"the id column can't be called {id_col}")
    kind = docs.schema[id_col].dataType.simpleString()
    cols = [F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")]
    if isinstance(edits, str):
        cols.append(F.col(edits).alias("edits"))
    if leaves:
        cols += [F.col(leaves[0]).cast("array<int>").alias("chars"), F.col(leaves[1]).cast("array<int>").alias("tokens")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(vocabulary)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                given = part.column(2).to_pylist() if isinstance(edits, str) else None
                stored = list(zip(*(part.column(part.num_columns - k).to_pylist() for k in (2, 1)))) if leaves else None
                rows: list[list] = [[] for _ in OUT]
                for i, text in enumerate(part.column(1).to_pylist()):
                    if text is None:
                        values = (None, 0, None, 0, None, None)
                    else:
                        known = stored is not None and None not in stored[i]
                        tree = SegmentTree.restore(tok, text, *stored[i]) if known else SegmentTree(tok, text)
                        before = tree.total
                        if given is None:
                            todo = edits(text)
                        else:
                            todo = [(min(max(e["start"], 0), len(text)), min(max(e["end"], 0), len(text)), e["put"] or "")
                                    for e in given[i] or [] if e is not None and e["start"] is not None and e["end"] is not None]
                        todo = apart(todo)
                        for s, e, put in reversed(todo):
                            tree.edit(s, e, put)
                        values = (before, len(todo), tree.total, tree.encoded, np.diff(tree.ends, prepend=0).astype(np.int32), tree.tokens)
                    for r, v in zip(rows, values):
                        r.append(v)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(r, k) for r, k in zip(rows, kinds)]], ["id", *OUT])

    out = docs.select(*cols).mapInArrow(run, f"id {kind}, {SCHEMA}")
    return out.withColumnRenamed("id", id_col)


def token_counts(docs: DataFrame, text_col: str = "text", count_col: str = "n_tokens", vocabulary: str = VOCABULARY,
                 keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` and the number of tokens; null for a null text, 0 for an empty one."""
    keep = keep or []
    inner = docs.select(*[F.col(c) for c in keep], F.col(text_col).cast("string").alias("__text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(vocabulary)
        for batch in batches:
            n = []
            for a in range(0, batch.num_rows, 500):
                n += [None if t is None else tok.count(t) for t in batch.column(batch.num_columns - 1).slice(a, 500).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], [*batch.schema.names[:-1], count_col])

    return inner.mapInArrow(run, ", ".join([*fields, f"`{count_col}` bigint"]))


def op1_edit_token_counts(spark, sf_dir: str) -> DataFrame:
    """Token counts of all documents, before and after personal data is taken out."""
    return edit_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op1_edit_token_counts": op1_edit_token_counts}
SQL: dict[str, str] = {}
