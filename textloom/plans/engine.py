"""The façade: ingest documents, code or repositories; retrieve, ask, save, load."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import chunking, dense, fusion, index, lexical, multihop, reduce, retrieve, verify
from textloom.operators.storage import materialize
from textloom.sources import files

DOCUMENT = files.DOCUMENT


def _backends() -> dict[str, Callable]:
    """name -> search(index, questions, k, **options)."""
    return {
        "bm25": lambda x, q, k, **o: lexical.search(x, q, k, lexical.BM25),
        "sqlite_fts": lambda x, q, k, **o: lexical.search(x, q, k, lexical.FTS),
        "hash_dense": lambda x, q, k, **o: dense.hash_search(x.chunks, q, k),
        "dense": lambda x, q, k, **o: _dense(x, q, k, o.get("encoder") or dense.HashEncoder()),
        "hybrid": lambda x, q, k, **o: fusion.hybrid(x, q, k, o.get("encoder")),
        "iterative": lambda x, q, k, **o: multihop.iterative(x, q, k),
        "multiquery": lambda x, q, k, **o: fusion.multiquery(x, q, k, o.get("probes")),
    }


def _dense(x: index.Index, q: DataFrame, k: int, encoder: Callable) -> DataFrame:
    ask = dense.encode(q, "qid", "question", encoder, is_query=True).withColumnRenamed("vec", "qvec")
    return dense.vector_search(dense.encode(x.chunks, "cid", "text", encoder), ask, k)


BACKENDS = tuple(_backends())


def make_backend(name: str) -> Callable:
    try:
        return _backends()[name]
    except KeyError:
        raise ValueError(f"unknown backend {name!r}; there are {', '.join(BACKENDS)}") from None


@dataclass
class Engine:
    """One corpus. Everything ingested is a table; a question is a row, and the calls for one
    question are wrappers of those for many."""

    spark: SparkSession
    backend: str = "sqlite_fts"
    reader: Callable[[str, list[tuple]], str] | None = None
    k: int = 5
    encoder: Callable | None = None
    rewriter: Callable[[str, int], list[str]] | None = None
    expand: int = 0
    rerank: bool = False
    max_words: int = chunking.MAX_WORDS
    overlap: int = chunking.OVERLAP
    verified_scorer: Callable[[str, str], int] | None = None
    verified_on: bool = True
    enabled: bool = True
    index: index.Index | None = None
    repos: list[str] = field(default_factory=list)
    documents: DataFrame | None = None
    last_queries: DataFrame | None = None

    def _add(self, docs: DataFrame) -> int:
        """Number, chunk, index; returns the number of new chunks."""
        first, seq = 0, 0
        if self.index is not None:
            row = self.index.chunks.agg(F.max("cid"), F.max("doc_seq")).first()
            first, seq = (row[0] if row[0] is not None else -1) + 1, (row[1] if row[1] is not None else -1) + 1
        docs = materialize(docs.withColumn("doc_seq", F.col("doc_seq") + seq), "documents")
        new = materialize(chunking.chunk(docs, self.max_words, self.overlap, first_cid=first), "chunks")
        self.documents = docs if self.documents is None else self.documents.unionByName(docs)
        self.index = index.build(new) if self.index is None else index.append(self.index, new)
        if self.verified_scorer:
            scores = _scored(docs, self.verified_scorer)
            self.index.verified = scores if self.index.verified is None else self.index.verified.unionByName(scores)
        return new.count()

    def ingest(self, docs, title: str | None = None) -> int:
        """A text, a list of texts or (title, text) pairs, or a DataFrame (doc_seq, title, text, kind, repo)."""
        if isinstance(docs, DataFrame):
            return self._add(docs)
        docs = [(title, docs)] if isinstance(docs, str) else docs
        rows = [(i, *((None, d) if isinstance(d, str) else d), "prose", None) for i, d in enumerate(docs)]
        return self._add(self.spark.createDataFrame(rows, DOCUMENT))

    def ingest_code(self, text: str, title: str | None = None) -> int:
        return self._add(self.spark.createDataFrame([(0, title, text, "code", None)], DOCUMENT))

    def ingest_repo(self, root: str, label: str | None = None) -> int:
        label = label or root.rstrip("/").rsplit("/", 1)[-1]
        self.repos.append(label)
        return self._add(files.read_documents(self.spark, root, label))

    def questions(self, ask: list[str]) -> DataFrame:
        return self.spark.createDataFrame(list(enumerate(ask)), "qid bigint, question string")

    def search_many(self, questions: DataFrame, k: int) -> DataFrame:
        """(qid, cid, score, rank) of the backend, with probes and reranking where they are on."""
        if self.index is None or not self.enabled:
            return self.spark.createDataFrame([], "qid bigint, cid bigint, score double, rank int")
        options = {"encoder": self.encoder}
        if self.expand or self.backend == "multiquery":
            probes = self._rewritten(questions)
            self.last_queries = fusion.probes(questions, probes)
            flavour = lexical.FTS if self.backend == "sqlite_fts" else lexical.BM25
            hits = fusion.multiquery(self.index, questions, k, probes, flavour)
        else:
            self.last_queries = fusion.probes(questions).filter("qi = 0")
            hits = make_backend(self.backend)(self.index, questions, k, **options)
        if self.rerank:
            hits = fusion.dense_rerank(self.index, questions, hits, self.encoder or dense.HashEncoder())
        return hits

    def _rewritten(self, questions: DataFrame) -> DataFrame | None:
        """(qid, n, probe) of the rewriter; one that fails adds none. Questions of a batch are few."""
        if self.rewriter is None:
            return None
        rows = []
        for r in questions.select("qid", "question").collect():
            try:
                rows += [(r["qid"], n, p.strip()) for n, p in enumerate(self.rewriter(r["question"], self.expand or 3)) if p and p.strip()]
            except Exception:  # probes are extra
                continue
        return self.spark.createDataFrame(rows, "qid bigint, n int, probe string")

    def retrieve_many(self, questions: DataFrame, k: int | None = None, scope_col: str | None = None) -> DataFrame:
        """(qid, rank, cid, cids, text, score, source) of all questions (qid, question)."""
        k = k or self.k
        repos = self.spark.createDataFrame([(r,) for r in self.repos], "repo string") if self.repos else None
        x = self.index if self.verified_on else replace(self.index, verified=None)
        return retrieve.retrieve(x, questions, self.search_many, k, repos, scope_col)

    def retrieve(self, question: str, k: int | None = None, scope: str | None = None) -> list[tuple[int, str, float]]:
        """(cid, text, score), best first."""
        if self.index is None or not self.enabled:
            return []
        q = self.questions([question]).withColumn("scope", F.lit(scope).cast("string"))
        return [(r.cid, r.text, r.score) for r in self.retrieve_many(q, k, "scope").orderBy("rank").collect()]

    def ask_many(self, questions: DataFrame, k: int | None = None, budget: int | None = None) -> DataFrame:
        """(qid, answer): the reader's answer, over batches of ``budget`` characters, or the context."""
        hits = materialize(self.retrieve_many(questions, k), "hits")
        if self.reader is None:
            return retrieve.context_block(hits, "\n\n").withColumnRenamed("context", "answer")
        label = F.when(F.col("source").isNotNull(), F.concat(F.lit("["), F.col("source"), F.lit("] "), F.col("text"))).otherwise(F.col("text"))
        return reduce.answer(hits.withColumn("text", label), questions, self.reader, budget or (1 << 30))

    def ask(self, question: str, k: int | None = None, budget: int | None = None) -> str:
        row = self.ask_many(self.questions([question]), k, budget).first()
        return row["answer"] if row else ""

    def get(self, cid: int) -> str | None:
        return self.index.get(cid) if self.index else None

    def source_of(self, cid: int) -> str | None:
        return self.index.source_of(cid) if self.index else None

    def reset(self) -> None:
        self.index, self.documents, self.repos = None, None, []

    def save(self, path: str) -> str:
        """A new version below ``path``; verified scores and repositories are kept as well."""
        self.index.meta = {"repos": self.repos, "backend": self.backend}
        return index.save(self.index, path)

    def load(self, path: str, version: str | None = None) -> "Engine":
        """Swap in a saved version."""
        new = index.load(self.spark, path, version)
        self.index, self.repos, self.backend = new, list(new.meta.get("repos", [])), new.meta.get("backend", self.backend)
        return self

    def reindex(self, root: str, path: str, label: str = "drop") -> str:
        """Build a folder anew, save it, and only then swap it in."""
        fresh = Engine(self.spark, self.backend, max_words=self.max_words, overlap=self.overlap, verified_scorer=self.verified_scorer)
        fresh.ingest_repo(root, label)
        version = fresh.save(path)
        self.load(path, version)
        return version

    # ---- tools

    def search(self, query: str, k: int = 5) -> list[dict]:
        return [{"id": c, "text": t, "score": round(s, 4), "source": self.source_of(c)} for c, t, s in self.retrieve(query, k)]

    def read_source(self, title: str, window: int = 120, around: str = "") -> str:
        rows = files.read_around(self.documents, title, window, around).orderBy("line").collect()
        return "\n".join(r.text for r in rows)

    def list_symbols(self, symbol_table: DataFrame, module: str = "") -> DataFrame:
        return verify.symbol_map(symbol_table.filter(F.col("module").startswith(module)))

    def verify_code(self, code: str, symbol_table: DataFrame, package: str) -> list[str]:
        answers = self.spark.createDataFrame([(0, code)], "qid bigint, code string")
        found = verify.check_imports(answers, symbol_table, package).unionByName(verify.undefined_names(answers))
        return sorted(r.problem for r in found.collect())

    def grounded_answer(self, question: str, k: int | None = None, budget: int = 5000) -> dict:
        """An answer with its checks: with the reader's budget halved on capacity errors, and with
        twice the hits where it says that it knows too little."""
        k = k or self.k

        def read(n_chars: int, n_hits: int) -> tuple[str, str]:
            hits = self.retrieve(question, n_hits) if n_hits else []
            used, kept = 0, []
            for h in hits:
                if kept and used + len(h[1]) > n_chars:
                    break
                kept.append(h)
                used += len(h[1])
            return self.reader(question, kept), "\n".join(t for _, t, _ in kept)

        (reply, context), budget, hits = reduce.resilient(read, budget, k)
        if re.search(T.INTENTS["insufficient"], reply or "", re.I) and hits:
            reply, context = read(budget, 2 * k)
        g = self.spark.createDataFrame([(reply or "", context)], "a string, c string").select(T.groundedness(F.col("a"), F.col("c")).alias("g")).first()["g"]
        return {"answer": reply, "groundedness": g["score"], "flagged": list(g["flagged"]), "hits": hits, "budget": budget}


def _scored(docs: DataFrame, scorer: Callable[[str, str], int]) -> DataFrame:
    """(source, score) by an injected scorer; what it fails on counts as running."""
    import pandas as pd

    def one(title, text):
        try:
            return int(scorer(title, text))
        except Exception:
            return 2

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"source": b["title"], "score": [one(t, x) for t, x in zip(b["title"], b["text"])]})

    return docs.filter("title IS NOT NULL").select("title", "text").mapInPandas(run, "source string, score int")
