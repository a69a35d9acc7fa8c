"""Models behind HTTP, for the places where the library takes a callable. Nothing here is used
unless it is passed in; each object is picklable, so it runs in executors."""

from __future__ import annotations

import json
import re
import urllib.request
from dataclasses import dataclass

from textloom.functions import text as T
from textloom.operators import dense, reduce


def post(url: str, body: dict, key: str | None = None, timeout: float = 60.0) -> dict:
    head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
    request = urllib.request.Request(url, json.dumps(body).encode(), head)
    with urllib.request.urlopen(request, timeout=timeout) as r:
        return json.load(r)


@dataclass
class HttpEncoder:
    """Embeddings of an OpenAI-like (``style`` openai) or Ollama-like (ollama) endpoint; the latter is
    asked text by text where it doesn't take a batch."""

    url: str
    model: str
    key: str | None = None
    style: str = "openai"

    def __call__(self, texts: list[str], is_query: bool = False) -> list[list[float]]:
        ask, keep = T.embedding_prefixes(self.model)
        texts = [(ask if is_query else keep) + t for t in texts]
        ask_for = lambda path, **what: post(self.url + path, dict(what, model=self.model), self.key)
        if self.style == "openai":
            rows = {r["index"]: r["embedding"] for r in ask_for("/embeddings", input=texts)["data"]}
            return [rows[i] for i in sorted(rows)]
        try:
            return ask_for("/api/embed", input=texts)["embeddings"]
        except OSError:
            return [ask_for("/api/embeddings", prompt=t)["embedding"] for t in texts]


@dataclass
class HttpReader:
    """A chat completion that answers from the passages alone."""

    url: str
    model: str
    key: str | None = None
    context_chars: int | None = None
    system: str = "Answer from the passages only. If they don't say, answer: I don't know."

    def complete(self, prompt: str, system: str | None = None) -> str:
        said = [dict(role=r, content=c) for r, c in (("system", system), ("user", prompt)) if c]
        reply = post(self.url + "/chat/completions", dict(model=self.model, messages=said, temperature=0), self.key)
        return reply["choices"][0]["message"].get("content", "").strip()

    def __call__(self, question: str, passages: list[tuple]) -> str:
        return self.complete("\n\n".join([p[1] for p in passages] + [f"Question: {question}"]), self.system)


@dataclass
class Rewriter:
    """Search probes for a question, by a model."""

    reader: HttpReader

    def __call__(self, question: str, n: int) -> list[str]:
        reply = self.reader.complete(f"Write {n} short keyword searches for passages that answer this, one a line:\n{question}")
        lines = (re.sub(r"^[\-*\d.)\s]+", "", x.strip()).strip() for x in reply.split("\n"))
        return [x for x in lines if x and x.lower() != question.strip().lower()][:n]


def judge(complete, question: str, gold: str, answer: str) -> bool:
    """A model's verdict; "incorrect" is looked for first, as it contains the other word."""
    verdict = complete(f"Question: {question}\nExpected: {gold}\nAnswer: {answer}\nReply CORRECT or INCORRECT.").upper()
    return "INCORRECT" not in verdict and "CORRECT" in verdict


def make_encoder(name: str | None, **options):
    return dense.HashEncoder() if name in (None, "hash") else HttpEncoder(model=name, **options)


def make_reader(name: str, **options):
    """regex, or the model of an endpoint."""
    return reduce.regex_reader if name == "regex" else HttpReader(model=name, **options)
