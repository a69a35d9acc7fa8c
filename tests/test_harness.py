import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

from pyspark.sql import functions as F

from textloom.operators import chunking, index, lexical
from textloom.plans import harness, models


def test_sweep_and_report(spark):
    searches = {"bm25": lambda x, q: lexical.search(x, q, 5), "fts": lambda x, q: lexical.search(x, q, 5, lexical.FTS)}
    rows = harness.sweep(spark, ["single"], [1500], searches, n_distractors=5)
    assert {r["condition"]: r["recall"] for r in rows.collect()} == {"bm25": 1.0, "fts": 1.0}
    text = harness.report(rows)
    assert "100%" in text and "0.50 OK" in text


def test_naive_system(spark):
    docs, q = harness.haystack(spark, "single", 1500)
    c = chunking.chunk(docs, max_words=40)
    a = harness.naive_answers(c, q)
    got = harness.recall(c.crossJoin(q.select("qid")).select("qid", "text"), q, a).first()
    assert got["recall"] == 1.0 and got["answer_recall"] > 0.5


def test_metrics(spark):
    items = spark.createDataFrame([(0, "a", ["24601"], "zz"), (1, "b", ["none"], "an anchor"), (2, "b", ["x9"], "yy")], "qid bigint, scope string, gold array<string>, anchor string")
    hits = spark.createDataFrame([(0, 0, "value 24,601", "a/x"), (1, 0, "nothing", "a/y"), (1, 1, "has An Anchor here", "b/z")], "qid bigint, rank int, text string, source string")
    got = {r.scope: (r["items"], r.hit, r.top1_in_scope) for r in harness.retrieval_metrics(hits, items).collect()}
    assert got == {"a": (1, 1, 1), "b": (2, 1, 0), None: (3, 2, 1)}
    x = index.build(spark.createDataFrame([(0, "the corpus text")], "cid bigint, text string"))
    stale = harness.stale_anchors(spark.createDataFrame([(0, "corpus"), (1, "gone")], "qid bigint, anchor string"), x.chunks)
    assert [r.qid for r in stale.collect()] == [1]
    cost = harness.memory_cost(spark, [1000, 2000]).orderBy("context").collect()
    assert abs(cost[1].kv_gb - 2 * cost[0].kv_gb) < 1e-9
    facts = spark.createDataFrame([(0, "time", "met Ada in Paris"), (0, "place", "unknown thing entirely")], "qid bigint, ability string, fact string")
    r = {x.ability: x.recall for x in harness.rubric_recall(facts, spark.createDataFrame([(0, "She met Ada in Paris.")], "qid bigint, text string")).collect()}
    assert r == {"time": 1.0, "place": 0.0, None: 0.5}


class Fake(BaseHTTPRequestHandler):
    def do_POST(self):
        size = self.headers.get("content-length")
        body = json.loads(self.rfile.read(int(size)))
        if "messages" in body:
            out = {"choices": [{"message": {"content": "1. first\n- second\nCORRECT"}}]}
        else:
            out = {"data": [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in reversed(list(enumerate(body["input"])))]}
        self.send_response(200)
        self.end_headers()
        json.dump(out, wrapper := __import__("io").TextIOWrapper(self.wfile, write_through=True))
        wrapper.detach()

    def log_message(self, *a):
        pass


def test_http_models():
    server = HTTPServer(("127.0.0.1", 0), Fake)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    assert models.HttpEncoder(url, "m")(["ab", "abcd"]) == [[2.0, 1.0], [4.0, 1.0]]
    reader = models.make_reader("m", url=url)
    assert models.Rewriter(reader)("q", 2) == ["first", "second"]
    assert models.judge(reader.complete, "q", "g", "a") and not models.judge(lambda p: "Incorrect", "q", "g", "a")
    server.shutdown()
