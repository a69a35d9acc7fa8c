import io
import zipfile

from pyspark.sql import functions as F

from textloom.operators import spans, verify
from textloom.sources import files


def src(spark, **texts):
    return spark.createDataFrame(list(texts.items()), "source string, text string")


def book():
    body = "Words of the story go on and on. " * 60
    toc = "\n".join(f"Chapter {i}" for i in (1, 2, 3))
    return toc + "\n\n" + "\n".join(f"CHAPTER {n}\nIt begins {k} here. {body}" for k, n in enumerate(("I", "II", "III"), 1))


def ask(spark, *q):
    return spark.createDataFrame(list(enumerate(q)), "qid bigint, question string")


def test_units_skip_tables_of_contents(spark):
    s = src(spark, whale=book(), notes="# One\n" + "x " * 900 + "\n# Two\n" + "y " * 900, plain="no structure at all")
    m = spans.markers(s)
    u = spans.units(m)
    assert {(r.source, r.type): r["n"] for r in u.groupBy("source", "type").agg(F.max("n").alias("n")).collect()} == {("whale", "chapter"): 3, ("notes", "heading"): 2}
    seg = {(r.source, r.label) for r in spans.coarse_segments(s, m).collect()}
    assert seg == {("whale", "chapter 1"), ("whale", "chapter 2"), ("whale", "chapter 3"), ("notes", "heading 1"), ("notes", "heading 2"), ("plain", "(document)")}


def test_resolve_fill_and_route(spark):
    s = src(spark, **{"drop/whale.txt": book(), "drop/other.txt": "Chapter 1\n" + "z " * 600})
    u = spans.units(spans.markers(s))
    q = ask(spark, "quote chapter 2 of the whale", "how does the whale start?", "show me chapter 9", "what is it about", "summarize chapter iii of the whale")
    r = spans.resolve(q, u)
    got = {x.qid: x.handle for x in r.collect()}
    assert got == {0: "whale-chapter-2", 1: "whale-opening", 4: "whale-chapter-3"}
    t = spans.span_text(r, s)
    text = {x.handle: x.text for x in t.collect()}
    assert text["whale-chapter-2"].startswith("It begins 2 here.") and len(text["whale-opening"].split()) == 160
    assert spans.span_text(r, s, 50).filter("handle = 'whale-chapter-2'").first().text.endswith(" …[truncated]")
    answers = spark.createDataFrame([(0, "See: [[SPAN:whale-chapter-2]] and [[SPAN:nobody]]!"), (1, "none")], "qid bigint, response string")
    filled = {x.qid: x.response for x in spans.fill(answers, t.select("handle", "text").distinct()).collect()}
    assert filled[0] == f"See: {text['whale-chapter-2']} and [[SPAN:nobody]]!" and filled[1] == "none"
    assert {x.qid: x.route for x in spans.route(q, r).collect()} == {0: "quote_span", 1: "quote_span", 2: "quote_passage", 3: "retrieve", 4: "read"}
    assert {x.qid: x.source for x in spans.resolve_whole(ask(spark, "summarize the whole book", "explain other.txt", "hello"), s).collect()} == {0: "drop/whale.txt", 1: "drop/other.txt"}


def table(spark):
    rows = [("app.core", "run"), ("app.core", "Runner"), ("app.tools", "hammer"), ("app.empty", None), ("app", None)]
    return spark.createDataFrame(rows, "module string, name string")


def problems(spark, code):
    return sorted(r.problem for r in verify.check_imports(spark.createDataFrame([(0, code)], "qid bigint, code string"), table(spark), "app").collect())


def test_import_checks(spark):
    assert problems(spark, "from app.core import run, Runner\nimport app.tools\n") == []
    assert problems(spark, "from app.core import hammer") == ["'hammer' is not in app.core; it lives in app.tools"]
    assert problems(spark, "from app.core import nothing") == ["'nothing' is not in app.core; no such symbol exists"]
    assert "module 'app.nowhere' does not exist ('run' actually lives in app.core)" in problems(spark, "from app.nowhere import run")
    assert problems(spark, "x = app.core.hammer(1)") == ["'app.core.hammer' is invalid; 'hammer' lives in app.tools"]


def test_symbols_and_names(spark):
    f = spark.createDataFrame([("__init__.py", "x: int = 1"), ("core.py", "import os\nclass A: pass\ndef _b(): pass\nasync def c(): pass\nD = 2"), ("bad.py", "def ("), ("note.md", "text")], "path string, text string")
    got = sorted(tuple(r) for r in verify.symbols(f, "app").collect())
    assert got == [("app", "x"), ("app.core", "A"), ("app.core", "D"), ("app.core", "_b"), ("app.core", "c"), ("app.core", "os")]
    listed = verify.symbol_map(verify.symbols(f, "app"), ["app.core"]).collect()
    assert listed[0].module == "app.core" and "_b" not in listed[0].names
    assert verify.undefined_modules("x = datetime.now()") == ["datetime"]
    assert verify.undefined_modules("import json\njson.dumps(1)") == [] and verify.undefined_modules("from x import *\nos.x") == [] and verify.undefined_modules("def (") == []


def test_verified_scores(spark):
    docs = spark.createDataFrame([("a.md", "```python\nx = 1\n```"), ("b.md", "```\ndef (\n```"), ("c.md", "prose"), ("d.py", "def ("), ("e.md", "```py\nreturn 3\n```")], "title string, text string")
    assert {r.source: r.score for r in verify.verified_scores(docs).collect()} == {"a.md": 2, "b.md": 0, "c.md": 2, "d.py": 2, "e.md": 2}
    assert {r.source: r.score for r in verify.verified_scores(docs, lambda code: 1).collect()}["a.md"] == 1


def docx(*paragraphs):
    out = io.BytesIO()
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_repository_scan(spark, tmp_path):
    for name, data in {"README.md": b"# Title\nText.", "src/a.py": b"def a(): pass\n", "src/b.min.js": b"x", "node_modules/c.js": b"x", ".git/d.py": b"x", "doc.docx": docx("One", "", "Two"),
                       "broken.docx": b"no zip", "Makefile": b"all:\n", "e.bin": b"\x00", ".env": b"KEY=1", "bad.txt": b"ok \xff end"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r.title: (r.kind, r.text) for r in files.read_documents(spark, str(tmp_path), "lib").collect()}
    assert got == {"lib/README.md": ("prose", "# Title\nText."), "lib/src/a.py": ("code", "def a(): pass\n"), "lib/doc.docx": ("prose", "One\nTwo"), "lib/Makefile": ("code", "all:\n"), "lib/bad.txt": ("prose", "ok  end")}
    old = spark.createDataFrame(files.signature(spark, str(tmp_path)).collect())
    (tmp_path / "new.md").write_text("n")
    (tmp_path / "README.md").write_text("longer than it was")
    (tmp_path / "Makefile").unlink()
    assert {r.path.rsplit("/", 1)[1]: r.change for r in files.changes(old, files.signature(spark, str(tmp_path))).collect()} == {"new.md": "added", "README.md": "edited", "Makefile": "removed"}
    (tmp_path / "q.jsonl").write_text('// comment\n\n{"id": 1, "gold": ["a"]}\n')
    assert [tuple(r) for r in files.jsonl(spark, str(tmp_path / "q.jsonl"), "id int, gold array<string>").collect()] == [(1, ["a"])]
    docs = files.read_documents(spark, str(tmp_path), "lib")
    assert [r.text for r in files.read_around(docs, "lib/src/a.py", 1, "def a").collect()] == ["def a(): pass"]
