"""Files to documents: repositories, Word and PDF, change detection, datasets."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CODE = ["." + x for x in "c cpp cs css dfm dpk dpr fmx go h hpp html inc java js jsx kt mjs pas php ps1 py rb rs scss sh sql svelte swift ts tsx twig vue".split()]
DOCS = ["." + x for x in "md rst txt".split()]
CONFIG = ["." + x for x in "cfg ini json toml xml yaml yml".split()]
EXTRACTED = [".docx", ".pdf"]
SPECIAL = [x + "file" for x in "docker gem jenkins make proc rake vagrant".split()]
SKIP = "build dist venv vendor node_modules __pycache__".split()  # hidden ones are skipped anyway

DOCUMENT = "doc_seq bigint, title string, text string, kind string, repo string"
_W = "{http://schemas.openxmlformats.org/" + "wordprocessingml/2006/main}"


def docx_text(data: bytes) -> str | None:
    """Paragraphs, table cells too, a line each; None for what isn't a Word file."""
    try:
        root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None
    lines = ("".join(t.text or "" for t in p.iter(_W + "t")) for p in root.iter(_W + "p"))
    return "\n".join(x for x in lines if x.strip()) or None


def pdf_text(data: bytes) -> str | None:
    """Pages by line breaks; None without the optional reader or without text."""
    try:
        from pypdf import PdfReader
    except ImportError:
        return None
    try:
        return "\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages).strip() or None
    except Exception:  # a broken file is a file without text
        return None


EXTRACTORS = {".docx": docx_text, ".pdf": pdf_text}


def scan(spark: SparkSession, root: str, every: bool = False) -> DataFrame:
    """(path, ext, content) of the files below ``root``, paths relative to it. Without ``every`` only
    the known kinds; skipped and hidden folders and minified scripts never. The tests are on the
    listing's path, before contents are decoded."""
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    plain = F.regexp_replace("path", r"^[a-z0-9]+:/*", "/")
    rel = F.substring(plain, F.length(F.lit("/" + base.split(":")[-1].lstrip("/"))) + 2, 1 << 20)
    f = files.select(rel.alias("path"), "content").withColumn("ext", F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)))
    f = f.withColumn("name", F.lower(F.regexp_extract("path", r"([^/]*)$", 1)))
    folders = F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1)
    f = f.filter(~F.exists(folders, lambda d: d.isin(SKIP) | d.startswith(".")))
    if not every:
        f = f.filter((F.col("ext").isin(CODE + DOCS + CONFIG + EXTRACTED) | F.col("name").isin(SPECIAL)) & ~F.col("name").endswith(".min.js"))
    return f


def read_documents(spark: SparkSession, root: str, label: str, every: bool = False) -> DataFrame:
    """Documents of a repository: title <label>/<path>, in the order of folders and names; prose for
    documents and extracted files, code for the rest. Undecodable bytes are dropped."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = [EXTRACTORS[e](bytes(c)) if e in EXTRACTORS else bytes(c).decode("utf-8", "ignore") for e, c in zip(b["ext"], b["content"])]
            yield pd.DataFrame({"path": b["path"], "ext": b["ext"], "text": text})

    got = scan(spark, root, every).select("path", "ext", "content").mapInPandas(run, "path string, ext string, text string").filter("text IS NOT NULL")
    kind = F.when(F.col("ext").isin(DOCS + EXTRACTED), "prose").otherwise("code")
    from textloom.operators.storage import running_total

    numbered = running_total(got.withColumn("__one", F.lit(1).cast("bigint")), ["path"], "__one", "doc_seq")
    return numbered.select("doc_seq", F.concat(F.lit(label + "/"), F.col("path")).alias("title"), "text", kind.alias("kind"), F.lit(label).alias("repo"))


def signature(spark: SparkSession, root: str) -> DataFrame:
    """(path, mtime, size): what tells whether a folder has changed."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return f.select("path", F.unix_timestamp("modificationTime").alias("mtime"), F.col("length").alias("size"))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): added, removed or edited files between two signatures."""
    o, n = old.select("path", F.struct("mtime", "size").alias("o")), new.select("path", F.struct("mtime", "size").alias("n"))
    what = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("o") != F.col("n"), "edited")
    return o.join(n, "path", "full").select("path", what.alias("change")).filter("change IS NOT NULL")


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines and those that begin with // are left out."""
    lines = spark.read.text(path).filter(~F.trim("value").startswith("//") & (F.trim("value") != ""))
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def trim_book(text):
    """A Column without the header and footer of a public-domain book."""
    body = F.regexp_replace(text, r"(?s)^.*?\*\*\* ?START OF[^\n]*\n", "")
    return F.regexp_replace(body, r"(?s)\*\*\* ?END OF.*$", "")


def probe_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, ability, question, facts) of rows (conv_id, probing_questions map of struct(question,
    rubric, ideal)): a missing rubric is the ideal answer."""
    p = rows.select("conv_id", F.explode("probing_questions").alias("ability", "p"))
    return p.select("conv_id", "ability", "p.question", F.when(F.size("p.rubric") > 0, F.col("p.rubric")).otherwise(F.array("p.ideal")).alias("facts"))


def message_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of rows (conv_id, chat: sessions of messages(role, content))."""
    return rows.select("conv_id", F.posexplode(F.flatten("chat")).alias("turn", "m")).select("conv_id", F.col("turn").cast("bigint").alias("turn"), "m.role", F.col("m.content").alias("text"))


def read_around(documents: DataFrame, title: str, window: int = 120, around: str = "") -> DataFrame:
    """(line, text) of one source: all of it or, where a line has ``around``, the lines near it."""
    lines = documents.filter(F.col("title") == title).select(F.posexplode(F.split("text", "\n")).alias("line", "text"))
    if not around:
        return lines
    hit = lines.filter(F.col("text").contains(around)).agg(F.min("line").alias("hit"))
    near = lines.crossJoin(F.broadcast(hit)).filter(F.col("hit").isNull() | ((F.col("line") >= F.col("hit") - window) & (F.col("line") < F.col("hit") + window)))
    return near.select("line", "text")
