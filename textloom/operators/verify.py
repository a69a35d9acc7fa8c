"""Checks of generated code and answers: imports, names, fenced blocks.

Code is parsed, never run: ``run_check`` is an injected scorer for those who want that.
"""

from __future__ import annotations

import ast
import builtins
import re
import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PLAIN_IMPORT = re.compile(r"(?m)^[\t ]*import\s+(?P<module>[.\w]+)")
FROM_IMPORT = re.compile(r"(?m)^[\t ]*from\s+(?P<module>[.\w]+)\s+import\s+(?P<names>[*,\t \w]+|\([^()]*\))")
BLOCK = re.compile(r"(?ms)```(?P<tag>\w*)[\t ]*\n(?P<body>.*?)```")


def imports(code: str) -> Iterator[tuple[str, str | None]]:
    """(module, name) of every import; the name is None for the module itself."""
    for m in PLAIN_IMPORT.finditer(code):
        yield m["module"], None
    for m in FROM_IMPORT.finditer(code):
        yield m["module"], None
        for name in re.findall(r"(?:^|,)\s*(\w+)", m["names"].strip("()")):
            yield m["module"], name


def python_blocks(text: str | None) -> list[str]:
    return [m["body"] for m in BLOCK.finditer(text or "") if m["tag"].lower() in ("py", "python", "")]


def _local(alias: ast.alias) -> str:
    """The name that an import binds."""
    return alias.asname or alias.name.partition(".")[0]


def module_symbols(source: str) -> list[str] | None:
    """Names a module defines at top level; None where it doesn't parse."""
    try:
        body = ast.parse(source).body
    except (SyntaxError, ValueError):
        return None
    out: list[str] = []
    for n in body:
        match n:
            case ast.ClassDef(name=name) | ast.FunctionDef(name=name) | ast.AsyncFunctionDef(name=name):
                out.append(name)
            case ast.Assign(targets=targets):
                out.extend(t.id for t in targets if isinstance(t, ast.Name))
            case ast.AnnAssign(target=ast.Name(id=name)):
                out.append(name)
            case ast.ImportFrom(names=names) | ast.Import(names=names):
                out.extend(_local(a) for a in names if a.name != "*")
    return out


def symbols(files: DataFrame, package: str) -> DataFrame:
    """(module, name) of Python files (path, text), paths relative to the package's folder; a module
    without names has one row with a null name."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, t in zip(b["path"], b["text"]):
                names = module_symbols(t)
                if names is None:
                    continue
                parts = p[: -len(".py")].split("/")
                parts = parts[:-1] if parts[-1] == "__init__" else parts
                module = ".".join([package, *parts])
                rows += [(module, n) for n in dict.fromkeys(names)] or [(module, None)]
            yield pd.DataFrame(rows, columns=["module", "name"])

    return files.filter(F.col("path").endswith(".py")).select("path", "text").mapInPandas(run, "module string, name string")


def references(answers: DataFrame, package: str) -> DataFrame:
    """(qid, module, name, chain): imports of the package (name null for the module itself) and dotted
    chains (chain true, module the whole chain)."""
    chain = re.compile(r"\b" + re.escape(package) + r"(?:[.]\w+)+")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for q, code in zip(b["qid"], b["code"].fillna("")):
                rows += [(q, module, name, False) for module, name in imports(code) if module.startswith(package)]
                rows += [(q, found, None, True) for found in chain.findall(code)]
            yield pd.DataFrame(rows, columns=["qid", "module", "name", "chain"])

    kind = answers.schema["qid"].dataType.simpleString()
    return answers.select("qid", "code").mapInPandas(run, f"qid {kind}, module string, name string, chain boolean").distinct()


def check_imports(answers: DataFrame, symbol_table: DataFrame, package: str) -> DataFrame:
    """(qid, problem): modules and names of the package that don't exist, with where a name really is.
    Anti-joins with the symbol table; of several homes the first by name."""
    refs = references(answers, package)
    modules = symbol_table.select("module").distinct()
    names = symbol_table.filter("name IS NOT NULL").distinct()
    home = names.groupBy("name").agg(F.min("module").alias("home"))
    imports = refs.filter("NOT chain")
    bad_module = imports.join(modules, "module", "left_anti")
    hints = bad_module.filter("name IS NOT NULL").join(home, "name").groupBy("qid", "module").agg(
        F.array_join(F.sort_array(F.collect_list(F.concat(F.lit(" ('"), F.col("name"), F.lit("' actually lives in "), F.col("home"), F.lit(")")))), "").alias("hint"))
    no_module = bad_module.select("qid", "module").distinct().join(hints, ["qid", "module"], "left").select(
        "qid", F.concat(F.lit("module '"), F.col("module"), F.lit("' does not exist"), F.coalesce("hint", F.lit(""))).alias("problem"))
    known = imports.filter("name IS NOT NULL").join(modules, "module", "left_semi")
    known = known.join(names, ["module", "name"], "left_anti").withColumn("sub", F.concat_ws(".", "module", "name"))
    known = known.join(modules.withColumnRenamed("module", "sub"), "sub", "left_anti").join(home, "name", "left")
    no_name = known.select("qid", F.concat(F.lit("'"), F.col("name"), F.lit("' is not in "), F.col("module"),
                                           F.coalesce(F.concat(F.lit("; it lives in "), F.col("home")), F.lit("; no such symbol exists"))).alias("problem"))
    # chains: the longest prefix that is a module, and the name behind it
    chain = refs.filter("chain").select("qid", F.col("module").alias("full")).join(modules.withColumnRenamed("module", "full"), "full", "left_anti")
    parts = F.split("full", r"\.")
    prefixes = chain.select("qid", "full", parts.alias("p"), F.explode(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1)))).alias("d"))
    prefixes = prefixes.withColumn("module", F.array_join(F.slice("p", F.lit(1), F.col("d")), ".")).withColumn("name", F.element_at("p", F.col("d") + 1))
    deepest = prefixes.join(modules, "module", "left_semi").withColumn("n", F.row_number().over(Window.partitionBy("qid", "full").orderBy(F.desc("d")))).filter("n = 1")
    broken = deepest.join(names, ["module", "name"], "left_anti").withColumn("sub", F.concat_ws(".", "module", "name")).join(modules.withColumnRenamed("module", "sub"), "sub", "left_anti").join(home, "name", "left")
    no_attr = broken.select("qid", F.concat(F.lit("'"), F.col("full"), F.lit("' is invalid; '"), F.col("name"), F.lit("' "),
                                            F.coalesce(F.concat(F.lit("lives in "), F.col("home")), F.lit("does not exist"))).alias("problem"))
    nowhere = chain.join(deepest.select("qid", "full"), ["qid", "full"], "left_anti").select("qid", F.concat(F.lit("module '"), F.col("full"), F.lit("' does not exist")).alias("problem"))
    return no_module.unionByName(no_name).unionByName(no_attr).unionByName(nowhere).distinct()


def symbol_map(symbol_table: DataFrame, relevant: list[str] | None = None, max_lines: int = 60, per_module: int = 12) -> DataFrame:
    """(module, names): public names, sorted, relevant modules first."""
    public = symbol_table.filter(~F.col("name").startswith("_"))
    rows = public.groupBy("module").agg(F.slice(F.sort_array(F.collect_set("name")), 1, per_module).alias("names"))
    return rows.orderBy(F.desc(F.col("module").isin(relevant or [])), "module").limit(max_lines)


def undefined_modules(code: str) -> list[str]:
    """Standard modules that code uses but never imports or binds. Nothing on a parse error or a
    star import: a false alarm would do more harm than a miss."""
    blocks = python_blocks(code) if BLOCK.search(code or "") else [code or ""]
    trees = []
    for b in blocks:
        try:
            trees.append(ast.parse(b))
        except (SyntaxError, ValueError):
            continue
    bound: set[str] = set()
    used: set[str] = set()
    for node in (n for t in trees for n in ast.walk(t)):
        match node:
            case ast.ImportFrom(names=names) | ast.Import(names=names):
                if any(a.name == "*" for a in names):
                    return []
                bound.update(map(_local, names))
            case ast.FunctionDef(name=name) | ast.AsyncFunctionDef(name=name) | ast.ClassDef(name=name):
                bound.add(name)
            case ast.arg(arg=name):
                bound.add(name)
            case ast.ExceptHandler(name=str(name)):
                bound.add(name)
            case ast.Global(names=names) | ast.Nonlocal(names=names):
                bound.update(names)
            case ast.Name(id=name, ctx=ast.Load()):
                used.add(name)
            case ast.Name(id=name):
                bound.add(name)
    stdlib = set(sys.stdlib_module_names)
    return sorted((used - bound - set(dir(builtins))) & stdlib)


def undefined_names(answers: DataFrame) -> DataFrame:
    """(qid, problem) of ``answers`` (qid, code)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(q, f"'{n}' is used but never imported; add `import {n}`") for q, c in zip(b["qid"], b["code"]) for n in undefined_modules(c)]
            yield pd.DataFrame(rows, columns=["qid", "problem"])

    return answers.select("qid", "code").mapInPandas(run, f"qid {answers.schema['qid'].dataType.simpleString()}, problem string")


def parses(block: str) -> bool:
    """As a module, or as the body of a function."""
    for code in (block, "def f():\n" + "\n".join("    " + x for x in block.splitlines() or ["pass"])):
        try:
            ast.parse(code)
            return True
        except (SyntaxError, ValueError):
            continue
    return False


def verified_scores(documents: DataFrame, run_check: Callable[[str], int] | None = None) -> DataFrame:
    """(source, score) of documents (title, text): the worst of its Python blocks decides: 2 runs (by
    default: parses), 1 fails with an error or in time, 0 doesn't parse. Python files and prose
    without blocks have 2; so has what the check fails on."""
    def one(title: str, text: str) -> int:
        if (title or "").endswith(".py"):
            return 2
        blocks = python_blocks(text)
        if any(not parses(b) for b in blocks):
            return 0
        try:
            return min((run_check(b) for b in blocks), default=2) if run_check else 2
        except Exception:
            return 2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"source": b["title"], "score": [one(t, x) for t, x in zip(b["title"], b["text"])]})

    rows = documents.filter("title IS NOT NULL").select("title", "text").mapInPandas(run, "source string, score int")
    return rows.groupBy("source").agg(F.min("score").alias("score"))
