"""Quality rules (operator 7): a threshold table compiled into Spark expressions.

Every ratio is a built-in expression, so the JVM evaluates all of them in one pass over the
text and Python sees nothing. ``THRESHOLDS`` may be replaced by a caller's own table.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import without


class Rule(NamedTuple):
    """A document with at least ``from_words`` words has to have low <= measure <= high."""

    measure: str
    low: float | None
    high: float | None
    from_words: int = 0


#: Limits hold for texts of a length at which the measure means something.
THRESHOLDS = (
    Rule("n_words", 1, None),
    Rule("mean_word_chars", 2.0, 14.0, 5),
    Rule("symbol_ratio", None, 0.10, 5),
    Rule("upper_ratio", None, 0.60, 5),
    Rule("digit_ratio", None, 0.50, 5),
    Rule("stop_ratio", 0.02, None, 50),
    Rule("repeat_ratio", None, 0.20, 10),
    Rule("short_line_ratio", None, 0.95, 50),
    Rule("dup_line_ratio", None, 0.50, 10),
)

MEASURES = ("n_words", "mean_word_chars", "symbol_ratio", "upper_ratio", "digit_ratio", "stop_ratio",
            "repeat_ratio", "short_line_ratio", "dup_line_ratio")

STOP_WORDS = tuple(sorted(set(
    "the of and to a in is that it for was on with as by be this are at from or an have not but they which "
    "de la le et les des en du un que une pour est qui dans par sur au pas avec ce il elle ne se plus "
    "der die und den das von zu mit sich auf für nicht dem ist im ein eine als auch es an werden aus er hat dass sie nach "
    "el y los las del no por con su para al lo como más o pero sus le ha me si sin sobre este ya".split())))

SPACE = r"[ \t\n\r\f\x0B]+"
SYMBOLS = r"[^#$%&*|<>{}~^=_\\]+"


def _arrays(text: Column) -> dict[str, Column]:
    full = lambda a: F.filter(a, lambda x: x != "")
    return {
        "__words": full(F.split(text, SPACE)),
        "__letters": full(F.split(F.lower(text), r"[^\p{L}]+")),
        "__lines": full(F.transform(F.split(text, "\n"), lambda x: F.trim(x))),
    }


def _measures(text: Column) -> dict[str, Column]:
    count = lambda name: F.size(name).cast("double")
    n = F.greatest(count("__words"), F.lit(1.0))
    lines = F.greatest(count("__lines"), F.lit(1.0))
    kept = lambda drop: F.length(F.regexp_replace(text, drop, "")).cast("double")
    pairs = F.zip_with("__words", F.slice("__words", 2, F.greatest(F.size("__words"), F.lit(1))),
                       lambda a, b: F.coalesce(a == b, F.lit(False)))
    return {
        "n_words": F.size("__words").cast("bigint"),
        "mean_word_chars": kept(SPACE) / n,
        "symbol_ratio": kept(SYMBOLS) / n,
        "upper_ratio": kept(r"[^\p{Lu}]+") / F.greatest(kept(r"[^\p{L}]+"), F.lit(1.0)),
        "digit_ratio": kept(r"[^0-9]+") / F.greatest(F.length(text).cast("double"), F.lit(1.0)),
        "stop_ratio": F.size(F.filter("__letters", lambda x: x.isin(*STOP_WORDS))) / n,
        "repeat_ratio": F.size(F.filter(pairs, lambda x: x)) / n,
        "short_line_ratio": F.size(F.filter("__lines", lambda x: F.length(x) < 15)) / lines,
        "dup_line_ratio": 1 - F.size(F.array_distinct("__lines")) / lines,
    }


def failed(rules=THRESHOLDS) -> Column:
    """True where any rule is broken."""
    bad = F.lit(False)
    for r in rules:
        m = F.col(r.measure)
        wrong = F.lit(False)
        if r.low is not None:
            wrong = wrong | (m < r.low)
        if r.high is not None:
            wrong = wrong | (m > r.high)
        bad = bad | ((F.col("n_words") >= r.from_words) & wrong)
    return bad


def measure(docs: DataFrame, text_col: str = "text", rules=THRESHOLDS) -> DataFrame:
    """``docs`` with the measures and ``passed``.

    A null text counts as an empty one: it has no word and breaks the rule on n_words. Columns
    of ``docs`` that have a measure's name are replaced. Rows aren't compared with each
    other, so repeated rows get equal measures; an empty table gives an empty one.
    """
    base = without(docs, [*MEASURES, "passed", "__words", "__letters", "__lines"])
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return (base.withColumns(_arrays(text)).withColumns(_measures(text))
            .drop("__words", "__letters", "__lines").withColumn("passed", ~failed(rules)))


def keep(docs: DataFrame, text_col: str = "text", rules=THRESHOLDS) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns only."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    names = docs.columns
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), text.alias("__text"))
    passed = own.withColumns(_arrays(F.col("__text"))).withColumns(_measures(F.col("__text"))).filter(~failed(rules))
    return passed.select("__row.*")


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    """The documents that pass all rules, with their measures."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = measure(docs).filter("passed")
    return out.select("doc_id", "n_words", *[F.round(m, 6).alias(m) for m in MEASURES[1:]])


def _sql() -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    tests = []
    for r in THRESHOLDS:
        for op, v in ((">=", r.low), ("<=", r.high)):
            if v is not None:
                tests.append(f"(n_words < {r.from_words} OR {r.measure} {op} {v})")
    kept = lambda p: f"length(regexp_replace(t, '{p}', '', 'g'))::DOUBLE"
    return f"""
WITH a AS (
  SELECT doc_id, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACE}'), lambda x: x <> '') AS w,
    list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}]+'), lambda x: x <> '') AS l,
    list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS s
  FROM documents),
b AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
    {kept(SPACE)} / greatest(len(w), 1) AS mean_word_chars,
    {kept(SYMBOLS)} / greatest(len(w), 1) AS symbol_ratio,
    {kept('[^\\p{Lu}]+')} / greatest({kept('[^\\p{L}]+')}, 1) AS upper_ratio,
    {kept('[^0-9]+')} / greatest(length(t), 1) AS digit_ratio,
    len(list_filter(l, lambda x: x IN ({stop})))::DOUBLE / greatest(len(w), 1) AS stop_ratio,
    len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1]))::DOUBLE / greatest(len(w), 1) AS repeat_ratio,
    len(list_filter(s, lambda x: length(x) < 15))::DOUBLE / greatest(len(s), 1) AS short_line_ratio,
    1 - len(list_distinct(s))::DOUBLE / greatest(len(s), 1) AS dup_line_ratio
  FROM a)
SELECT doc_id, n_words, {', '.join(f'round({m}, 6) AS {m}' for m in MEASURES[1:])}
FROM b WHERE {' AND '.join(tests)}"""


QUERIES = {"op7_quality_rules": op7_quality_rules}
SQL = {"op7_quality_rules": _sql()}
