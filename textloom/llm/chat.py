"""Chat formatting (operator 4): a finite-state machine over roles and a declarative template."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stands for the turn's own text in a template.
TEXT = None


class Machine(NamedTuple):
    """Turn order: state and role -> state. The last state has to be an accepting one."""

    start: str
    step: dict[tuple[str, str], str]
    accept: tuple[str, ...]


class Template(NamedTuple):
    """Parts (literal or TEXT, whether loss counts) before, for each role's turn, and after."""

    before: tuple
    turn: dict[str, tuple]
    after: tuple


MACHINE = Machine(
    "start",
    {("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user",
     ("user", "assistant"): "assistant", ("assistant", "user"): "user"},
    ("assistant",))

TEMPLATE = Template(
    (("<|begin|>", False),),
    {"system": (("<|system|>\n", False), (TEXT, False), ("<|end|>\n", False)),
     "user": (("<|user|>\n", False), (TEXT, False), ("<|end|>\n", False)),
     "assistant": (("<|assistant|>\n", False), (TEXT, True), ("<|end|>\n", True))},
    (("<|stop|>", True),))


def _accepts(turns: Column, machine: Machine) -> Column:
    """Whether the machine, run over the roles in order, ends in an accepting state."""
    step = F.create_map(*[F.lit(x) for (s, r), t in machine.step.items() for x in (f"{s}|{r}", t)])
    last = F.aggregate(turns, F.lit(machine.start), lambda s, t: F.coalesce(F.element_at(step, F.concat(s, F.lit("|"), t.role)), F.lit("")))
    return last.isin(*machine.accept)


def _parts(parts, role: Column, text: Column) -> Column:
    return F.array(*[F.struct(role.alias("role"), (text if p is TEXT else F.lit(p)).alias("text"), F.lit(loss).alias("loss")) for p, loss in parts])


def ordered(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, turns): each conversation's distinct turns in order."""
    t = turns.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).alias("__conv"),
        F.struct(F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"),
                 F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).alias("t"))
    return t.groupBy("__conv").agg(F.array_distinct(F.sort_array(F.collect_list("t"))).alias("__turns"))


def format_chat(turns: DataFrame, machine: Machine = MACHINE, template: Template = TEMPLATE, conv_col: str = "conv_id",
                turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, segment, role, text, loss): the segments of all conversations whose order of turns
    the machine accepts; joined in order they are the training text.

    A null role is no role, so its conversation isn't accepted; a null text is an empty one,
    and empty segments are left out; rows without a conversation are ignored. Equal rows are one
    turn; different ones with one turn number come in the order of role and text, nulls first.
    Markers within a text stay as they are: encode TEXT parts as ordinary text.
    """
    good = ordered(turns, conv_col, turn_col, role_col, text_col).filter(_accepts(F.col("__turns"), machine))
    none = F.array().cast("array<struct<role:string,text:string,loss:boolean>>")

    def of(t: Column) -> Column:
        out = none
        for role, parts in template.turn.items():
            out = F.when(t.role == role, _parts(parts, t.role, t.text)).otherwise(out)
        return out

    blank = F.lit(None).cast("string")
    ends = [_parts(p, blank, blank) if p else none for p in (template.before, template.after)]
    whole = F.concat(ends[0], F.flatten(F.transform("__turns", of)), ends[1])
    segments = good.select(F.col("__conv"), F.posexplode(F.filter(whole, lambda s: s.text != "")).alias("segment", "s"))
    return segments.select(F.col("__conv").alias(conv_col), F.col("segment").cast("bigint").alias("segment"), "s.role", "s.text", "s.loss")


def op4_chat_format(spark, sf_dir: str) -> DataFrame:
    """The segments of all well-formed conversations."""
    return format_chat(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def _sql() -> str:
    q = lambda s: "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    pairs = ", ".join(f"'{s}|{r}'" for s, r in MACHINE.step)  # each state is the role that led to it
    rows = []
    for role, parts in TEMPLATE.turn.items():
        for k, (p, loss) in enumerate(parts):
            rows.append(f"('{role}', {k}, {'NULL' if p is TEXT else q(p)}, {str(loss).lower()})")
    ends = [f"SELECT conv_id, {pos}, {k}, NULL::VARCHAR, {q(p)}, {str(loss).lower()} FROM good GROUP BY conv_id"
            for pos, parts in ((-1, TEMPLATE.before), (1 << 40, TEMPLATE.after)) for k, (p, loss) in enumerate(parts)]
    return f"""
WITH d AS (SELECT DISTINCT conv_id, turn, role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT *, row_number() OVER w AS pos, coalesce(lag(role) OVER w, '{MACHINE.start}') AS prev,
        lead(conv_id) OVER w IS NULL AS is_last
      FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)),
ok AS (SELECT conv_id FROM t GROUP BY conv_id
       HAVING bool_and(coalesce(prev || '|' || role IN ({pairs}), false)) AND bool_or(is_last AND role IN ({', '.join(f"'{a}'" for a in MACHINE.accept)}))),
good AS (SELECT t.* FROM t JOIN ok USING (conv_id)),
parts(role, k, literal, loss) AS (VALUES {', '.join(rows)}),
s(conv_id, pos, k, role, text, loss) AS (
  SELECT conv_id, pos, k, role, coalesce(literal, text), loss FROM good JOIN parts USING (role)
  UNION ALL {' UNION ALL '.join(ends)})
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY pos, k) - 1 AS segment, role, text, loss FROM s WHERE text <> ''"""


QUERIES = {"op4_chat_format": op4_chat_format}
SQL = {"op4_chat_format": _sql()}
