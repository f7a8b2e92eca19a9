"""Column expressions over text: lines, match lists with offsets, splicing.

Everything here is built from Spark's own functions, so plans stay in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import catalog as C

STRIP = r"(?U)^\s+|\s+$"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def once(x: Column) -> Column:
    """A barrier for the optimizer: filters above are not pushed below it with the expression
    copied into each of their references, so the value is computed once a row."""
    return F.when(F.spark_partition_id() >= 0, x)


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body refers to it."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def sql_text(x: str) -> str:
    """A string as a SQL literal."""
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, STRIP, "")


def lines(text: Column) -> Column:
    """As str.splitlines: a trailing break ends the last line, and an empty text has none."""
    parts = F.split(text, C.LINE_BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def slice_text(text: Column, start: Column, end: Column) -> Column:
    """text[start:end] for 0 <= start; empty if end <= start."""
    return F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))


def extract_all(text: Column, regex: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(C.java(regex)), F.lit(group))


def count_matches(text: Column, regex: str) -> Column:
    return F.regexp_count(text, F.lit(C.java(regex)))


def found(text: Column, regex: str) -> Column:
    return text.rlike(C.java(regex))


def matches(text: Column, regex: str) -> Column:
    """array<struct<start, end, text>> of all matches, left to right.

    The texts between matches and the matches themselves alternate, so a running sum of their
    lengths gives the offsets; every pattern used consumes at least one character.
    """
    hits, gaps = extract_all(text, regex), F.split(text, C.java(regex), -1)
    kind = "array<struct<start:int,end:int,text:string>>"
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def step(a, x):
        start = a["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("text")))).alias("out"))

    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    return F.aggregate(pairs, empty, step, lambda a: a["out"])


def matches_sql(text: str, regex: str) -> str:
    """``matches`` as SQL over a SQL expression: far fewer calls to build where there are many."""
    hits = f"regexp_extract_all({text}, {sql_text(C.java(regex))}, 0)"
    gaps = f"split({text}, {sql_text(C.java(regex))}, -1)"
    return (
        f"aggregate(zip_with(slice({gaps}, 1, size({hits})), {hits}, (g, h) -> named_struct('g', g, 'h', h)), "
        "named_struct('at', 0, 'out', cast(array() as array<struct<start:int,end:int,text:string>>)), "
        "(a, x) -> named_struct('at', a.at + length(x.g) + length(x.h), 'out', concat(a.out, array(named_struct('start', a.at + length(x.g), 'end', a.at + length(x.g) + length(x.h), 'text', x.h)))), "
        "a -> a.out)"
    )
