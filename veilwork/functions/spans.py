"""Find all matches of an expression with their code-point offsets.

Spark has no such function.  ``regexp_extract_all`` gives the matches and
``split`` the gaps between them, so an offset is the length of all that lies
before; unlike ``regexp_instr``, lengths count code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lets import let

SPAN = "struct<start:int,end:int>"


def no_spans(kind: str = SPAN) -> Column:
    return F.array().cast(f"array<{kind}>")


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    """Half-open spans of every match, left to right.

    With ``group`` 1, the span of the group, which must be the whole match or
    its tail.  The pattern must not match the empty string.
    """

    def step(acc: Column, x: Column) -> Column:
        end = acc["at"] + F.length(x["g"]) + F.length(x["m"])
        span = F.struct((end - F.length(x["p"])).alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.concat(acc["found"], F.array(span)).alias("found"))

    begin = F.struct(F.lit(0).alias("at"), no_spans().alias("found"))

    def spans(whole: Column) -> Column:
        part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
        pieces = F.arrays_zip(whole.alias("m"), part.alias("p"), F.split(text, pattern, -1).alias("g"))
        return F.aggregate(F.slice(pieces, 1, F.size(whole)), begin, step, lambda acc: acc["found"])

    # a text without a match, by far the most frequent case, is searched once
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda whole: F.when(F.size(whole) > 0, spans(whole)).otherwise(no_spans()))


def cut(text: Column, span: Column) -> Column:
    """The text under a span."""
    return F.substring(text, span["start"] + 1, span["end"] - span["start"])


def overlap(a: Column, b: Column) -> Column:
    """Whether two half-open spans share a character."""
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def overlap_length(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"]))
