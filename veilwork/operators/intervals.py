"""Interval joins as equi-joins: spans are dealt to bins of positions, so no task holds all pairs of a document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import checkpointed

#: Positions of a bin.
WIDTH = 256
#: Spans of a bin, repeated ones too, that a row holds in an array.
HELD = 1000


def _bins(start: Column, end: Column, width: int) -> Column:
    """The bins that a half-open span touches; an empty one touches that of its start."""
    last = F.greatest(end - 1, start)
    return F.explode(F.sequence(F.floor(start / width).cast("long"), F.floor(last / width).cast("long")))


def overlapping(left: DataFrame, right: DataFrame, keys: Sequence[str], width: int = WIDTH) -> DataFrame:
    """Structs ``l, r`` of the rows of both sides whose spans ``start, end`` share a character within equal ``keys``.

    A pair meets in each bin that both touch and is kept in that of the later
    start, so it comes once.  Rows with a null key or bound meet nothing;
    repeated rows each give their pairs.
    """
    side = lambda df, name: df.select(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)], F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name), _bins(F.col("start"), F.col("end"), width).alias("bin"))
    both = side(left, "l").join(side(right, "r"), [*[f"k{i}" for i in range(len(keys))], "bin"])
    meet = (F.col("l.start") < F.col("r.end")) & (F.col("r.start") < F.col("l.end"))
    own_bin = F.floor(F.greatest("l.start", "r.start") / width) == F.col("bin")
    return both.filter(meet & own_bin).select("l", "r")


def touched(left: DataFrame, right: DataFrame, keys: Sequence[str], width: int = WIDTH) -> DataFrame:
    """The distinct ``keys, start, end`` of the left side that overlap anything of the right side."""
    return overlapping(left.select(*keys, "start", "end").distinct(), right.select(*keys, "start", "end").distinct(), keys, width).select("l.*").distinct()


def _fold(spans: Column) -> Column:
    """The spans of an array that remain: in the order of ``resolved``, each that overlaps none before it."""
    key = lambda s: F.struct((-s["score"]).alias("a"), (s["start"] - s["end"]).alias("b"), s["start"].alias("c"), s["rank"].alias("d"), s["end"].alias("e"), s["entity_type"].alias("f"), s.alias("s"))
    ordered = F.transform(F.array_sort(F.transform(F.array_distinct(spans), key)), lambda x: x["s"])
    clash = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    return F.aggregate(ordered, F.filter(ordered, lambda s: F.lit(False)), lambda acc, s: F.when(F.exists(acc, lambda k: clash(k, s)), acc).otherwise(F.concat(acc, F.array(s))))


def resolved(spans: DataFrame, keys: Sequence[str], width: int = WIDTH, most_rounds: int = 1000, held: int = HELD) -> DataFrame:
    """Greedy resolution of spans in rows, for documents with more spans than an array should hold.

    Equal to resolving each document's array.  Bins that no span crosses and
    that have ``held`` spans at most are resolved each by itself, as no span
    outside touches them.  The others go in rounds: spans that no remaining span
    beats are kept and what they overlap goes.  Ties go by score, length, start,
    ``rank``, end and type; rows alike in all of these count as one.  ``spans``
    has ``keys, entity_type, start, end, score, rank``, no key of them null, and
    is read up to three times; lineage is cut by checkpoints each round.
    """
    columns = ["entity_type", "start", "end", "score", "rank"]
    by = [*[f"k{i}" for i in range(len(keys))], "bin"]
    whole = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("s")
    rows = spans.select(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)], whole, _bins(F.col("start"), F.col("end"), width).alias("bin"))
    first = F.floor(F.col("s.start") / width)
    crosses = F.floor(F.greatest(F.col("s.end") - 1, F.col("s.start")) / width) > first
    open_ = checkpointed(rows.groupBy(*by).agg(F.count("*").alias("n"), F.max(crosses).alias("crossed")).filter(F.col("crossed") | (F.col("n") > held)).select(*by))
    plain = lambda df: df.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], *[F.col(f"s.{c}").alias(c) for c in columns])
    alone = lambda df: plain(df.groupBy(*by).agg(_fold(F.collect_list("s")).alias("s")).select(*by, F.explode("s").alias("s")))
    if open_.isEmpty():
        return alone(rows)
    rest = plain(rows.filter(first == F.col("bin")).join(open_, by, "left_semi"))
    return alone(rows.join(open_, by, "left_anti")).unionByName(_in_rounds(rest, keys, width, most_rounds))


def _in_rounds(spans: DataFrame, keys: Sequence[str], width: int, most_rounds: int) -> DataFrame:
    columns = ["entity_type", "start", "end", "score", "rank"]
    order = lambda c: F.struct(-F.col(f"{c}.score"), F.col(f"{c}.start") - F.col(f"{c}.end"), F.col(f"{c}.start"), F.col(f"{c}.rank"), F.col(f"{c}.end"), F.col(f"{c}.entity_type"))
    alive = checkpointed(spans.select(*keys, *columns).distinct())
    kept = alive.limit(0)
    every = [*keys, *columns]
    for _ in range(most_rounds):
        if alive.isEmpty():
            return kept
        beaten = overlapping(alive, alive, keys, width).filter(order("r") < order("l")).select("l.*").distinct()
        now = checkpointed(alive.join(beaten, every, "left_anti"))
        kept = kept.unionByName(now)
        gone = touched(alive, now, keys, width)
        alive = checkpointed(alive.join(gone, [*keys, "start", "end"], "left_anti"))
    raise RuntimeError(f"not resolved within {most_rounds} rounds")
