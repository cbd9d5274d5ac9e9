"""Tag sequences as chunks: gaps and islands over B/I/O tags, and scores by chunk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _kind(tag: Column) -> Column:
    """The type behind ``B-`` or ``I-``; null outside."""
    return F.when(tag.startswith("B-") | tag.startswith("I-"), F.substring(tag, F.lit(3), F.length(tag)))


def tag_chunks(tokens: DataFrame, keys: Sequence[str], pos: str = "pos", tag: str = "tag") -> DataFrame:
    """``keys, type, first, last``: runs of tokens of one chunk.

    A chunk begins at ``B-``, and at an ``I-`` that follows nothing of its type.
    Null tags and others than ``B-`` and ``I-`` are outside.  ``pos`` orders the
    tokens of a key and may have gaps; only a key's tokens meet in a task.
    """
    order = Window.partitionBy(*keys).orderBy(pos)
    kind = _kind(F.col(tag)).alias("type")
    rows = tokens.select(*keys, F.col(pos).alias("pos"), F.coalesce(F.col(tag), F.lit("O")).alias("tag"), kind)
    order = Window.partitionBy(*keys).orderBy("pos")
    begins = F.col("type").isNotNull() & (F.col("tag").startswith("B-") | ~F.col("type").eqNullSafe(F.lag("type").over(order)))
    island = rows.withColumn("begins", begins.cast("int")).withColumn("island", F.sum("begins").over(order)).filter(F.col("type").isNotNull())
    return island.groupBy(*keys, "island", "type").agg(F.min("pos").alias("first"), F.max("pos").alias("last")).drop("island")


def chunk_scores(gold: DataFrame, predicted: DataFrame, keys: Sequence[str], pos: str = "pos", tag: str = "tag") -> DataFrame:
    """``type, tp, fp, fn, precision, recall, f1, f2`` by chunk, a chunk being right with its type and both ends; ``micro`` over all types.

    Ratios without anything to divide by are 0.
    """
    marked = lambda df, name: tag_chunks(df, keys, pos, tag).withColumn(name, F.lit(1))
    both = marked(gold, "g").join(marked(predicted, "p"), [*keys, "type", "first", "last"], "full_outer")
    count = lambda on: F.count(F.when(on, 1))
    g, p = F.col("g").isNotNull(), F.col("p").isNotNull()
    sums = both.rollup("type").agg(count(g & p).alias("tp"), count(~g & p).alias("fp"), count(g & ~p).alias("fn")).withColumn("type", F.coalesce("type", F.lit("micro")))
    share = lambda part, whole: F.when(whole == 0, 0.0).otherwise(part / whole)
    tp, precision, recall = F.col("tp"), F.col("precision"), F.col("recall")
    sums = sums.withColumn("precision", share(tp, tp + F.col("fp"))).withColumn("recall", share(tp, tp + F.col("fn")))
    f = lambda b: F.when(b * precision + recall == 0, 0.0).otherwise((1 + b) * precision * recall / (b * precision + recall))
    return sums.withColumn("f1", f(1.0)).withColumn("f2", f(4.0))
