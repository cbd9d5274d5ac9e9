"""Mixing sources to target weights by hash-threshold histograms.

Every row hashes to a 36-bit number of its id.  Words are summed by source and
the hash's top 12 bits; the bucket in which a source's budget runs out is the
boundary, and only its rows are summed again by the next 12 bits, then by the
last 12.  The three nested thresholds make one number a source, and a row is
taken when its hash lies below it: nothing is sorted but histograms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import fresh, n_words, saved

#: Hexadecimal digits of the hash at each level (12 bits), and levels.
DIGITS, LEVELS = 3, 3


def level_bits(id_col: str, text_col: str, level: int) -> Column:
    """One level of a row's hash: of its id, or of its text where it has none."""
    digest = F.coalesce(F.md5(F.col(f"`{id_col}`").cast("string")), F.md5(F.col(f"`{text_col}`").cast("string")), F.md5(F.lit("null")))
    return F.conv(F.substring(digest, 1 + DIGITS * level, DIGITS), 16, 10).cast("int")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """``source, source_size`` to ``target``: shares by weight, capped, the excess reshared.

    Capping sources in the order of cap over weight raises what a unit of weight
    gets until the first source that needs no cap, and lowers it afterwards; the
    maximum is therefore the level at which no source lies above its cap.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_need = Window.orderBy("need", F.col("source").asc_nulls_last())
    size, weight = F.col("source_size"), F.col("weight")
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    listed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int") + 1))
    listed = listed.withColumn("cap", size * F.lit(float(most))).withColumn("need", F.col("cap") / weight)
    capped = F.coalesce(F.sum("cap").over(by_need.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(by_need.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - capped) / open_weight
    listed = listed.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return listed.select("source", "source_size", F.least("cap", F.col("level") * weight).alias("target"))


def boundary(histogram: DataFrame, budget: DataFrame, level: int) -> DataFrame:
    """The bucket of each source in which its budget runs out, and what is left of it there."""
    below = F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")
    joined = histogram.withColumn("below", below).withColumnRenamed("source", "of").join(budget, F.col("of").eqNullSafe(F.col("source")))
    inside = (F.col("below") <= F.col("rest")) & (F.col("rest") < F.col("below") + F.col("words"))
    bits = F.col("bucket").cast("long") * (1 << 4 * DIGITS * (LEVELS - 1 - level))
    rest = F.col("rest") - F.col("below")
    near = F.when(F.col("words") - rest < rest, 1).otherwise(0) if level == LEVELS - 1 else F.lit(0)
    kept = [c for c in budget.columns if c not in ("rest", "threshold", "at")]
    return joined.filter(inside).select(*kept, rest.alias("rest"), (F.col("threshold") + bits + near).alias("threshold"), F.col("bucket").alias("at"))


def hash_number() -> Column:
    """The 36 bits of a row's levels as one number."""
    return sum((F.col(f"b{i}").cast("long") * (1 << 4 * DIGITS * (LEVELS - 1 - i)) for i in range(LEVELS)), F.lit(0))


def plan_of(rows: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """A row a source: ``plan_of, source_size, target``, whole repeats and the hash threshold of one more."""
    histogram = rows.groupBy("source", F.col("b0").alias("bucket")).agg(F.sum("size").alias("words"))
    targets = saved(source_targets(histogram.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = targets.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    budget = plan.select("source", "rest", F.lit(0).cast("long").alias("threshold"), F.lit(0).alias("at"))
    inside = rows
    for level in range(LEVELS):
        if level:
            edge = budget.select(F.col("source").alias("of"), "at")
            on = F.col("source").eqNullSafe(F.col("of")) & (F.col(f"b{level - 1}") == F.col("at"))
            inside = inside.join(edge, on).drop("of", "at")
            histogram = inside.groupBy("source", F.col(f"b{level}").alias("bucket")).agg(F.sum("size").alias("words"))
        budget = saved(boundary(histogram, budget, level))
    ends = budget.select(F.col("source").alias("end_of"), "threshold")
    joined = plan.join(ends, F.col("source").eqNullSafe(F.col("end_of")), "left").drop("end_of", "rest")
    return saved(joined.withColumnRenamed("source", "plan_of"))


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``doc_id, source``, the words of each text and the levels of its hash."""
    levels = [level_bits(id_col, text_col, i).alias(f"b{i}") for i in range(LEVELS)]
    return saved(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), n_words(F.col(f"`{text_col}`")).alias("size"), *levels))


def copies_taken() -> Column:
    return (F.col("whole") + F.when(hash_number() < F.col("threshold"), 1).otherwise(0)).cast("long")


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """How often each document goes into a mix of ``share`` times all words.

    Sources in the order of code points, null last, weigh ``weights`` in turn;
    none is taken over ``most`` times.  Returns ``doc_id, source, size,
    source_size, target, copies, taken``, one row an input row.  A null text has
    size 0; a row without an id hashes by its text; rows of one id, or of one text
    without ids, are taken alike, so a source's taken words miss its target by up
    to half the words of such rows together; a source without words has target 0;
    an empty table gives an empty one; other columns are not read.
    """
    rows = sized(docs, id_col, text_col, source_col)
    plan = plan_of(rows, weights, share, most)
    return (
        rows.join(plan, F.col("source").eqNullSafe(F.col("plan_of")))
        .withColumn("copies", copies_taken())
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))
    )


def mixed(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The documents of the mix themselves, each as often as ``mix_sources`` takes it.

    Thresholds meet the documents by source, so texts are not shuffled where the
    plan is small enough to be sent to them.
    """
    plan = plan_of(sized(docs, id_col, text_col, source_col), weights, share, most)
    number = sum((level_bits(id_col, text_col, i).cast("long") * (1 << 4 * DIGITS * (LEVELS - 1 - i)) for i in range(LEVELS)), F.lit(0))
    of, whole, threshold = (fresh(docs, n) for n in ("of", "whole", "threshold"))
    mine = plan.select(F.col("plan_of").alias(of), F.col("whole").alias(whole), F.col("threshold").alias(threshold))
    taken = docs.join(mine, F.col(f"`{source_col}`").eqNullSafe(F.col(of)))
    copies = (F.col(whole) + F.when(number < F.col(threshold), 1).otherwise(0)).cast("int")
    again = F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)))
    return taken.select(*[F.col(f"`{c}`") for c in docs.columns], again.alias(fresh(docs, "copy"))).select(*[f"`{c}`" for c in docs.columns])


ORACLE_SQL = r"""
WITH rows_ AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         substr(md5(CAST(doc_id AS VARCHAR)), 1, 9) AS h
  FROM documents),
sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS nth
  FROM rows_ GROUP BY source),
weighed AS (
  SELECT *, CASE (nth - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, source_size * 2.0::DOUBLE AS cap FROM sizes),
levels AS (
  SELECT *, ((SELECT sum(source_size) FROM sizes) * 1.5::DOUBLE
     - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
     / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lambda_
  FROM weighed),
targets AS (
  SELECT source, source_size, least(cap, (SELECT max(lambda_) FROM levels) * w) AS target FROM levels),
plan_ AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM targets),
hashes AS (
  SELECT source, h, CAST(sum(size) AS DOUBLE) AS words, CAST(sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS DOUBLE) AS upto
  FROM rows_ GROUP BY source, h),
chosen AS (
  SELECT t.source, t.h FROM hashes t JOIN plan_ p ON t.source IS NOT DISTINCT FROM p.source
  WHERE t.upto - (p.target - p.whole * p.source_size) < (p.target - p.whole * p.source_size) - (t.upto - t.words))
SELECT r.doc_id, r.source, r.size, p.source_size, p.target,
       p.whole + CASE WHEN c.h IS NULL THEN 0 ELSE 1 END AS copies,
       r.size * (p.whole + CASE WHEN c.h IS NULL THEN 0 ELSE 1 END) AS taken
FROM rows_ r JOIN plan_ p ON r.source IS NOT DISTINCT FROM p.source
LEFT JOIN chosen c ON c.source IS NOT DISTINCT FROM r.source AND c.h = r.h
"""
