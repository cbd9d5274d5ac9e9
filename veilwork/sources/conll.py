"""CoNLL files: one token and tag a line, sentences parted by blank lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SENTENCE = "array<struct<token:string,tag:string>>"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``path, line_no, sent_id, value``: lines in the order of their file, and how many blank ones lie before each.

    Files are split among tasks.  Running sums go over two levels: totals by
    split, few rows a file, then the lines of a split; so no task holds a file.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("row"), "value")
    lines = lines.withColumn("blank", F.regexp_like("value", F.lit(r"^\s*$")).cast("int"))
    before = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    sums = lines.groupBy("path", "at").agg(F.count("*").alias("n"), F.sum("blank").alias("blanks"))
    offsets = sums.select("path", "at", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("lines_before"), F.coalesce(F.sum("blanks").over(before), F.lit(0)).alias("blanks_before"))
    within = Window.partitionBy("path", "at").orderBy("row")
    placed = lines.select("*", F.row_number().over(within).alias("nth"), F.sum("blank").over(within).alias("seen"))
    placed = placed.join(offsets, ["path", "at"])
    return placed.select("path", (F.col("lines_before") + F.col("nth")).alias("line_no"), (F.col("blanks_before") + F.col("seen")).alias("sent_id"), "value", "blank")


def read_conll(spark: SparkSession, path: str, tags: list[str] | None = None, weight: float = 1.0) -> DataFrame:
    """``path, sent_id, tokens, weight``; a missing tag is ``O``, and so is one that ``tags`` lacks.

    Sentences end at blank lines, with or without spaces, whatever ends the
    lines.  ``sent_id`` numbers them within a file and has gaps where several
    lines are blank.
    """
    lines = numbered_lines(spark, path).filter("blank = 0")
    fields = F.split("value", "\t")
    tag = F.coalesce(F.nullif(F.trim(F.get(fields, F.lit(1))), F.lit("")), F.lit("O"))
    known = tag if tags is None else F.when(tag.isin(*tags), tag).otherwise("O")
    rows = lines.select("path", "sent_id", "line_no", fields[0].alias("token"), known.alias("tag"))
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "token", "tag")))
    sentences = rows.groupBy("path", "sent_id").agg(F.transform(ordered, lambda x: F.struct(x["token"].alias("token"), x["tag"].alias("tag"))).cast(SENTENCE).alias("tokens"))
    return sentences.withColumn("weight", F.lit(weight)).sortWithinPartitions("path", "sent_id")


def only_person(tokens: Column) -> Column:
    """Tags of persons; all others become ``O``."""
    return F.transform(tokens, lambda t: F.struct(t["token"].alias("token"), F.when(t["tag"].endswith("PERSON"), t["tag"]).otherwise("O").alias("tag")))


def write_conll(df: DataFrame, path: str, tokens: str = "tokens") -> None:
    line = lambda t: F.concat_ws("\t", t["token"], t["tag"])
    df.select(F.concat(F.array_join(F.transform(tokens, line), "\n"), F.lit("\n")).alias("value")).write.text(path)
