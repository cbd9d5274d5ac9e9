"""Words of pages and the boxes that masking paints over them.

Reading and painting pages needs a PDF library, which is not part of this
package; ``words`` come from any reader as ``doc, page, idx, text`` and a box.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.intervals import touched
from .tables import MAX_PAGES


def word_offsets(words: DataFrame) -> DataFrame:
    """Add ``start, end``: where each word lies in its page's text, words joined by one space."""
    before = Window.partitionBy("doc", "page").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("int")
    return words.withColumn("start", start).withColumn("end", F.col("start") + F.length("text"))


def within_limit(words: DataFrame, max_pages: int = MAX_PAGES) -> DataFrame:
    """``doc, pages, rejected``: the reason for each document that has too many pages."""
    pages = words.groupBy("doc").agg((F.max("page") - F.min("page") + 1).alias("pages"))
    return pages.withColumn("rejected", F.when(F.col("pages") > max_pages, "too many pages"))


def page_texts(words: DataFrame) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("idx", "text")))
    return words.groupBy("doc", "page").agg(F.array_join(F.transform(ordered, lambda w: w["text"]), " ").alias("text"))


def boxes(words: DataFrame, spans: DataFrame, dpi: int = 72) -> DataFrame:
    """Words that overlap a span of their page, with the box in pixels."""
    placed = word_offsets(words)
    hit = placed.join(touched(placed, spans, ["doc", "page"]), ["doc", "page", "start", "end"], "left_semi")
    return hit.withColumns({c: F.col(c) * (dpi / 72.0) for c in ("x0", "top", "x1", "bottom") if c in words.columns})
