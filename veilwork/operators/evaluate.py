"""Span evaluation: matching, leak rate, ratios, confusion, distributions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import cut, overlap, overlap_length
from ..sources.tables import even_tasks
from .intervals import overlapping, touched

# The types that an evaluation counts, and the type that counts as another.
TYPES = ("PERSON", "PHONE_NUMBER", "EMAIL_ADDRESS", "INN", "SNILS", "PASSPORT", "DATE_OF_BIRTH", "CREDIT_CARD")
ALIAS = {"DATE_TIME": "DATE_OF_BIRTH"}


def greedy_matches(gold: Column, predicted: Column, strict: bool = True) -> Column:
    """One-to-one matches ``(g, p)`` of indexes: each gold span in turn takes the first free fitting prediction.

    Fitting: equal type and bounds, or with ``strict`` false equal type and an overlap.
    """
    indexed = F.transform(gold, lambda g, i: F.struct(i.alias("i"), g.alias("g")))

    def fits(g: Column, p: Column) -> Column:
        where = (g["start"] == p["start"]) & (g["end"] == p["end"]) if strict else overlap(g, p)
        return (g["entity_type"] == p["entity_type"]) & where

    def step(acc: Column, x: Column) -> Column:
        free = F.filter(F.transform(predicted, lambda p, j: F.when(fits(x["g"], p), j)), lambda j: j.isNotNull() & ~F.exists(acc, lambda m: m["p"] == j))
        return F.when(F.size(free) > 0, F.concat(acc, F.array(F.struct(x["i"].alias("g"), free[0].alias("p"))))).otherwise(acc)

    return F.aggregate(indexed, F.array().cast("array<struct<g:int,p:int>>"), step)


def aliased(spans: Column, names: dict[str, str] = ALIAS) -> Column:
    """Spans whose type counts as another get that type."""
    kind = lambda s: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), s["entity_type"]), s["entity_type"])
    return F.transform(spans, lambda s: s.withField("entity_type", kind(s)))


def match_counts(df: DataFrame, gold: str = "gold", predicted: str = "predicted", strict: bool = True) -> DataFrame:
    """``entity_type, tp, fp, fn`` over rows with arrays of gold and predicted spans, predictions by the type that they count as."""
    rows = df.select(F.col(gold).alias("g"), aliased(F.col(predicted)).alias("p"))
    rows = rows.select("g", "p", greedy_matches(F.col("g"), F.col("p"), strict).alias("m"))
    hit = lambda side: lambda i: F.exists(F.col("m"), lambda m: m[side] == i)
    gold_rows = F.transform("g", lambda s, i: F.struct(s["entity_type"].alias("t"), F.when(hit("g")(i), "tp").otherwise("fn").alias("k")))
    spare = F.transform("p", lambda s, i: F.struct(s["entity_type"].alias("t"), F.when(hit("p")(i), "-").otherwise("fp").alias("k")))
    each = rows.select(F.explode(F.concat(gold_rows, spare)).alias("x")).select("x.*").filter("k <> '-'")
    count = lambda k: F.count(F.when(F.col("k") == k, 1)).alias(k)
    return each.groupBy(F.col("t").alias("entity_type")).agg(count("tp"), count("fp"), count("fn"))


def ratios(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Precision, recall and F2; nothing found or nothing to find counts as 1."""
    p = F.when(tp + fp == 0, 1.0).otherwise(tp / (tp + fp))
    r = F.when(tp + fn == 0, 1.0).otherwise(tp / (tp + fn))
    return {"precision": p, "recall": r, "f2": F.when(4 * p + r == 0, 0.0).otherwise(5 * p * r / (4 * p + r))}


def prf2(counts: DataFrame) -> DataFrame:
    """Ratios by type, ``micro`` over their sums and ``macro`` as the mean over types that occur."""
    named = counts.filter(F.col("entity_type").isin(*TYPES) & (F.col("tp") + F.col("fp") + F.col("fn") > 0))
    summed = named.rollup("entity_type").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    micro = summed.withColumn("entity_type", F.coalesce("entity_type", F.lit("micro"))).withColumns(ratios(F.col("tp"), F.col("fp"), F.col("fn")))
    macro = micro.filter("entity_type <> 'micro'").agg(F.lit("macro").alias("entity_type"), *[F.lit(None).cast("long").alias(c) for c in ("tp", "fp", "fn")], *[F.avg(c).alias(c) for c in ("precision", "recall", "f2")])
    return micro.unionByName(macro)


def leaked(value: Column, anonymized: Column) -> Column:
    """Whether a value, stripped, is still in the text; empty values are not counted (null)."""
    v = F.regexp_replace(value, r"(?U)^\s+|\s+$", "")
    return F.when(v != "", F.contains(anonymized, v))


def name_leaked(value: Column, anonymized: Column) -> Column:
    """Whether any part of a name, longer than two characters, is still in the text."""
    parts = F.filter(F.split(value, r"(?U)[\s.]+"), lambda p: F.length(p) > 2)
    return F.exists(parts, lambda p: F.contains(anonymized, p))


def best_overlaps(gold: DataFrame, predicted: DataFrame, key: str = "doc_id") -> DataFrame:
    """For each gold span, the type predicted with the longest overlap; of equal ones the first; else ``<miss>``."""
    spans = gold.select(key, "start", "end", "entity_type").distinct()
    pairs = overlapping(spans, predicted.select(key, "start", "end", "entity_type"), [key])
    order = F.struct(overlap_length(F.col("l"), F.col("r")).alias("n"), (-F.col("r.start")).alias("s"))
    keys = [key, "start", "end", "entity_type"]
    best = pairs.groupBy(*[F.col(f"l.{c}").alias(c) for c in keys]).agg(F.max_by("r.entity_type", order).alias("best"))
    return spans.join(best, keys, "left").select(*keys, F.coalesce("best", F.lit("<miss>")).alias("predicted_type"))


def confusion(best: DataFrame, types: list[str]) -> DataFrame:
    """Gold types by predicted types."""
    return best.groupBy("entity_type").pivot("predicted_type", types).count().na.fill(0)


def spurious(predicted: DataFrame, gold: DataFrame, key: str = "doc_id") -> DataFrame:
    """Predictions that overlap no gold span."""
    return predicted.join(touched(predicted, gold, [key]), [key, "start", "end"], "left_anti")


def latency(timings: DataFrame, by: str = "cell", ms: str = "ms") -> DataFrame:
    """Median, mean and deviation of repeated runs, and texts a second."""
    return timings.groupBy(by).agg(F.median(ms).alias("median"), F.avg(ms).alias("mean"), F.stddev_pop(ms).alias("std"), (1000.0 / F.median(ms)).alias("per_second"))


def has_placeholder(text: Column) -> Column:
    """Over-masking test; numbered placeholders count too."""
    return F.regexp_like(text, F.lit(r"<[A-Z_]+(?:_\d+)?>"))


def type_presence(rows: DataFrame, detected: Callable[[Column], Column], text: str = "text", entity_type: str = "entity_type") -> DataFrame:
    """``entity_type, found, total, recall``: how many labelled rows have their type among what is detected in their text.

    Each distinct text is analysed once; ``detected`` gives its spans.  Labels
    are counted in salted groups and gathered by text, in a number of tasks that
    does not follow the bytes of the shuffle, as these are few beside the work.
    """
    tasks = even_tasks(rows)
    named = rows.select(F.col(text).alias("text"), F.col(entity_type).alias("entity_type"), (F.monotonically_increasing_id() % 16).alias("salt")).filter(F.col("text").isNotNull())
    counted = named.repartition(tasks, "text", "entity_type", "salt").groupBy("text", "entity_type", "salt").agg(F.count("*").alias("n"))
    gathered = counted.repartition(tasks, "text").groupBy("text").agg(F.collect_list(F.struct("entity_type", "n")).alias("labels"))
    each = gathered.select(F.transform(detected(F.col("text")), lambda s: s["entity_type"]).alias("types"), "labels").select("types", F.explode_outer("labels").alias("x"))
    hit = F.array_contains("types", F.col("x.entity_type")).cast("int")
    sums = each.groupBy(F.col("x.entity_type").alias("entity_type")).agg(F.sum(hit * F.col("x.n")).alias("found"), F.sum("x.n").alias("total"), F.sum(F.when(hit.isNotNull(), F.col("x.n"))).alias("known"))
    return sums.select("entity_type", "found", "total", (F.col("found") / F.col("known")).alias("recall"))


def letter_case(name: Column) -> Column:
    """``lower`` for a name in small letters throughout, else ``capital``."""
    return F.when(name == F.lower(name), "lower").otherwise("capital")


def name_format(name: Column) -> Column:
    """``initials`` if a letter before a dot is in the name, else its number of words."""
    words = F.size(F.filter(F.split(name, r"(?U)\s+"), lambda w: w != ""))
    return F.when(F.regexp_like(name, F.lit(r"(?U)\b\w\.")), "initials").when(words == 1, "1 word").when(words == 2, "2 words").otherwise("3 words")


def recall_by(df: DataFrame, bucket: Callable[[Column], Column] | str, text: str = "text", gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """``bucket, tp, fn, recall`` of gold spans, matched by overlap, by what ``bucket`` says of their text, or by its field if it names one."""
    of = (lambda s: s[bucket]) if isinstance(bucket, str) else lambda s: bucket(cut(F.col("t"), s))
    rows = df.select(F.col(text).alias("t"), F.col(gold).alias("g"), greedy_matches(F.col(gold), F.col(predicted), strict=False).alias("m"))
    one = lambda s, i: F.struct(of(s).alias("bucket"), F.exists(F.col("m"), lambda m: m["g"] == i).alias("hit"))
    each = rows.select(F.explode(F.transform("g", one)).alias("x")).select("x.*")
    sums = each.groupBy("bucket").agg(F.count(F.when(F.col("hit"), 1)).alias("tp"), F.count(F.when(~F.col("hit"), 1)).alias("fn"))
    return sums.withColumn("recall", F.col("tp") / (F.col("tp") + F.col("fn")))


def error_classes(df: DataFrame, gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """``class, n``: gold spans found with their bounds (correct), with others (partial) or not (missing), and predictions that overlap none (spurious)."""
    rows = df.select(F.col(gold).alias("g"), F.col(predicted).alias("p"), greedy_matches(F.col(gold), F.col(predicted), strict=False).alias("m"))

    def judged(s: Column, i: Column) -> Column:
        at = F.get(F.filter("m", lambda m: m["g"] == i), F.lit(0))["p"]
        hit = F.get(F.col("p"), at)
        return F.when(at.isNull(), "missing").when((hit["start"] == s["start"]) & (hit["end"] == s["end"]), "correct").otherwise("partial")

    spare = F.transform(F.filter("p", lambda p: ~F.exists("g", lambda g: overlap(g, p))), lambda p: F.lit("spurious"))
    each = rows.select(F.explode(F.concat(F.transform("g", judged), spare)).alias("class"))
    return each.groupBy("class").agg(F.count("*").alias("n"))


def pick_diverse(df: DataFrame, n: int, order: str, spans: str = "spans", kind: str = "type") -> DataFrame:
    """At most ``n`` rows, first those whose set of types no earlier row has, each by ``order``."""
    types = F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s[kind]))), ",")
    marked = df.withColumn("_types", types)
    first = marked.groupBy("_types").agg(F.min(order).alias("_first"))
    ranked = marked.join(first, "_types").orderBy(F.col(order) != F.col("_first"), order).limit(n)
    return ranked.drop("_types", "_first")
