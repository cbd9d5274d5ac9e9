"""Quality rules by robust multivariate outliers.

Statistics of each text become a vector of logarithms.  For every language and
source the minimum covariance determinant is approached by concentration steps
over *all* rows: distances are summed into a histogram with the moments of each
step of it, the histogram is cut where ``SUBSET`` of the rows lie below, and
the moments below the cut are the next centre and covariance, until they stay.
The whole table is estimated first; each group begins there and counts it as
``BORROWED`` rows of its own, so groups of any size, one row included, are
judged alike.  A document far from its group's centre is rejected.  Vectors are
fixed-point integers, so sums are exact and reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import parts, saved

#: Steps of a logarithm's unit, and of the logarithm of a distance.
UNIT = 64
#: Share of a group that the estimate concentrates on, and concentration steps at most.
SUBSET, STEPS = 0.75, 8
#: Rows of its own that a group counts the whole table as.
BORROWED = 50
#: Least standard deviation of each statistic, in logarithms: what never varies in a group may still vary a little.
FLOOR = np.array([0.5, 0.15, 0.5, 0.5, 0.5])
#: Squared distance beyond which a document is rejected: 5 in 10 billion of a normal sample.
CUTOFF = 52.0
SYMBOLS = "#*$%&|<>"
P = len(FLOOR)
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
MOMENTS = ["n", *[f"s{i}" for i in range(P)], *[f"c{i}{j}" for i, j in PAIRS]]


def repeated_words(words: list[bytes]) -> int:
    """Words in three-word windows that occur twice or more, the first included."""
    if len(words) < 4:
        return 0
    code = pd.factorize(np.array(words, dtype=object))[0].astype(np.int64)
    n = len(words)  # a pair of codes is below n squared, so that no text overflows
    pair = pd.factorize(code[:-1] * n + code[1:])[0].astype(np.int64)
    window = pd.factorize(pair[:-1] * n + code[2:])[0]
    twice = np.bincount(window)[window] > 1
    covered = np.zeros(len(words), dtype=bool)
    for k in range(3):
        covered[k : len(words) - 2 + k] |= twice
    return int(covered.sum())


def text_statistics(text: str | None) -> tuple[int, int, int, int, int]:
    """Words, their code points, symbols, repeated lines and repeated words."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()  # at the six ASCII separators
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source`` and the five statistics of each whole text."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 3):
                rows = [text_statistics(t.as_py()) for t in part.column(3)]
                own = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *own], names=["doc_id", "lang", "source", *names])

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in docs.schema[:3]]
    return docs.mapInArrow(run, ", ".join([*kinds, *[f"{n} long" for n in names]]))


def vector() -> list[Column]:
    """The transformed statistics as integers."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    share = lambda c: F.log1p(100.0 * F.col(c) / words)
    parts = [F.log1p(F.col("n_words").cast("double")), F.log1p(F.col("word_chars") / words), share("n_symbols"), share("n_dup_lines"), share("n_repeat_words")]
    return [F.round(p * UNIT).cast("long").alias(f"x{i}") for i, p in enumerate(parts)]


def squared_distance(centre: str, inverse: str) -> Column:
    """Mahalanobis distance of ``x0..`` to arrays of the centre and the inverse covariance."""
    d = [F.col(f"x{i}") - F.col(centre)[i] for i in range(P)]
    return sum((d[i] * d[j] * F.col(inverse)[k] * (1.0 if i == j else 2.0) for k, (i, j) in enumerate(PAIRS)), F.lit(0.0))


def inverted(moments: DataFrame, scale: float, lent: np.ndarray | None = None) -> DataFrame:
    """Centre and inverse covariance of each group, from its moments and those that it is ``lent``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        floor = np.diag((FLOOR * UNIT) ** 2)
        for f in frames:
            centres, inverses = [], []
            for row in f[MOMENTS].to_numpy(dtype=float):
                row = row if lent is None else row + lent
                s, cov = row[1 : 1 + P] / row[0], np.zeros((P, P))
                for (i, j), c in zip(PAIRS, row[1 + P :], strict=True):
                    cov[i, j] = cov[j, i] = c / row[0] - s[i] * s[j]
                found = np.linalg.inv(cov * scale + floor)
                centres.append(s)
                inverses.append([found[i, j] for i, j in PAIRS])
            yield pd.DataFrame({"of": f["grp"], "centre": centres, "inverse": inverses})

    return moments.mapInPandas(run, "of string, centre array<double>, inverse array<double>")


def subset_moments(rows: DataFrame, distance: Column) -> DataFrame:
    """Moments of the ``SUBSET`` of each group with the least distances."""
    step = F.floor(F.log1p(distance) * UNIT).cast("long")
    x = [F.col(f"x{i}") for i in range(P)]
    sums = [F.count("*").alias("n"), *[F.sum(x[i]).alias(f"s{i}") for i in range(P)], *[F.sum(x[i] * x[j]).alias(f"c{i}{j}") for i, j in PAIRS]]
    histogram = rows.withColumn("step", step).groupBy("grp", "step").agg(*sums)
    upto = Window.partitionBy("grp").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    need = F.ceil(F.sum("n").over(Window.partitionBy("grp")) * SUBSET)
    running = histogram.select("grp", "step", F.col("n").alias("own"), need.alias("need"), *[F.sum(m).over(upto).alias(m) for m in MOMENTS])
    return running.filter((F.col("n") >= F.col("need")) & (F.col("n") - F.col("own") < F.col("need"))).select("grp", *MOMENTS)


def concentrated(rows: DataFrame, model: DataFrame, scale: float, lent: np.ndarray | None) -> tuple[DataFrame, DataFrame]:
    """The model of each group and the moments it comes from, after steps until no moment changes, ``STEPS`` at most."""
    mark = None
    for _ in range(STEPS):
        near = rows.join(model, F.col("grp") == F.col("of"))
        moments = saved(subset_moments(near, squared_distance("centre", "inverse")))
        model = saved(inverted(moments, scale, lent))
        now = moments.agg(F.sum(F.pmod(F.xxhash64("grp", *MOMENTS), F.lit(2**40)))).first()[0]
        if now == mark:
            break
        mark = now
    return model, moments


def consistency() -> float:
    """What the covariance of the inner part of a normal sample must be multiplied by."""
    x = np.random.default_rng(5).chisquare(P, 400_000)
    cut = np.quantile(x, SUBSET)
    return float(P / x[x <= cut].mean())


def quality_rules(
    docs: DataFrame,
    cutoff: float = CUTOFF,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
) -> DataFrame:
    """Statistics of every text and whether it passes.

    Returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, distance, kept``, one row an input row.
    ``base_failed``: under 50 words, or over half of them in repeated windows.
    Estimates are over the rows that do not fail, by language and source, nulls
    being a value; a row of a group without any has the whole table's, and
    without those a null ``distance``, which keeps it.  A null text has no words;
    an empty table gives an empty one; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    every = statistics(rows).withColumn("base_failed", failed).withColumn("own", F.to_json(F.struct("lang", "source")))
    every = saved(every.select("*", *vector()))
    good = every.filter(~F.col("base_failed"))

    names = [f"x{i}" for i in range(P)]
    middle = saved(good.agg(F.array(*[F.percentile(c, F.lit(0.5)) for c in names]).alias("centre")))
    if middle.first()["centre"][0] is None:
        return every.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.lit(None).cast("double").alias("distance"), (~F.col("base_failed")).alias("kept"))
    whole = good.withColumn("grp", F.lit(""))
    at = middle.select(F.lit("").alias("of"), "centre")
    off = [F.percentile(F.abs(F.col(c) - F.col("centre")[i]), F.lit(0.5)) for i, c in enumerate(names)]
    spread = whole.join(at, F.col("grp") == F.col("of")).agg(F.array(*off).alias("mad"))
    variance = [F.pow(F.col("mad")[i] * 1.4826, 2.0) + float((FLOOR[i] * UNIT) ** 2) for i in range(P)]
    diagonal = F.array(*[(1.0 / variance[i] if i == j else F.lit(0.0)) for i, j in PAIRS])
    start = saved(spread.select(F.lit("").alias("at"), diagonal.alias("inverse")).join(at, F.col("at") == F.col("of")).select("of", "centre", "inverse"))
    scale = consistency()
    general, moments = concentrated(whole, start, scale, None)
    row = moments.select(*MOMENTS).first()
    lent = np.array([float(v) for v in row]) * (BORROWED / float(row["n"]))

    begin = good.select(F.col("own").alias("of")).distinct().join(general.select("centre", "inverse"))  # one row of the whole table's
    model, _ = concentrated(good.withColumn("grp", F.col("own")), saved(begin), scale, lent)
    fallback = general.select(F.col("centre").alias("centre_"), F.col("inverse").alias("inverse_"))  # one row
    placed = every.drop("lang", "source").join(model, F.col("own") == F.col("of"), "left").join(fallback)
    placed = placed.withColumn("centre", F.coalesce("centre", "centre_")).withColumn("inverse", F.coalesce("inverse", "inverse_"))
    judged = placed.withColumn("distance", squared_distance("centre", "inverse"))
    inside = F.coalesce(F.col("distance") <= cutoff, F.lit(True))
    kept = ~F.col("base_failed") & inside
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", kept.alias("kept"))
