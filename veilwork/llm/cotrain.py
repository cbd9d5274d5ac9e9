"""A quality classifier by co-training of two views.

One classifier sees the text, another the page metadata (language, source,
length).  Both begin with the same labelled documents.  Each round they are
calibrated on labels held out for that, and each labels the documents of the
whole table of which it is most certain: in each class a share of all
unlabelled documents in proportion to the class's prior.  What one view labels,
the other learns: as means of feature vectors over cells of the table, so every
pseudo-label counts, whatever their number, and the fit stays bounded.  A
pseudo-label weighs as much as its view's calibrated certainty exceeds even
odds.  At the end the calibrated views are combined as independent evidence and
score every document.

Only the labelled part of the fit is a sample: at most ``max_labelled``
documents, those with the least hashes of their ids.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import memory, parts, saved

#: Hashed words, hashed word shapes and statistics of the text view.
WORD_DIMS, SHAPE_DIMS, STATS = 512, 256, 8
TEXT_DIMS = WORD_DIMS + SHAPE_DIMS + STATS
#: Hashed sources, hashed languages and steps of length, four an octave, of the metadata view.
SOURCE_DIMS, LANG_DIMS, LENGTH_DIMS = 64, 16, 96
META_DIMS = SOURCE_DIMS + LANG_DIMS + LENGTH_DIMS
#: What a byte of a stored text feature stands for.
SCALE = np.concatenate([np.full(WORD_DIMS + SHAPE_DIMS, 255.0), np.full(STATS, 64.0)])
#: Longer words are not remembered by a worker.
LONG_WORD = 64
ROUNDS = 3
#: Share of all unlabelled documents that a view labels, more each round, and what its pseudo-labels weigh against the labels.
GIVEN, WEIGHT = 0.05, 0.5
#: Cells of each class whose means a view learns from, and lanes in which partitions are added up.
CELLS, LANES = 16, 64
#: Steps of the log-odds by which thresholds are found, and the log-odds beyond which they are cut.
STEP, FAR = 64, 32
#: Columns that are read, and those that are added.
VIEW, NEW = ("doc_id", "text", "lang", "source", "n_chars"), ("p_text", "p_meta", "p_quality", "kept")
#: Labelled documents of each class without which nothing is learned.
LEAST = 20
#: Rows of the fit that are squared at a time.
FIT_ROWS = 256

_SHAPE = bytes(
    ord("A") if 65 <= b <= 90 else ord("a") if 97 <= b <= 122 or b >= 128 else ord("0") if 48 <= b <= 57 else b for b in range(256)
)


def _places(word: bytes) -> int:
    """In one number: where a word counts, where its shape does, two of its traits and a digest of it."""
    shape = word.translate(_SHAPE)
    short = bytes(c for i, c in enumerate(shape) if i == 0 or c != shape[i - 1])[:8]
    traits = 2 * word.endswith(b".") + (word in b"|-*#")
    place = (zlib.crc32(word.lower()) % WORD_DIMS * SHAPE_DIMS + zlib.crc32(short) % SHAPE_DIMS) * 4 + traits
    return zlib.crc32(word) * 2**24 + place


def text_view(text: str | None) -> np.ndarray:
    """The features of a whole text, as bytes."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    out = np.zeros(TEXT_DIMS, np.uint8)
    n = len(words)
    if not n:
        return out
    seen = memory("words of cotrain")
    kinds = set(words)
    fresh = {w: _places(w) for w in kinds if w not in seen}
    seen.update(fresh)
    code = np.fromiter(map(seen.__getitem__, words), np.int64, n)
    for w in fresh:
        if len(w) > LONG_WORD:
            del seen[w]
    at = code % 2**24
    word, shape = at // (4 * SHAPE_DIMS), at // 4 % SHAPE_DIMS
    for begin, dims, index in ((0, WORD_DIMS, word), (WORD_DIMS, SHAPE_DIMS, shape)):
        counts = np.log1p(np.bincount(index, minlength=dims))
        out[begin : begin + dims] = np.round(255 * counts / np.sqrt((counts * counts).sum()))
    lines = [x for x in text.split("\n") if x.strip()]
    stats = (
        math.log1p(n) / 8,
        len(kinds) / n,
        math.log1p(100 * sum(map(text.count, "#*$%&|<>")) / n) / 4,
        math.log1p(100 * int((code[1:] == code[:-1]).sum()) / n) / 4,
        math.log1p(100 * (len(lines) - len(set(lines))) / n) / 4,
        math.log1p(len(text) / n) / 2,
        math.log1p(100 * int((at & 2).astype(bool).sum()) / n) / 4,
        math.log1p(100 * int((at & 1).sum()) / n) / 4,
    )
    out[-STATS:] = [min(255, round(64 * s)) for s in stats]
    return out


def meta_view(lang: str | None, source: str | None, n_chars: int | None) -> bytes:
    """The places of a document's metadata among the features of its view; a null is a value of its own."""
    length = min(int(4 * math.log2(max(int(n_chars or 0), 0) + 1)), LENGTH_DIMS - 1)
    places = (zlib.crc32(repr(source).encode()) % SOURCE_DIMS, SOURCE_DIMS + zlib.crc32(repr(lang).encode()) % LANG_DIMS, SOURCE_DIMS + LANG_DIMS + length)
    return bytes(places)


def text_bytes(rows: list[bytes]) -> np.ndarray:
    """Stored features of texts, an eighth of the size of their numbers."""
    return np.frombuffer(b"".join(rows), np.uint8).reshape(-1, TEXT_DIMS)


def text_matrix(rows: list[bytes]) -> np.ndarray:
    return text_bytes(rows) / SCALE


def meta_matrix(rows: list[bytes]) -> np.ndarray:
    out = np.zeros((len(rows), META_DIMS))
    out[np.arange(len(rows))[:, None], np.frombuffer(b"".join(rows), np.uint8).reshape(-1, 3)] = 1
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def numbers(x: np.ndarray) -> np.ndarray:
    """What features stand for; those of texts are stored bytes."""
    return x / SCALE if x.dtype == np.uint8 else x


def design(x: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """The numbers of ``x``, the rows ``more`` below them and a last column of ones, written in place: the driver holds them once."""
    out = np.ones((len(x) + len(more), x.shape[1] + 1))
    np.divide(x, SCALE if x.dtype == np.uint8 else 1.0, out=out[: len(x), :-1])
    for row, values in zip(out[len(x) :], more, strict=True):
        row[:-1] = values
    return out


def fit(x: np.ndarray, y: np.ndarray, penalty: float, weight: np.ndarray | None = None, steps: int = 300) -> np.ndarray:
    """Weighted logistic regression on a ``design``, intercept last, by accelerated gradient descent."""
    weight = np.ones(len(y)) if weight is None else weight
    share = weight / weight.sum()
    w = look = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 0
    squares = np.concatenate([(b * b).sum(axis=1) for b in np.split(x, range(FIT_ROWS, len(x), FIT_ROWS))])
    rate = 1 / (0.25 * (share @ squares) + penalty)
    for k in range(steps):
        grad = x.T @ (share * (sigmoid(x @ look) - y)) + ridge * look
        new = look - rate * grad
        look, w = new + k / (k + 3) * (new - w), new
    return w


def scores(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


@dataclass
class View:
    """A classifier of one view: a regression, its calibration, and what the other view taught it."""

    weights: np.ndarray
    scale: np.ndarray  # Platt's: log-odds are scores times the first plus the second

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return scores(x, self.weights) * self.scale[0] + self.scale[1]


@dataclass
class Model:
    text: View
    meta: View
    prior: float
    threshold: float = 0.5
    #: By round: the pseudo-labels that each view got from the other, by class.
    given: list[dict] = field(default_factory=list)

    def judge(self, x_text: np.ndarray, x_meta: np.ndarray) -> np.ndarray:
        """Probabilities by the text, by the metadata, and by both as independent evidence."""
        a, b = self.text.log_odds(x_text), self.meta.log_odds(x_meta)
        return np.round(np.stack([sigmoid(a), sigmoid(b), sigmoid(a + b - self.prior)], axis=1), 9)  # sums differ in their last bits by batch


def stored_views(docs: DataFrame, view: list[str]) -> DataFrame:
    """``id, text, meta``: the features of every row in about 800 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 1):
                cols = [c.to_pylist() for c in part.columns[1:]]
                text, meta = [text_view(t).tobytes() for t in cols[0]], [meta_view(*m) for m in zip(*cols[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(text, pa.binary()), pa.array(meta, pa.binary())], names=["id", "text", "meta"])

    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(view)])
    return rows.mapInArrow(run, f"id {rows.schema[0].dataType.simpleString()}, text binary, meta binary")


def _steps(log_odds: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(log_odds, -FAR, FAR) * STEP).astype(np.int64)


def thresholds(pool: DataFrame, model: Model, share: float) -> dict[str, tuple[int, int]]:
    """For each view, the steps of its log-odds from which on it labels 1, and up to which it labels 0.

    The counts of all rows by step tell where the most certain ``share`` of them
    begin, parted among the classes by the prior.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 0):
                a, b = _steps(model.text.log_odds(text_matrix(part.column(0).to_pylist()))), _steps(model.meta.log_odds(meta_matrix(part.column(1).to_pylist())))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["text", "meta"])

    steps = pool.select("text", "meta").mapInArrow(run, "text long, meta long")
    each = steps.select(F.explode(F.array(*[F.struct(F.lit(v).alias("view"), F.col(v).alias("step")) for v in ("text", "meta")])).alias("x"))
    counts = each.groupBy("x.view", "x.step").count().toPandas()  # at most 2 * 2 * FAR * STEP rows
    out, good = {}, float(sigmoid(np.array(model.prior)))
    for view, own in counts.sort_values("step").groupby("view"):
        step, n = own["step"].to_numpy(), own["count"].to_numpy()
        high = step[::-1][min(np.searchsorted(np.cumsum(n[::-1]), share * good * n.sum()), len(n) - 1)]
        low = step[min(np.searchsorted(np.cumsum(n), share * (1 - good) * n.sum()), len(n) - 1)]
        out[view] = (int(high), int(low) if low < high else int(high) - 1)
    return out


def pseudo_labels(pool: DataFrame, model: Model, at: dict[str, tuple[int, int]]) -> pd.DataFrame:
    """What each view teaches the other: ``to, label, cell, n, certain, mean``.

    A row stands for the ``n`` documents of a cell (a digest of their features)
    that get a label: the mean of their features and of the certainty.
    """
    views = {"text": (model.text, text_matrix, TEXT_DIMS), "meta": (model.meta, meta_matrix, META_DIMS)}
    schema = "to string, label int, cell int, lane int, n long, certain double, total array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        held: dict[tuple, list] = {}
        for batch in batches:
            for part in parts(batch, 0):
                x = {v: views[v][1](part.column(i).to_pylist()) for i, v in enumerate(views)}
                cell = np.array([zlib.crc32(t.as_py()) % CELLS for t in part.column(0)])
                for by, to in (("text", "meta"), ("meta", "text")):
                    odds = views[by][0].log_odds(x[by])
                    step = _steps(odds)
                    for label, chosen in ((1, step >= at[by][0]), (0, step <= at[by][1])):
                        sure = sigmoid(odds if label else -odds)
                        for c in np.unique(cell[chosen]):
                            rows = chosen & (cell == c)
                            own = held.setdefault((to, label, int(c)), [0, 0.0, np.zeros(views[to][2])])
                            own[0] += int(rows.sum())
                            own[1] += float(np.round(sure[rows], 6).sum())
                            own[2] += x[to][rows].sum(axis=0)
        lane = TaskContext.get().partitionId() % LANES
        cols = list(zip(*[(*k, lane, *v) for k, v in held.items()], strict=True)) or [[] for _ in range(7)]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["to", "label", "cell", "lane", "n", "certain", "total"])

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        one = pdf.iloc[:1].copy()
        one["n"], one["certain"] = pdf["n"].sum(), pdf["certain"].sum()
        one["total"] = [np.sum(np.stack(list(pdf["total"])), axis=0)]
        return one

    # a partition gives a row a cell; they are added in lanes first, so no group grows with all of them
    sums = pool.select("text", "meta").mapInArrow(run, schema)
    sums = sums.groupBy("to", "label", "cell", "lane").applyInPandas(added, schema).groupBy("to", "label", "cell").applyInPandas(added, schema)
    found = sums.toPandas().sort_values(["to", "label", "cell"], ignore_index=True)  # at most 4 * CELLS rows
    found["mean"] = [np.array(t) / n for t, n in zip(found["total"], found["n"], strict=True)]
    found["certain"] = found["certain"] / found["n"]
    return found


def co_train(x_text: np.ndarray, x_meta: np.ndarray, y: np.ndarray, pool: DataFrame | None, keep_share: float, rounds: int = ROUNDS) -> Model:
    """Fit both views; of five labelled rows three teach, one calibrates and one sets the threshold.

    ``x_text`` are stored bytes; only the rows of one fit at a time become numbers.
    """
    turn = np.arange(len(y)) % 5
    train, check, last = turn < 3, turn == 3, turn == 4
    prior = float(np.log(y.sum() / (len(y) - y.sum())))
    taught = pd.DataFrame({"to": [], "label": [], "n": [], "certain": [], "mean": []})
    given = []

    def fitted(name: str, x: np.ndarray) -> View:
        own = taught[taught["to"] == name]
        labels, weight = y[train], np.ones(train.sum())
        if len(own):
            certain = np.maximum(2 * own["certain"].to_numpy(float) - 1, 0)
            n = own["n"].to_numpy(float)
            labels = np.concatenate([labels, own["label"].to_numpy(float)])
            weight = np.concatenate([weight, WEIGHT * train.sum() * certain * n / n.sum()])
        w = fit(design(x[train], *own["mean"]), labels, 1e-4, weight)
        return View(w, fit(design(scores(numbers(x[check]), w)[:, None]), y[check], 1e-3))

    for k in range(rounds + 1):
        model = Model(fitted("text", x_text), fitted("meta", x_meta), prior, given=given)
        if k == rounds or pool is None:
            break
        taught = pseudo_labels(pool, model, thresholds(pool, model, GIVEN * (k + 1)))
        given.append({(to, int(label)): int(n) for (to, label), n in taught.groupby(["to", "label"])["n"].sum().items()})
    good = np.sort(model.judge(numbers(x_text[last & (y == 1)]), x_meta[last & (y == 1)])[:, 2])
    # a document is rejected only below what nearly all good documents reach, and never above even odds
    model.threshold = min(0.5, float(good[int((1 - keep_share) * len(good))])) if len(good) else 0.0
    return model


def trained(stored: DataFrame, labels: DataFrame, id_col: str, label_col: str, max_labelled: int, keep_share: float, rounds: int) -> Model | None:
    """The model for stored views, or None without ``LEAST`` labelled documents of each class."""
    told = labels.groupBy(F.col(f"`{id_col}`").alias("told_id")).agg(F.min(label_col).cast("int").alias("label")).filter("told_id is not null and label is not null")
    ids = stored.select(F.col("id").alias("told_id")).filter("told_id is not null").distinct()
    marked = saved(told.join(ids, "told_id", "left_semi").orderBy(F.xxhash64("told_id"), "told_id").limit(max_labelled))
    sample = stored.join(marked, F.col("id") == F.col("told_id")).groupBy("id", "label").agg(F.min(F.struct("text", "meta")).alias("v")).select("id", "label", "v.*")
    found = sample.toPandas()  # at most max_labelled rows of 800 bytes
    found = found.sort_values("id", key=lambda s: s.map(lambda v: zlib.crc32(repr(v).encode())), kind="stable")
    y = found["label"].to_numpy(float)
    if min((y == 0).sum(), (y == 1).sum()) < LEAST:
        return None
    pool = stored.join(marked, F.col("id") == F.col("told_id"), "left_anti")
    return co_train(text_bytes(list(found["text"])), meta_matrix(list(found["meta"])), y, None if pool.isEmpty() else pool, keep_share, rounds)


def decisions(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_labelled: int = 5000, keep_share: float = 0.995, rounds: int = ROUNDS, view: tuple[str, ...] = VIEW) -> DataFrame:
    """``id, p_text, p_meta, p_quality, kept`` of every row, as ``classify`` judges it, without its other columns.

    The text is read once: scores come from the features that training has stored.
    """
    stored = saved(stored_views(docs, list(view)))
    model = trained(stored, labels, view[0], label_col, max_labelled, keep_share, rounds)
    if model is None:
        nothing = F.lit(None).cast("double")
        return stored.select("id", nothing.alias("p_text"), nothing.alias("p_meta"), nothing.alias("p_quality"), F.lit(True).alias("kept"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 1):
                p = model.judge(text_matrix(part.column(1).to_pylist()), meta_matrix(part.column(2).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(p[:, k]) for k in range(3)], pa.array(p[:, 2] >= model.threshold)], names=["id", *NEW])

    return stored.mapInArrow(score, f"id {stored.schema['id'].dataType.simpleString()}, p_text double, p_meta double, p_quality double, kept boolean")


def classify(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "quality",
    max_labelled: int = 5000,
    keep_share: float = 0.995,
    rounds: int = ROUNDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    length_col: str = "n_chars",
) -> DataFrame:
    """Score every document and decide whether it is kept.

    Adds ``p_text, p_meta, p_quality`` (double) and ``kept`` (boolean) to all
    columns of ``docs``; existing columns of these names are replaced.  Labels
    are 0 or 1; of several labels of an id the least counts, of several rows of
    a labelled id those features that sort first; null labels and ids teach
    nothing.  A document is rejected below even odds if nearly all
    (``keep_share``) good held-out documents score higher.  With fewer than 20
    labelled documents of a class nothing can be learned: scores are null and
    all is kept.  Null texts and metadata have features of their own; repeated
    rows score alike; an empty table gives an empty one.
    """
    kept = docs.drop(*NEW)
    view = [id_col, text_col, lang_col, source_col, length_col]
    model = trained(saved(stored_views(docs, view)), labels, id_col, label_col, max_labelled, keep_share, rounds)
    if model is None:
        nothing = F.lit(None).cast("double")
        return kept.withColumns({"p_text": nothing, "p_meta": nothing, "p_quality": nothing, "kept": F.lit(True)})

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.schema.names
            at = [columns.index(c) for c in view[1:]]
            for part in parts(batch, at[0]):
                text, *meta = [part.column(i).to_pylist() for i in at]
                x_text, x_meta = text_matrix([text_view(t).tobytes() for t in text]), meta_matrix([meta_view(*m) for m in zip(*meta, strict=True)])
                p = model.judge(x_text, x_meta)
                extra = [pa.array(p[:, k]) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*part.columns, *extra, pa.array(p[:, 2] >= model.threshold)], names=[*columns, *NEW])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + ["p_text double, p_meta double, p_quality double, kept boolean"])
    return kept.mapInArrow(score, schema)
