"""Exact top-k search by multi-resolution segment statistics.

A vector is cut into segments, each described by its mean and deviation.  Of two
vectors, the squared distance is at least the sum over segments of their length
times the squared differences of means and of deviations.  With few segments the
bound is cheap and loose, with many it is close.  Each task keeps the best rows
of every query so far; a pair whose bound, coarse to fine, cannot reach them is
gone, and survivors are computed exactly.

Queries come in blocks of bounded size.  Each block goes to the tasks that scan
the candidates, which are neither copied nor shuffled; only a task's best rows
of each query are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import saved

#: Segments of each resolution, coarse to fine; those of fewer than two components are left out.
SEGMENTS = (1, 4, 16)
#: Queries of a block, and of what a task compares with a batch of candidates at once.
BLOCK, LOT = 8192, 256
#: Candidates of a batch.
BATCH = 1024
#: Numbers up to here are exact as doubles, and as 64-bit integers.
EXACT, LONG = 2.0**53, 2.0**63


def vectors(column: pa.Array, scale: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows whose vector takes part, by row number, and their scaled components."""
    lists = column.cast(pa.list_(pa.float64()))
    offset = lists.offsets.to_numpy()
    flat = lists.values.slice(offset[0], offset[-1] - offset[0]).to_numpy(zero_copy_only=False)
    offset = offset - offset[0]
    gone = lists.is_null().to_numpy(zero_copy_only=False).copy()
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.floor(flat * scale)
    bad = np.flatnonzero(~np.isfinite(scaled))  # null components come as NaN
    row_of_bad = np.searchsorted(offset, bad, side="right") - 1
    gone[row_of_bad[row_of_bad < len(gone)]] = True
    rows = np.flatnonzero(~gone)
    return rows, [scaled[offset[i] : offset[i + 1]] for i in rows]


def by_size(rows: np.ndarray, found: list[np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Row numbers and a matrix of vectors for each number of components."""
    size = np.array([len(v) for v in found], dtype=np.int64)
    return {int(d): (rows[size == d], np.array([found[i] for i in np.flatnonzero(size == d)]).reshape(-1 if d else int((size == 0).sum()), int(d))) for d in np.unique(size)}


def summary(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments, each times the root of the segment's length."""
    cut = np.linspace(0, x.shape[1], segments + 1).astype(np.int64)
    size = np.diff(cut)
    total = np.add.reduceat(x, cut[:-1], axis=1)
    mean = total / size
    apart = np.add.reduceat((x - np.repeat(mean, size, axis=1)) ** 2, cut[:-1], axis=1)
    return np.concatenate([mean * np.sqrt(size), np.sqrt(apart)], axis=1)


class Side:
    """Vectors of one size with their norms and their summaries, coarse to fine."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.norm = (x * x).sum(axis=1)
        self.levels = [summary(x, s) for s in SEGMENTS if 2 * s <= x.shape[1]]

    def at(self, rows: np.ndarray | slice) -> Side:
        out = object.__new__(Side)
        out.x, out.norm, out.levels = self.x[rows], self.norm[rows], [f[rows] for f in self.levels]
        return out


def products(a: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
    """Inner products of rows, exact; those beyond 64 bits become the largest or least long."""
    if most < EXACT:
        return np.einsum("ij,ij->i", a, b).astype(np.int64)
    if most < LONG:
        return np.einsum("ij,ij->i", a.astype(np.int64), b.astype(np.int64))
    whole = [sum(int(x) * int(y) for x, y in zip(u, v, strict=True)) for u, v in zip(a, b, strict=True)]
    return np.array([max(-(2**63), min(2**63 - 1, w)) for w in whole], dtype=np.int64)


def survivors(q: Side, c: Side, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose distance may be small enough for a score of ``least[q]``, by lower bounds coarse to fine."""
    slack = 1e-9 * (q.norm.max(initial=0) + c.norm.max(initial=0)) + 1e-6  # rounding only ever lets more through
    # a score of t is a squared distance of |q|^2 + |c|^2 - 2t
    room = lambda i, j: q.norm[i] + c.norm[j] - 2.0 * least[i] + slack
    i, j = np.divmod(np.arange(len(q.x) * len(c.x)), max(1, len(c.x)))
    if not np.isfinite(least).any():
        return i, j
    dense = True
    for f, g in zip(q.levels, c.levels, strict=True):
        if dense:
            lower = (f * f).sum(axis=1)[:, None] + (g * g).sum(axis=1)[None, :] - 2.0 * (f @ g.T)
            keep = lower.ravel()[i * len(g) + j] <= room(i, j)
        else:
            keep = ((f[i] - g[j]) ** 2).sum(axis=1) <= room(i, j)
        i, j = i[keep], j[keep]
        dense = 8 * len(i) > len(q.x) * len(c.x)  # few pairs are summed one by one
    return i, j


def best(query: np.ndarray, score: np.ndarray, key: np.ndarray, k: int) -> np.ndarray:
    """Which entries are among the ``k`` of highest score of their query, ties by ``key``."""
    order = np.lexsort((key, -score.astype(np.float64) if len(score) and np.abs(score.astype(np.float64)).max() < EXACT else ~score, query))
    own = query[order]
    first = np.searchsorted(own, own)
    return order[np.arange(len(order)) - first < k]


def scan(queries: dict[int, tuple[np.ndarray, np.ndarray]], scale: int, k: int):
    """What a task does: ``query`` (row of the block), ``vec_id``, ``score`` of its best candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = {d: (rows, Side(x)) for d, (rows, x) in queries.items()}
        none = np.empty(0, dtype=np.int64)
        held = {d: [(none, none, none)] * (-(-len(rows) // LOT)) for d, (rows, _) in sides.items()}
        for batch in batches:
            for b in range(0, batch.num_rows, BATCH):
                part = batch.slice(b, BATCH)
                ids = part.column(0)
                # null ids come last among ties
                keys = np.where(ids.is_null().to_numpy(zero_copy_only=False), np.iinfo(np.int64).max, ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
                for d, (at, x) in by_size(*vectors(part.column(1), scale)).items():
                    if d in sides:
                        rows, q = sides[d]
                        c = Side(x)
                        for lot in range(len(held[d])):
                            held[d][lot] = better(q.at(slice(lot * LOT, (lot + 1) * LOT)), c, keys[at], held[d][lot], k)
        for d, lots in held.items():
            for lot, (query, score, key) in enumerate(lots):
                out = [pa.array(sides[d][0][lot * LOT + query], pa.int64()), pa.array(key, pa.int64(), mask=key == np.iinfo(np.int64).max), pa.array(score, pa.int64())]
                yield pa.RecordBatch.from_arrays(out, names=["query", "vec_id", "score"])

    return run


def better(q: Side, c: Side, keys: np.ndarray, held: tuple[np.ndarray, np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best entries of some queries once a batch of candidates is seen."""
    query, score, key = held
    least = np.full(len(q.x), -np.inf)
    full = np.flatnonzero(np.bincount(query, minlength=len(q.x)) >= k)
    if len(full):
        low = np.full(len(q.x), np.iinfo(np.int64).max)
        np.minimum.at(low, query, score)
        least[full] = low[full]
    i, j = survivors(q, c, least)
    most = float(np.sqrt(q.norm.max(initial=0)) * np.sqrt(c.norm.max(initial=0))) * (1 + 1e-9)
    step = 1 << 18  # pairs whose vectors are laid side by side
    new = np.concatenate([products(q.x[i[s : s + step]], c.x[j[s : s + step]], most) for s in range(0, len(i), step)]) if len(i) else np.empty(0, np.int64)
    good = new >= least[i]
    query, score, key = np.concatenate([query, i[good]]), np.concatenate([score, new[good]]), np.concatenate([key, keys[j[good]]])
    keep = best(query, score, key, k)
    return query[keep], score[keep], key[keep]


def top_k(df: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows of highest inner product for each query row.

    A component x counts as ``floor(scale * x)``.  Candidates are all rows but
    the query's own with as many components; ties go to the smaller id, a null
    id last.  Vectors that are null or hold a null or non-finite component take
    no part.  Repeated ids are rows of their own, as queries and as candidates;
    a row alike in id and vector to a query counts as its own once.  Scores
    beyond 64 bits become the largest or least long.  An empty table gives an
    empty one; other columns are not read.
    """
    spark = df.sparkSession
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").alias("v"))
    asked = df.filter(is_query).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").alias("v"))
    asked = asked.filter(F.col("id").isNotNull() & F.col("v").isNotNull())
    n = asked.count()
    blocks = max(1, -(-n // BLOCK))
    written = saved(asked.repartition(blocks).withColumn("block", F.spark_partition_id()))  # rows are dealt out in turn, so blocks are of near size
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    done = []
    for block in range(blocks):
        own = written.filter(F.col("block") == block).select("id", "v").toArrow()  # bounded by the size of a block
        column = own.column("v").combine_chunks()
        found = by_size(*vectors(column, scale)) if len(column) else {}
        norms = {int(r): int(p) for at, x in found.values() for r, p in zip(at, products(x, x, float((x * x).sum(axis=1).max(initial=0))), strict=True)}
        ids = own.column("id").to_pylist()
        near = rows.mapInArrow(scan(found, scale, k + 1), "query long, vec_id long, score long")
        first = near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k + 1)
        known = spark.createDataFrame([(r, ids[r], p) for r, p in norms.items()], "query long, query_id long, own long")
        alike = (F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own"))
        # one entry of the query's own id and score is the query itself; those before it keep their place
        self_at = F.min(F.when(alike, F.col("place"))).over(Window.partitionBy("query"))
        named = first.join(known, "query").withColumn("self", self_at)
        named = named.filter(F.col("self").isNull() | (F.col("place") != F.col("self")))
        rank = (F.col("place") - F.when(F.col("place") > F.col("self"), 1).otherwise(0)).cast("int")
        ranked = named.select("query_id", rank.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
        done.append(ranked if blocks == 1 else saved(ranked))
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


ORACLE_SQL = """
  WITH v AS (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  each_ AS (SELECT r, vec_id, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM v),
  scored AS (
    SELECT q.r AS q, c.r AS c, any_value(q.vec_id) AS query_id, any_value(c.vec_id) AS vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
    FROM each_ q JOIN each_ c ON q.i = c.i AND q.r <> c.r WHERE q.vec_id % 50 = 0 GROUP BY q.r, c.r),
  ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
  SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""
