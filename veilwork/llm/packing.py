"""Packing by minimum bin slack over a histogram of remaining lengths.

Documents are cut at the window size; what remains of each is a piece shorter
than a window.  Only the *histogram* of piece lengths, at most ``window``
numbers whatever the corpus, reaches the driver.  There a bitset subset-sum
dynamic program picks, around the longest remaining length, the multiset of
remaining lengths that fills a window closest to capacity; its backtracked
counts form a pattern, and the pattern is used as often as the histogram
allows.  Executors then number the pieces of each length and read off pattern,
repetition and offset, so no task ever holds the pieces of one length.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import merge_table
from .shared import parts, saved

#: Pieces of one length are numbered in so many groups a shuffle partition.
SALTS_PER_PARTITION = 4


def closest_multiset(counts: dict[int, int], lengths: list[int], capacity: int) -> dict[int, int]:
    """Counts of lengths whose sum is the largest that ``capacity`` allows.

    ``lengths``: those to use, in falling order.  Bit s of a bitset tells
    whether the lengths so far can sum to s; the program stops once capacity
    itself is reached, and walks the stored bitsets back to the counts.
    """
    full = (1 << (capacity + 1)) - 1
    reach, steps = 1, []
    for length in lengths:
        if length > capacity:
            continue
        left, bundle = min(counts[length], capacity // length), 1
        while left and not reach >> capacity & 1:
            take = min(bundle, left)
            steps.append((length, take, reach))
            reach |= (reach << (take * length)) & full
            left, bundle = left - take, bundle * 2
        if reach >> capacity & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            total -= take * length
            used[length] = used.get(length, 0) + take
    return used


def min_slack_patterns(histogram: dict[int, int], window: int) -> list[tuple[dict[int, int], int]]:
    """(lengths and counts of a window, how many such windows) until nothing remains."""
    left = {n: k for n, k in histogram.items() if k > 0}
    order = sorted(left)
    out = []
    while order:
        longest = order[-1]
        left[longest] -= 1
        used = closest_multiset(left, [n for n in reversed(order) if left[n]], window - longest) if longest < window else {}
        left[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        times = min(left[n] // k for n, k in used.items())
        out.append((used, times))
        for n, k in used.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
                order.pop(bisect.bisect_left(order, n))
    return out


def slot_table(patterns: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """For each length and range of ranks: the first sequence, the offset and the pieces a window."""
    rows, used, sequence = [], {}, 0
    for pattern, times in patterns:
        offset = 0
        for n in sorted(pattern, reverse=True):
            rows.append((n, used.get(n, 0), sequence, offset, pattern[n]))
            used[n] = used.get(n, 0) + pattern[n] * times
            offset += n * pattern[n]
        sequence += times
    rows.sort()
    names = ("length", "from_rank", "sequence", "offset", "each")
    return {c: np.array([r[i] for r in rows], dtype=np.int64) for i, c in enumerate(names)}


def token_pieces(docs: DataFrame, vocab_path: str, window: int, end_id: int, keep_ids: bool) -> DataFrame:
    """Cut every document's ids, ``end_id`` last, at multiples of ``window``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = merge_table(vocab_path), int(end_id).to_bytes(4, "little")
        for batch in batches:
            for part in parts(batch, 1):
                rows = []
                for doc_id, raw in zip(part.column(0).to_pylist(), bpe.encode(part.column(1).to_pylist()), strict=True):
                    raw += end
                    total = len(raw) // 4
                    for start in range(0, total, window):
                        piece = raw[start * 4 : (start + window) * 4]
                        rows.append((doc_id, start, len(piece) // 4, zlib.crc32(piece), total, piece))
                cols = list(zip(*rows, strict=True))
                arrays = [pa.array(cols[0], batch.schema.field(0).type), *[pa.array(c, pa.int64()) for c in cols[1:5]]]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if keep_ids:
                    arrays.append(pa.array([np.frombuffer(p, "<u4").astype(np.int32) for p in cols[5]], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = f"doc_id {docs.schema[0].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long"
    return docs.mapInArrow(cut, schema + (", ids array<int>" if keep_ids else ""))


def pack_documents(
    docs: DataFrame, vocab_path: str, window: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False
) -> DataFrame:
    """Pack all documents into sequences of at most ``window`` tokens.

    Returns one row a piece: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset``, and the token ``ids`` with ``keep_ids``.  A null or
    empty text is its end token alone; null ids and repeated rows are packed
    like any other row; an empty table gives no sequences; other columns are
    not read.  Pieces of equal length are interchangeable; they are placed in
    the order of a hash and the id, so reruns agree.
    """
    spark = docs.sparkSession
    pieces = saved(token_pieces(docs.select(F.col(id_col).alias("doc_id"), text_col), vocab_path, window, end_id, keep_ids))
    salts = SALTS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)).cast("int")
    salted = pieces.withColumn("salt", salt)
    group = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = saved(
        salted.groupBy("length", "salt").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(group), F.lit(0)))
    )
    histogram = {r["length"]: r["k"] for r in before.groupBy("length").agg(F.sum("n").alias("k")).collect()}  # at most `window` rows
    slots = spark.sparkContext.broadcast(slot_table(min_slack_patterns(histogram, window)))
    ranked = salted.withColumn("nth", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = slots.value
        wide = int(t["from_rank"].max(initial=0)) + 1
        for pdf in batches:
            rank = (pdf["before"] + pdf["nth"] - 1).to_numpy(np.int64)
            length = pdf["length"].to_numpy(np.int64)
            if wide * (window + 1) < 2**62:
                at = np.searchsorted(t["length"] * wide + t["from_rank"], length * wide + np.minimum(rank, wide - 1), side="right") - 1
            else:  # lengths times ranks overflow: search each length by itself
                at = np.empty(len(rank), dtype=np.int64)
                for n in np.unique(length):
                    own = slice(*np.searchsorted(t["length"], [n, n + 1]))
                    at[length == n] = own.start + np.searchsorted(t["from_rank"][own], rank[length == n], side="right") - 1
            inside = rank - t["from_rank"][at]
            pdf["sequence_id"] = t["sequence"][at] + inside // t["each"][at]
            pdf["offset"] = t["offset"][at] + inside % t["each"][at] * length
            yield pdf.drop(columns=["before", "nth"])

    with_before = ranked.join(before.select("length", "salt", "before"), ["length", "salt"]).drop("salt")
    columns = [*pieces.columns, "before", "nth"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return with_before.select(*columns).mapInPandas(place, schema)


def assemble(pieces: DataFrame) -> DataFrame:
    """The packed sequences themselves: ``sequence_id`` and its ``input_ids``; needs ``keep_ids``.

    A sequence holds at most a window of tokens, so each group is bounded.
    """
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.flatten(F.transform(ordered, lambda p: p["ids"])).alias("input_ids"))
