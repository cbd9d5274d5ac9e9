"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words in every contract of this subpackage (Java syntax).
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of a batch that a Python worker unpacks at a time, entries of what it remembers, and rows of a batch.
BATCH_BYTES, MEMORY, BATCH_ROWS = 1_000_000, 100_000, 2000

#: Words of 64 bits in a filter of keys, at least and at most (8 KB to 32 MB); between, 16 bits a key.
FILTER_LEAST, FILTER_MOST = 1 << 10, 1 << 22

_held: dict[str, dict] = {}


def memory(owner: str, most: int = MEMORY) -> dict:
    """What a Python worker remembers for one operator.

    Workers outlive stages: what another operator has left goes, and so does a
    memory of over ``most`` entries.  It only saves time, results are the same.
    """
    if owner not in _held or len(_held[owner]) > most:
        _held.clear()
        _held[owner] = {}
    return _held[owner]


def parts(batch: pa.RecordBatch, *at: int, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes in the columns ``at``, one row at least."""
    size = np.cumsum(sum(pc.fill_null(pc.binary_length(batch.column(i)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for i in at) + 1)
    begin = 0
    while begin < batch.num_rows:
        stop = int(np.searchsorted(size, (size[begin - 1] if begin else 0) + most, side="right"))
        stop = max(begin + 1, stop)
        yield batch.slice(begin, stop - begin)
        begin = stop


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Only a local session may leave it unset; it then gets a folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="veilwork-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    Lost executors cost nothing of what is written; the files go when the
    application ends.  Batches for Python are small meanwhile, as executors hold
    several at a time.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/veilwork/{uuid.uuid4().hex}"
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return spark.read.schema(df.schema).parquet(path)


def filter_words(n: int) -> int:
    """Words of 64 bits of a filter for ``n`` keys: 16 bits a key or more, a power of two, at most ``FILTER_MOST``."""
    return min(FILTER_MOST, max(FILTER_LEAST, 1 << max(0, n * 16 // 64 - 1).bit_length()))


def _filter_rows(keys: DataFrame, words: int, every: bool = False) -> DataFrame:
    """``word, set``: the words of a Bloom filter of the column ``key`` (long), those that are 0 only if ``every`` is asked for."""
    spots = keys.select(F.explode(F.array(*[F.pmod(k, F.lit(words * 64)) for k in (F.col("key"), _second(F.col("key")))])).alias("spot"))
    bits = spots.select(F.expr("spot div 64").alias("word"), F.expr("shiftleft(1L, CAST(spot % 64 AS INT))").alias("set"))
    if every:
        bits = bits.union(keys.sparkSession.range(words).select(F.col("id"), F.lit(0).cast("long")))
    return bits.groupBy("word").agg(F.bit_or("set").alias("set"))


def _second(key: Column) -> Column:
    """Other bits of a key for its second place in a filter."""
    return F.call_function("shiftrightunsigned", key, F.lit(27))


def key_filter(keys: DataFrame, n: int) -> DataFrame:
    """One row with ``bits``: a Bloom filter of ``n`` keys, the column ``key`` (long).

    It goes to the rows that are asked for instead of a join with all keys; it
    may let more through in error, but never leaves out a key.  Its size follows
    the number of keys up to ``FILTER_MOST``.
    """
    ordered = F.array_sort(F.collect_list(F.struct("word", "set")))
    return _filter_rows(keys, filter_words(n), every=True).agg(F.transform(ordered, lambda w: w["set"]).alias("bits"))  # a bounded number of words


def may_hold(bits: Column, key: Column) -> Column:
    """Whether a filter's ``bits`` have a key; true for all of its keys and a few others."""

    def one(k: Column) -> Column:
        spot = F.pmod(k, F.size(bits).cast("long") * 64)
        word = F.get(bits, F.shiftright(spot, 6).cast("int"))
        return F.call_function("shiftright", word, F.pmod(spot, F.lit(64)).cast("int")).bitwiseAND(F.lit(1).cast("long")) != 0

    return one(key) & one(_second(key))


def filter_bits(keys: DataFrame, n: int) -> np.ndarray:
    """The same filter as an array for tasks in Python; at most ``FILTER_MOST`` words reach the driver."""
    words = filter_words(n)
    found = _filter_rows(keys, words).toArrow()
    out = np.zeros(words, dtype=np.uint64)
    out[found.column("word").to_numpy()] = found.column("set").to_numpy().view(np.uint64)
    return out


def has_key(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys (64-bit integers) the filter may hold."""
    size = np.int64(len(bits) * 64)
    keep = np.ones(len(keys), dtype=bool)
    for k in (keys, (keys.view(np.uint64) >> np.uint64(27)).view(np.int64)):
        spot = (k % size).astype(np.uint64)  # as pmod: never negative
        keep &= (bits[spot >> np.uint64(6)] >> (spot & np.uint64(63))) & np.uint64(1) != 0
    return keep


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Words of a text as a long; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def conf_int(spark: SparkSession, key: str, default: int) -> int:
    return int(spark.conf.get(key, str(default)))
