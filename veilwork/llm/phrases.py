"""Collocations by contiguous pattern growth in the manner of PrefixSpan.

Words are counted once over everything.  A filter of the frequent words, then
one of the frequent pairs, thins the texts to windows that may begin a frequent
phrase: the occurrences of their first word, each pointing at the words that
follow.  Equal windows are summed before they are shuffled, so an occurrence
pointer carries a weight.  All windows of a first word meet in one task, which
grows the prefix to the right, depth first: pointers are parted by the next
word, and parts that are frequent are grown on.  A first word with very many
windows is not held in a task: it is counted by a sum, and its frequent
extensions become prefixes of their own.

Filters only ever let more through, so counts are exact.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import filter_bits, has_key, parts, saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes that part pieces become this one, which no text in UTF-8 has; space and tab part words.
STOP = b"\xff"
_TABLE = bytes.maketrans((UPPER + ".,;:!?\n\x0b\x0c\r").encode(), LOWER.encode() + STOP * 10)
#: Bytes of text that a task takes apart at a time, and those whose words it counts together.
TEXT_BYTES, BLOCK_BYTES = 1_000_000, 8_000_000
#: Rows that a task hands on at a time.
ROWS = 50_000
#: Windows of one prefix that a task holds; a prefix with more is counted by sums.
HELD = 200_000
#: Windows of a task, about.
LOT = 100_000


def language(lang: Column) -> Column:
    return F.coalesce(lang.cast("string"), F.lit("und"))


def tokens(texts: list[str | None]) -> list[bytes]:
    """Words of all texts in a row, with ``STOP`` between pieces."""
    raw = STOP.join([(t or "").encode("utf-8", "surrogatepass") for t in texts])
    return raw.translate(_TABLE).replace(STOP, b" \xff ").split()


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes], lang: str) -> np.ndarray:
    """Hashes of words within their language."""
    seed = xxhash.xxh3_64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, list[bytes]]]:
    """The words of ``lang, text`` by number, with ``STOP`` (0) after each text's last, and the words themselves: a language of ``BLOCK_BYTES`` of text at a time."""
    held: dict[str, tuple[defaultdict, list[np.ndarray]]] = {}
    size = 0

    def done() -> Iterator[tuple[str, np.ndarray, list[bytes]]]:
        for lang in list(held):
            number, codes = held.pop(lang)
            yield lang, np.concatenate(codes), list(number)

    for batch in batches:
        for part in parts(batch, 1, most=TEXT_BYTES):
            for lang, texts in by_language(part):
                if lang not in held:
                    held[lang] = defaultdict(count(1).__next__, {STOP: 0}), []  # a word that is not known gets the next number
                number, codes = held[lang]
                words = [*tokens(texts), STOP]
                codes.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
            size += part.column(1).nbytes
            if size >= BLOCK_BYTES:
                yield from done()
                size = 0
    yield from done()


def sliced(names: list[str], *arrays: pa.Array) -> Iterator[pa.RecordBatch]:
    """Columns as batches of ``ROWS``."""
    batch = pa.RecordBatch.from_arrays(list(arrays), names=names)
    for at in range(0, batch.num_rows, ROWS):
        yield batch.slice(at, ROWS)


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A key of two words that follow each other, from their hashes."""
    with np.errstate(over="ignore"):
        return mixed(a * np.uint64(0x9E3779B97F4A7C15) + b).view(np.int64)


def by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, list[str | None]]]:
    """The texts of each language of a batch."""
    langs = np.array(batch.column(0).to_pylist(), dtype=object)
    texts = np.array([*batch.column(1).to_pylist(), None], dtype=object)[:-1]
    for lang in dict.fromkeys(langs.tolist()):
        yield lang, texts[langs == lang].tolist()


def word_key(lang: str, words: list[str]) -> np.ndarray:
    seed = xxhash.xxh3_64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"), seed) for w in words), np.uint64, len(words)).view(np.int64)


def word_keys(frequent: DataFrame) -> DataFrame:
    """``lang, word`` to ``key``, the hash by which texts ask for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, words in by_language(batch):
                yield pa.RecordBatch.from_arrays([pa.array(word_key(lang, words))], names=["key"])

    return frequent.select("lang", "word").mapInArrow(run, "key long")


def word_counts(rows: DataFrame) -> DataFrame:
    """``lang, word, f``; several rows a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, codes, words in blocks(batches):
            yield from sliced(["lang", "word", "f"], pa.array([lang] * (len(words) - 1), pa.string()), text_of(words), pa.array(np.bincount(codes, minlength=len(words))[1:], pa.int64()))

    return rows.mapInArrow(run, "lang string, word string, f long")


def text_of(words: list[bytes]) -> pa.Array:
    """The words without the first, ``STOP``."""
    return pa.array([w.decode("utf-8", "surrogatepass") for w in words[1:]], pa.string())


def distinct_rows(columns: list[np.ndarray], base: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of numbers below ``base`` and how often each occurs."""
    if base ** len(columns) < 2**63:
        key = columns[0]
        for c in columns[1:]:
            key = key * base + c
        key, n = np.unique(key, return_counts=True)
        out = []
        for _ in columns:
            key, last = np.divmod(key, base)
            out.append(last)
        return np.stack(out[::-1], axis=1), n
    return np.unique(np.stack(columns, axis=1), axis=0, return_counts=True)


def pair_counts(rows: DataFrame, bits: np.ndarray) -> DataFrame:
    """``key, n`` of pairs of words that may both be frequent; several rows a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, codes, words in blocks(batches):
            hashes = word_hashes(words, lang)
            usual = has_key(bits, hashes.view(np.int64))
            usual[0] = False
            good = usual[codes]
            at = np.flatnonzero(good[:-1] & good[1:])
            key, n = np.unique(pair_keys(hashes[codes[at]], hashes[codes[at + 1]]), return_counts=True)
            yield from sliced(["key", "n"], pa.array(key), pa.array(n, pa.int64()))

    return rows.mapInArrow(run, "key long, n long")


def windows(rows: DataFrame, bits: np.ndarray, longest: int) -> DataFrame:
    """``lang, words, n``: from each word on, as many words as pairs allow that may be frequent, at least two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, codes, words in blocks(batches):
            hashes = word_hashes(words, lang)
            goes_on = (codes[:-1] > 0) & (codes[1:] > 0)
            at = np.flatnonzero(goes_on)
            goes_on[at] = has_key(bits, pair_keys(hashes[codes[at]], hashes[codes[at + 1]]))
            at = np.flatnonzero(goes_on)
            rest, columns = np.ones(len(at), dtype=bool), [codes[at]]
            for k in range(1, longest):
                stop = at + k - 1
                rest = rest & (stop < len(goes_on)) & goes_on[np.minimum(stop, len(goes_on) - 1)]
                columns.append(np.where(rest, codes[np.minimum(at + k, len(codes) - 1)], 0))
            table, n = distinct_rows(columns, len(words))
            offset = np.concatenate([[0], np.cumsum((table > 0).sum(axis=1))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(offset, text_of(words).take(pa.array(table[table > 0] - 1)))
            yield from sliced(["lang", "words", "n"], pa.array([lang] * len(n), pa.string()), lists, pa.array(n, pa.int64()))

    return rows.mapInArrow(run, "lang string, words array<string>, n long")


def grown(words: list[list[str]], weight: list[int], pointers: list[int], depth: int, least: int) -> Iterator[tuple[int, int, int]]:
    """Frequent phrases below a prefix of ``depth`` words, depth first: (a pointer to one, its length, its count)."""
    follow: dict[str, list[int]] = {}
    for p in pointers:
        if len(words[p]) > depth:
            follow.setdefault(words[p][depth], []).append(p)
    for own in follow.values():
        n = sum([weight[p] for p in own])
        if n >= least:
            yield own[0], depth + 1, n
            yield from grown(words, weight, own, depth + 1, least)


def grow_prefixes(held: DataFrame, depth: int, least: int) -> DataFrame:
    """``lang, words, n`` of frequent phrases that begin with the first ``depth`` words of the windows; a task has all windows of a prefix."""

    def run(lot: pa.Table) -> pa.Table:
        lists = pa.concat_arrays(lot.column("words").chunks)
        flat, at = lists.values.to_pylist(), lists.offsets.to_pylist()
        lang, words, weight = lot.column("lang").to_pylist(), [flat[b:e] for b, e in zip(at, at[1:], strict=False)], lot.column("n").to_pylist()
        prefixes: dict[tuple, list[int]] = {}
        for p, w in enumerate(words):
            prefixes.setdefault((lang[p], *w[:depth]), []).append(p)
        out = [(lang[p], words[p][:size], n) for own in prefixes.values() for p, size, n in grown(words, weight, own, depth, least)]
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.table({"lang": pa.array(cols[0], pa.string()), "words": pa.array(cols[1], pa.list_(pa.string())), "n": pa.array(cols[2], pa.int64())})

    lots = max(1, -(-held.count() // LOT))
    prefix = F.slice("words", 1, depth)
    rows = held.withColumn("lot", F.pmod(F.xxhash64("lang", prefix), F.lit(lots)))
    return rows.groupBy("lot").applyInArrow(run, "lang string, words array<string>, n long")


def frequent_phrases(projected: DataFrame, longest: int, least: int, most: int = HELD) -> DataFrame:
    """``lang, words, n``: all phrases of two words or more with ``least`` occurrences, from their windows."""
    found, now = [], projected
    for depth in range(1, longest):
        prefix = F.slice("words", 1, depth).alias("prefix")
        large = saved(now.groupBy("lang", prefix).count().filter(F.col("count") > most).select("lang", "prefix"))
        if large.isEmpty():
            return _union([*found, grow_prefixes(now, depth, least)])
        keyed = now.withColumn("prefix", F.slice("words", 1, depth))
        found.append(grow_prefixes(keyed.join(large, ["lang", "prefix"], "left_anti").drop("prefix"), depth, least))
        # the next words of large prefixes are counted by sums, which Spark can begin before it shuffles
        now = saved(keyed.join(large, ["lang", "prefix"], "left_semi").drop("prefix").filter(F.size("words") > depth))
        longer = F.slice("words", 1, depth + 1).alias("words")
        sums = saved(now.groupBy("lang", longer).agg(F.sum("n").alias("n")).filter(F.col("n") >= least))
        found.append(sums)
        now = now.filter(F.size("words") > depth + 1)
    return _union(found)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0].select("lang", "words", "n")
    for f in frames[1:]:
        out = out.unionByName(f.select("lang", "words", "n"))
    return out


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, covered: int = 50, first: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The ``first`` phrases of each language by how much more often they occur than their parts would let expect.

    A phrase of two to ``longest`` words with ``a`` occurrences within pieces,
    ``least`` or more, is cut where ``a * a / (l * r)`` is least, ``l`` and ``r``
    being the occurrences of both parts.  A phrase inside a longer one that has
    ``covered`` percent of its occurrences goes.  Returns ``lang, rank, phrase,
    a, l, r, n`` (words of the language) and ``score`` (millionths).  A null text
    is empty, a null language ``und``; repeated rows count each; ties go to more
    occurrences, then to the phrase of lesser bytes; an empty table gives an
    empty one; other columns are not read.
    """
    rows = docs.select(language(F.col(f"`{lang_col}`")).alias("lang"), F.col(f"`{text_col}`").alias("text"))
    vocabulary = saved(word_counts(rows).groupBy("lang", "word").agg(F.sum("f").alias("f")))
    sizes = vocabulary.groupBy("lang").agg(F.sum("f").alias("n"))
    usual = saved(vocabulary.filter(F.col("f") >= least))
    words = filter_bits(word_keys(usual), usual.count())
    pairs = saved(pair_counts(rows, words).groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("key"))
    projected = windows(rows, filter_bits(pairs, pairs.count()), longest)
    projected = saved(projected.groupBy("lang", "words").agg(F.sum("n").alias("n")))
    frequent = saved(frequent_phrases(projected, longest, least).select("lang", "words", F.array_join("words", " ").alias("phrase"), F.col("n").alias("a")))

    parts_ = saved(usual.select("lang", F.col("word").alias("part"), "f").union(frequent.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))))
    cut = F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k")
    cuts = frequent.select("lang", "phrase", "words", "a", cut)
    join = lambda begin, size: F.array_join(F.slice("words", begin, size), " ")
    cuts = saved(cuts.select("lang", "phrase", "a", "k", join(F.lit(1), F.col("k")).alias("left"), join(F.col("k") + 1, F.size("words") - F.col("k")).alias("right")))
    side = lambda part, f: parts_.select("lang", F.col("part").alias(part), F.col("f").alias(f))
    with_left = saved(cuts.join(side("left", "l"), ["lang", "left"]))  # written, so that Spark can split the rows of a hot word
    scored = with_left.join(side("right", "r"), ["lang", "right"])
    score = F.expr("CAST(1000000 AS DECIMAL(38,0)) * (CAST(a AS DECIMAL(16,0)) * CAST(a AS DECIMAL(16,0))) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))")
    lowest = scored.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a")).alias("best"))

    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size("words") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.size("words") - m + 1), lambda b: F.array_join(F.slice("words", b, m), " "))))
    covers = frequent.filter(F.size("words") > 2).select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), F.col("a").alias("longer"))
    covers = covers.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = lowest.join(covers, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("best.a")))
    order = Window.partitionBy("lang").orderBy(F.col("best.score").desc(), F.col("best.a").desc(), F.col("phrase"))
    top = kept.select("lang", "phrase", "best", F.row_number().over(order).cast("long").alias("rank")).filter(F.col("rank") <= first)
    return top.join(sizes, "lang").select("lang", "rank", "phrase", "best.a", "best.l", "best.r", "n", "best.score")


ORACLE_SQL = """
  WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
  pieces AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')) AS p FROM t),
  w AS (SELECT lang, list_filter(string_split_regex(p, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
  each_ AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
  f AS (
    SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, m, count(*) AS a FROM each_, (VALUES (1), (2), (3)) s(m) WHERE i + m - 1 <= len(w) GROUP BY ALL),
  n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
  c AS (SELECT lang, phrase, m, a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND a >= 10),
  cuts AS (SELECT *, unnest(range(1, m)) AS k FROM c),
  scored AS (
    SELECT c.lang, c.phrase, c.a, k, l.a AS l, r.a AS r, CAST((CAST(1000000 AS HUGEINT) * c.a * c.a) // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score
    FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:k], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1:c.m], ' ')),
  lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
  inner_ AS (
    SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM c WHERE m = 3 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM c WHERE m = 3),
  covers AS (SELECT lang, phrase, max(a) AS longer FROM inner_ GROUP BY ALL),
  kept AS (SELECT s.* FROM lowest s LEFT JOIN covers o ON o.lang = s.lang AND o.phrase = s.phrase WHERE o.longer IS NULL OR 100 * o.longer < 50 * s.a),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
  SELECT r.lang, rank, phrase, a, l, r, n, score FROM ranked r JOIN n ON n.lang = r.lang WHERE rank <= 2000"""
