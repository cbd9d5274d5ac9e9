"""Near-duplicate detection by one-permutation MinHash.

One hash of every shingle fills all bins: its upper bits choose the bin, the
least value of a bin is kept, and empty bins borrow from others by the optimal
densification.  Bands of bins make buckets; each bucket proposes a star, its
least text against each other, so candidates grow with the bucket and not its
square.  Candidates are confirmed on full shingle sets.  The texts of buckets
that do not end in one component meet once more, so that every pair that shares
a band is tried or connected: in an inverted index of each text's rarest
shingles, as many as one of two similar texts must share.  All pairs of different
components that fit are confirmed once they are few beside the index; until then
each of its shingles proposes a star with a centre of its own.

Texts of equal words are one class, named by a digest of its words.  All search
is over classes; rows come back in only at the end, so copies cost one row each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import key_filter, may_hold, memory, parts, saved

#: Bands and bins of each: a pair at 0.8 misses all of them once in 15,000 times.
BANDS, ROWS = 32, 6
BINS = BANDS * ROWS
#: Pairs for each row of the index of rare shingles that are made without more stars.
PAIRS_A_ROW = 2
#: Stars go on while a round leaves at most this share of the components apart.
WORTH = 0.9
#: Columns of 64 parities of a set's hashes; sets that differ in more parities than similar ones may differ in hashes are not similar.
PARITIES = [f"p{i}" for i in range(8)]
#: Bytes at most of the table that tells common shingles from rare ones.
COUNTERS = 1 << 22
#: Longer words are not remembered by a worker.
LONG_WORD = 64


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser with good avalanche."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word, A-Z in lower case."""
    seen = memory("words of near_dup")
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # both know ASCII alone
    own = {w: xxhash.xxh3_64_intdigest(w) for w in set(words) if w not in seen}
    seen.update((w, h) for w, h in own.items() if len(w) <= LONG_WORD)
    get = seen.__getitem__ if all(len(w) <= LONG_WORD for w in own) else lambda w: own[w] if w in own else seen[w]
    return np.fromiter(map(get, words), dtype=np.uint64, count=len(words))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``size`` words; of all words if there are fewer."""
    if not len(words):
        return words
    size = min(size, len(words))
    out = np.zeros(len(words) - size + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - size + 1 + k] + np.uint64(k + 1))
    return np.unique(out)


def probes(bins: int) -> np.ndarray:
    """For each bin, the order in which it asks others when it is empty."""
    rng = np.random.Generator(np.random.PCG64(20_17))
    return rng.integers(0, bins, size=(bins, 4 * bins))


_PROBES = probes(BINS)
_EDGES = ((np.arange(BINS + 1, dtype=object) * 2**64) // BINS)[:BINS].astype(np.uint64)


def signature(hashes: np.ndarray) -> np.ndarray:
    """One-permutation MinHash of sorted hashes, with optimal densification."""
    at = np.searchsorted(hashes, _EDGES)
    stop = np.append(at[1:], len(hashes))
    full = at < stop
    out = hashes[np.minimum(at, len(hashes) - 1)]
    if not full.all():
        empty = np.flatnonzero(~full)
        asked = full[_PROBES[empty]]
        first = asked.argmax(axis=1)
        donor = _PROBES[empty, first]
        lost = ~asked[np.arange(len(empty)), first]  # all probes were empty: the first full bin lends
        donor[lost] = np.flatnonzero(full)[0]
        out[empty] = out[donor]
    return out


def band_keys(hashes: np.ndarray) -> np.ndarray:
    sig = signature(hashes).reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, k])
    return key.view(np.int64)


def features(rows: DataFrame, shingle: int) -> DataFrame:
    """``id, tag, text`` to ``id, tag, n_shingles``, the digest ``same`` of the words and the band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 2):
                n, same, keys = [], [], []
                for text in part.column(2).to_pylist():
                    words = word_hashes(text)
                    own = shingles(words, shingle)
                    n.append(len(own))
                    same.append(xxhash.xxh3_128_digest(words.tobytes()) if len(own) else None)
                    keys.append(band_keys(own) if len(own) else None)
                arrays = [*part.columns[:2], pa.array(n, pa.int64()), pa.array(same, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "tag", "n_shingles", "same", "bands"])

    return rows.mapInArrow(run, f"id {rows.schema[0].dataType.simpleString()}, tag string, n_shingles long, same binary, bands array<long>")


def shingle_sets(rows: DataFrame, shingle: int) -> DataFrame:
    """``text`` to ``same, size, hashes``: the sorted hashes of its shingles as unsigned 64-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 0):
                words = [word_hashes(text) for text in part.column(0).to_pylist()]
                own = [shingles(w, shingle) for w in words]
                same = [xxhash.xxh3_128_digest(w.tobytes()) for w in words]
                arrays = [pa.array(same, pa.binary()), pa.array(map(len, own), pa.int64()), pa.array([x.tobytes() for x in own], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["same", "size", "hashes"])

    return rows.select("text").mapInArrow(run, "same binary, size long, hashes binary")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets share ``percent`` of their union; empty ones are like nothing."""
    if not len(a) or not len(b):
        return False
    common = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
    return common > 0 and 100 * common >= percent * (len(a) + len(b) - common)


def among(rows: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """The ``rows`` whose ``key`` (long) is in the column ``key`` of ``keys``, and a few others, told by a filter without a shuffle of ``rows``."""
    bits = saved(key_filter(keys, keys.count())).scalar()
    return rows.filter(may_hold(bits, key))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` of classes whose full shingle sets are similar enough.

    Both joins are of tables as they are, so Spark can split the pairs of a hot
    class among tasks.  Only the sets of classes with pairs are shuffled.
    """
    ends = pairs.select(F.explode(F.array(F.xxhash64("a"), F.xxhash64("b"))).alias("key"))
    sets = among(sets, F.xxhash64("same"), ends)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 2, 3):
                left, right = part.column(2), part.column(3)
                set_of = lambda c, i: np.frombuffer(c[i].as_buffer(), np.uint64)
                keep = [similar(set_of(left, i), set_of(right, i), percent) for i in range(part.num_rows)]
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    set_a = sets.select(F.col("same").alias("a"), F.col("hashes").alias("set_a"))
    set_b = sets.select(F.col("same").alias("b"), F.col("hashes").alias("set_b"))
    both = pairs.select("a", "b").join(set_b, "b").join(set_a, "a")
    return both.select("a", "b", "set_a", "set_b").mapInArrow(run, "a binary, b binary")


def commonness(sets: DataFrame, total: int) -> np.ndarray:
    """For hashes by their low bits, how common they are: 0 for one occurrence at most, then the logarithm of the count.

    The table follows the ``total`` number of hashes up to ``COUNTERS`` bytes; a
    fuller one only orders hashes less well.
    """
    size = min(COUNTERS, 1 << max(10, int(total).bit_length() + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 0):
                own = np.frombuffer(b"".join(part.column(0).to_pylist()), np.uint64)
                spot, n = np.unique((own & np.uint64(size - 1)).astype(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(spot), pa.array(n, pa.int64())], names=["spot", "n"])

    counts = sets.select("hashes").mapInArrow(run, "spot long, n long").groupBy("spot").agg(F.sum("n").alias("n"))
    # COUNTERS rows of 5 bytes at most
    found = counts.filter("n > 1").select(F.col("spot").cast("int").alias("spot"), F.ceil(F.log2("n")).cast("tinyint").alias("n")).toArrow()
    out = np.zeros(size, dtype=np.uint8)
    out[found.column("spot").to_numpy()] = found.column("n").to_numpy()
    return out


def parities(hashes: np.ndarray) -> np.ndarray:
    """Whether an even or odd number of hashes is in each of equal ranges, as the bits of ``PARITIES``."""
    shift = np.uint64(64 - (64 * len(PARITIES)).bit_length() + 1)
    odd = np.bincount((hashes >> shift).astype(np.int64), minlength=64 * len(PARITIES)) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def prefixes(active: DataFrame, common: np.ndarray, percent: int) -> DataFrame:
    """``token, same, component, n, at, parity``: the rarest hashes of each set, as many as one of two similar sets must share.

    A set that shares ``percent`` of the union shares that share of its own
    hashes, so of the others plus one, taken in any order that holds for all
    sets, one is shared.  Hashes that occur once are passed over.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 2):
                tokens, place, size, odd = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [], []
                for raw in part.column(2).to_pylist():
                    own = np.frombuffer(raw, np.uint64)
                    weight = common[(own & np.uint64(len(common) - 1)).astype(np.int64)]
                    most = len(own) - -(-len(own) * percent // 100) + 1
                    order = np.argsort(weight, kind="stable")[:most]  # ties by hash, as sets are sorted
                    at = np.flatnonzero(weight[order] > 0)
                    tokens.append(own[order[at]])
                    place.append(at)
                    size.append(len(at))
                    odd.append(parities(own))
                row = pa.array(np.repeat(np.arange(part.num_rows), size))
                token = pa.array(np.concatenate(tokens).view(np.int64))
                parity = pa.StructArray.from_arrays([pa.array(c) for c in np.array(odd, np.int64).reshape(-1, len(PARITIES)).T], PARITIES)
                arrays = [token, *[part.column(i).take(row) for i in (0, 1, 3)], pa.array(np.concatenate(place).astype(np.int32)), parity.take(row)]
                yield pa.RecordBatch.from_arrays(arrays, names=["token", "same", "component", "n", "at", "parity"])

    return active.select("same", "component", "hashes", F.col("size").cast("int").alias("n")).mapInArrow(run, f"token long, same binary, component binary, n int, at int, parity struct<{', '.join(f'{c}: long' for c in PARITIES)}>")


def rare_index(active: DataFrame, percent: int) -> DataFrame:
    """The inverted index ``token, same, component, n, at, parity`` of ``active`` (``same, component, size, hashes``).

    Pages that share a template alone do not meet in it, as what they share is
    common and comes last.
    """
    total = active.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    return saved(prefixes(active, commonness(active, total), percent))


def may_fit(n_a: Column, n_b: Column, room_a: Column, room_b: Column, percent: int) -> Column:
    """Whether sets of these sizes may be similar enough, if they share no hash before a place that leaves them this room."""
    return ((100 + percent) * F.least(room_a, room_b) >= percent * (n_a + n_b)) & (100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b))


def may_agree(n_a: Column, n_b: Column, a: Column, b: Column, percent: int) -> Column:
    """Whether sets of these sizes and parities may be similar enough: each parity that differs is a hash that only one has."""
    apart = reduce(add, [F.bit_count(a[c].bitwiseXOR(b[c])) for c in PARITIES])
    return (100 + percent) * apart <= (100 - percent) * (n_a + n_b)


def mixed_tokens(index: DataFrame, salt: int) -> DataFrame:
    """Rows of tokens with several components, and few others (other ones for each ``salt``): the filter of tokens may let more through."""
    own = F.xxhash64("component")
    found = saved(index.groupBy("token").agg(F.min(own).alias("low"), F.max(own).alias("high")).filter("low < high").select(F.xxhash64("token", F.lit(salt)).alias("key")))
    return saved(among(index, F.xxhash64("token", F.lit(salt)), found))


def star_pairs(index: DataFrame, percent: int, salt: int) -> DataFrame:
    """``a, b``: each class with the centre of each token, one of its classes by a salted hash, if they may fit and their components differ."""
    centre = F.min(F.struct(F.xxhash64("same", "token", F.lit(salt)).alias("draw"), "same", "component", "n", "at", "parity")).alias("centre")
    # centres are written before they are joined, so that Spark can split the rows of a hot token
    index = index.join(saved(index.groupBy("token").agg(centre)), "token")
    own, hub = F.col, lambda c: F.col(f"centre.{c}")
    fits = may_fit(own("n"), hub("n"), own("n") - own("at"), hub("n") - hub("at"), percent)
    found = index.filter((own("component") != hub("component")) & fits & may_agree(own("n"), hub("n"), own("parity"), hub("parity"), percent))
    return found.select(F.least("same", "centre.same").alias("a"), F.greatest("same", "centre.same").alias("b")).distinct()


def size_step(n: Column, percent: int) -> Column:
    """Sizes in steps; sets of similar sizes are in one step or in two that follow each other."""
    return F.floor(F.log(n.cast("double")) / max(1.001 * math.log(100 / percent), 0.001)).cast("int")  # a little wider, so that rounding does no harm


def meetings(index: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ``index`` in both roles, with ``token, step``: as the smaller set of a pair and as the other.

    The smaller one must share a hash among its first, where it leaves room for
    what two sets of its size share; the other may have it anywhere in its prefix.
    """
    room = F.col("n") - F.col("at")
    rows = index.select("token", "same", "component", "n", "parity", room.alias("room"), size_step(F.col("n"), percent).alias("step"))
    small = rows.filter((100 + percent) * F.col("room") >= 2 * percent * F.col("n"))
    return small.withColumn("step", F.explode(F.array("step", F.col("step") + 1))), rows


def crossing(index: DataFrame, percent: int, bounded: bool) -> DataFrame | None:
    """``token, step, c1, c2``: components that meet at a token and may have classes similar enough, by their extremes.

    The classes of one component are not compared with each other, however many
    they are.  None if ``bounded`` and components, or their classes, may make
    over ``PAIRS_A_ROW`` pairs a row of the index.
    """
    ends = lambda rows: rows.groupBy("token", "step", "component").agg(F.min("n").alias("n"), F.max("n").alias("most"), F.max("room").alias("room"), F.count("*").alias("classes"))
    small, other = map(ends, meetings(index, percent))
    small, other = saved(small), saved(other)
    if bounded:
        roles = small.select("token", "step", F.lit(1).alias("small"), F.lit(0).alias("other"), F.lit(0).alias("rows"))
        roles = roles.union(other.select("token", "step", F.lit(0), F.lit(1), "classes"))
        each = roles.groupBy("token", "step").agg(*[F.sum(c).alias(c) for c in ("small", "other", "rows")])
        meet, rows = each.agg(F.sum(F.col("small") * F.col("other")), F.sum("rows")).first()
        if (meet or 0) > PAIRS_A_ROW * (rows or 0):
            return None
    x, y = small.alias("x"), other.alias("y")
    on = (F.col("x.token") == F.col("y.token")) & (F.col("x.step") == F.col("y.step")) & (F.col("x.component") != F.col("y.component"))
    sizes = (F.col("x.n") <= F.col("y.most")) & (100 * F.col("x.most") >= percent * F.col("y.n"))
    room = (100 + percent) * F.least("x.room", "y.room") >= percent * (F.col("x.n") + F.col("y.n"))
    pairs = (F.col("x.classes") * F.col("y.classes")).alias("pairs")
    facing = saved(x.join(y, on & sizes & room).select("x.token", "x.step", F.col("x.component").alias("c1"), F.col("y.component").alias("c2"), pairs))
    if bounded and facing.agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0] > PAIRS_A_ROW * rows:
        return None
    return facing.drop("pairs")


def indexed_pairs(index: DataFrame, percent: int, facing: DataFrame | None = None) -> DataFrame:
    """``a, b``: the classes of ``facing`` components (all that meet, if not given) that may be similar enough."""
    facing = crossing(index, percent, False) if facing is None else facing
    small, other = meetings(index, percent)
    side = lambda rows, s, c: rows.select("token", "step", F.col("component").alias(c), F.col("same").alias(s), F.col("n").alias(f"n_{s}"), F.col("room").alias(f"room_{s}"), F.col("parity").alias(f"parity_{s}"))
    fits = may_fit(F.col("n_a"), F.col("n_b"), F.col("room_a"), F.col("room_b"), percent) & (F.struct("n_a", "a") < F.struct("n_b", "b"))
    left, right = facing.join(side(small, "a", "c1"), ["token", "step", "c1"]).alias("l"), side(other, "b", "c2").alias("r")
    on = (F.col("l.token") == F.col("r.token")) & (F.col("l.step") == F.col("r.step")) & (F.col("l.c2") == F.col("r.c2"))
    agree = may_agree(F.col("n_a"), F.col("n_b"), F.col("parity_a"), F.col("parity_b"), percent)
    return left.join(right, on & fits & agree).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def merges(links: DataFrame, labels: DataFrame) -> DataFrame:
    """``component, merged``: what becomes of the components of ``labels`` (``id, component``) that ``links`` (``a, b``) join."""
    end = lambda c: labels.select(F.col("id").alias(c), F.col("component").alias(f"of_{c}"))
    between = links.join(end("a"), "a").join(end("b"), "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
    return components(between).select(F.col("id").alias("component"), F.col("component").alias("merged"))


def merged(labels: DataFrame, now: DataFrame) -> DataFrame:
    return labels.join(now, "component", "left").withColumn("component", F.coalesce("merged", "component")).drop("merged")


def joined(grouped: DataFrame, tried: DataFrame, active: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``grouped`` (``id, component``) with all links among ``active`` that ``tried`` (``a, b``) has not.

    Classes of ``active`` that nothing links are in it too.  All pairs of
    different components are made as soon as they are few beside the index.
    Until then stars around its tokens, each with a centre of its own, link what
    they can, which needs a row a token and class; once a round leaves over
    ``WORTH`` of the components, the pairs that are left are made, however many.
    """
    labels = saved(grouped.select("id", "component").union(active.select(F.col("same").alias("id"), "component")).distinct())
    index, salt, worth = mixed_tokens(rare_index(active, percent), 0), 0, True
    while not index.isEmpty():
        facing = crossing(index, percent, worth)
        last = facing is not None
        new = indexed_pairs(index, percent, facing) if last else star_pairs(index, percent, salt)
        new = saved(new.join(tried, ["a", "b"], "left_anti"))
        links = saved(confirmed(new, sets, percent))
        now = merges(links, labels)
        labels = saved(merged(labels, now))
        if last:
            break
        before, gone = index.agg(F.countDistinct("component")).first()[0], now.filter("component <> merged").count()
        worth, tried, salt = gone > (1 - WORTH) * before, tried.union(new), salt + 1
        index = mixed_tokens(merged(index, now), salt)
    return labels


def groups(found: DataFrame, rows: DataFrame, more: DataFrame | None, percent: int, shingle: int) -> DataFrame:
    """``same`` to ``component``, the least class that it reaches, for classes with links.

    ``found`` are the features of ``rows`` (``id, tag, text``); ``more`` has
    further links ``a, b`` of classes.
    """
    known = found.filter(F.col("same").isNotNull())
    where = F.struct("id", "tag")
    classes = saved(known.groupBy("same").agg(F.min(where).alias("at"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")))
    placed = classes.select("same", "n", F.explode("bands").alias("bucket"))
    # most buckets have one class: only their numbers are shuffled, and the classes of buckets with more
    shared = saved(placed.groupBy("bucket").count().filter("count > 1").select(F.col("bucket").alias("key")))
    placed = among(placed, F.col("bucket"), shared)
    # sums are written before they are joined, so that Spark can split the rows of a hot bucket
    stars = placed.groupBy("bucket").agg(F.min(F.struct("same", "n")).alias("centre"), F.max("same").alias("top"))
    stars = saved(stars.filter("centre.same < top").drop("top"))
    members = saved(placed.join(stars, "bucket"))

    involved = saved(members.select("same").distinct().join(classes.select("same", "at"), "same").select("at"))
    some = among(rows, F.xxhash64("id", "tag"), involved.select(F.xxhash64("at.id", "at.tag").alias("key")))  # so that few other texts are shuffled
    some = some.select(where.alias("at"), "text").join(involved, "at", "left_semi")
    # a class has one place; of repeated rows one is taken before its set is made, where the join has put them
    sets = saved(shingle_sets(some.groupBy("at").agg(F.first("text").alias("text")), shingle))

    few, many = F.least("n", "centre.n"), F.greatest("n", "centre.n")
    fits = (F.col("same") != F.col("centre.same")) & (100 * few >= percent * many)
    tried = saved(members.filter(fits).select(F.col("centre.same").alias("a"), F.col("same").alias("b")).distinct())
    links = confirmed(tried, sets, percent)
    grouped = components(links if more is None else links.union(more))

    # buckets of several components: their classes meet again in an index, whatever bands they share
    state = grouped.select(F.col("id").alias("same"), "component")
    now = saved(members.select("bucket", "same").join(state, "same", "left").withColumn("component", F.coalesce("component", "same")))
    split = saved(now.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("bucket"))
    rest = saved(now.join(split, "bucket", "left_semi").select("same", "component").distinct())
    if not rest.isEmpty():
        active = saved(among(sets, F.xxhash64("same"), rest.select(F.xxhash64("same").alias("key"))).join(rest, "same").select("same", "component", "size", "hashes"))
        grouped = joined(grouped, tried, active, sets, percent)
    return grouped.select(F.col("id").alias("same"), "component")


def tagged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, text`` and a ``tag`` of the text."""
    text = F.col(f"`{text_col}`")
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.md5(text.cast("binary")).alias("tag"), text.alias("text"))


def near_duplicates(docs: DataFrame, percent: int = 80, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of documents that share ``percent`` of their shingles, by links.

    Words are what white space separates, A-Z in lower case; a document with
    fewer words than a shingle has one shingle of them all.  Returns one row an
    input row: ``doc_id, n_shingles, component_id`` (the least id reachable) and
    ``kept`` (the id is its component's).  A document without words has no
    shingles and no links; a row with a null id stands alone, with a null
    component, and is kept; rows of one id count as one document, which has the
    links of each of its texts; an empty table gives an empty one; other columns
    are not read.
    """
    rows = tagged(docs, id_col, text_col)
    found = saved(features(rows, shingle))
    known = found.filter(F.col("id").isNotNull())
    texts = known.groupBy("id").agg(F.min("same").alias("low"), F.max("same").alias("high"), F.max(F.col("same").isNull()).alias("blank"))
    several = saved(texts.filter("low < high or low is not null and blank").select("id", "low"))
    more = known.join(several, "id").filter("same <> low").select(F.col("low").alias("a"), F.col("same").alias("b"))
    grouped = groups(known, rows.filter(F.col("id").isNotNull()), more, percent, shingle)

    placed = known.filter(F.col("same").isNotNull()).groupBy("same").agg(F.min("id").alias("rep"))
    placed = saved(placed.join(grouped, "same", "left").select("same", "rep", F.coalesce("component", "same").alias("component")))
    least = saved(placed.groupBy("component").agg(F.min("rep").alias("component_id")))
    named = saved(placed.join(least, "component").select("same", "component_id"))
    if not several.isEmpty():  # a row without words goes with the others of its id
        found = found.join(several, "id", "left").withColumn("same", F.coalesce("same", "low"))
    joined = found.select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.col("same")).alias("same")).join(named, "same", "left")
    component: Column = F.coalesce("component_id", "id")
    return joined.select(F.col("id").alias("doc_id"), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, percent: int = 80, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: one row of each group of linked texts stays.

    Texts decide, not ids: rows of one id with different texts stay unless their
    texts are linked.  Of a group stays the row of the least id (null last), then
    of the least digest of its text; of rows alike in both, one.  Rows without
    words stay as they are; all columns stay; an empty table gives an empty one.
    """
    rows = tagged(docs, id_col, text_col)
    found = saved(features(rows, shingle))
    grouped = groups(found, rows, None, percent, shingle)
    place = F.struct(F.col("id").isNull().alias("last"), "id", "tag")
    spots = found.filter(F.col("same").isNotNull()).groupBy("id", "tag", "same").agg(F.count("*").alias("copies"))
    spots = saved(spots.join(grouped, "same", "left").select("id", "tag", "copies", F.coalesce("component", "same").alias("component")))
    best = saved(spots.groupBy("component").agg(F.min(place).alias("best")))
    judged = saved(spots.join(best, "component").select("id", "tag", "copies", place.eqNullSafe(F.col("best")).alias("stays")))
    gone = judged.filter("not stays").select(F.col("id").alias("gone_id"), F.col("tag").alias("gone_tag"))
    alike = judged.filter("stays and copies > 1").select(F.col("id").alias("gone_id"), F.col("tag").alias("gone_tag"))

    own_id, own_tag = F.col(f"`{id_col}`"), F.md5(F.col(f"`{text_col}`").cast("binary"))
    at = own_id.eqNullSafe(F.col("gone_id")) & (own_tag == F.col("gone_tag"))
    kept = docs.join(gone, at, "left_anti")
    if alike.isEmpty():
        return kept
    repeated = kept.join(alike, at, "left_semi").dropDuplicates([id_col, text_col])
    return kept.join(alike, at, "left_anti").unionByName(repeated)
