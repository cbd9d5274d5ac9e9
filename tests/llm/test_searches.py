"""Top-k search, fill-in-the-middle and phrases against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilwork.llm import phrases, topk
from veilwork.llm.fim import Shares, ends, fill_in_middle, restore
from veilwork.llm.phrases import collocations, frequent_phrases
from veilwork.llm.shared import filter_bits, has_key, key_filter, may_hold
from veilwork.llm.topk import Side, summary, survivors, top_k


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


# --- top-k ---------------------------------------------------------------------


def brute_top(rows, k):
    """(query_id, rank, vec_id, score) with Python integers."""
    known = []
    for i, v in rows:
        if v is not None and all(x is not None and np.isfinite(x) for x in v):
            known.append((i, [int(np.floor(256 * float(x))) for x in v]))
    out = []
    for n, (i, q) in enumerate(known):
        if i is not None and i % 50 == 0:
            scores = [(-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, c, strict=True)))), j is None, j or 0, j) for m, (j, c) in enumerate(known) if m != n and len(c) == len(q)]
            out += [(i, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def vectors(seed, n, size=20):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, size))
    return [(i, (centres[i % 5] + 0.3 * rng.normal(size=size)).astype(np.float32).tolist()) for i in range(n)]


def test_top_k_equals_brute_force(spark, monkeypatch):
    rows = vectors(1, 700)
    hot = rows[50][1]  # a third of all rows, and a query among them
    rows += [(1000 + i, hot) for i in range(350)]
    rows += [(None, hot), (50, hot), (50, rows[3][1]), (100, None), (150, [None] * 20), (200, [float("nan")] * 20), (250, [float("inf")] + [0.0] * 19)]
    rows += [(2000, [1.0, 2.0]), (2001, [2.0, 1.0]), (2050, []), (2051, []), (3000, [1e300] * 20), (3001, [2.0**40] * 20), (3050, [-1e30] * 20)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>" + ", score string").repartition(5)
    doubles = df.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "score")
    given = [(r.vec_id, r.embedding) for r in doubles.collect()]
    monkeypatch.setattr(topk, "BLOCK", 7)  # several blocks
    monkeypatch.setattr(topk, "LOT", 3)
    got = rows_of(top_k(doubles, F.col("vec_id") % 50 == 0))
    assert got == brute_top(given, 5)


def test_top_k_of_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, -1.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert rows_of(top_k(df, F.col("vec_id") % 50 == 0)) == [(0, 1, 1, 0)]
    assert top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(3)
    for size in (1, 2, 7, 33, 64):
        q, c = Side(np.floor(rng.normal(size=(20, size)) * 256)), Side(np.floor(rng.normal(size=(50, size)) * 256))
        exact = ((q.x[:, None, :] - c.x[None, :, :]) ** 2).sum(axis=2)
        for f, g in zip(q.levels, c.levels, strict=True):
            assert (((f[:, None, :] - g[None, :, :]) ** 2).sum(axis=2) <= exact * (1 + 1e-9) + 1e-6).all()
        least = np.sort(q.x @ c.x.T, axis=1)[:, -5]
        kept = set(zip(*survivors(q, c, least), strict=True))
        assert {(i, j) for i, j in np.argwhere(q.x @ c.x.T >= least[:, None])} <= kept
    assert summary(np.ones((2, 10)), 4).shape == (2, 8)
    apart = Side(np.repeat(np.array([[1.0], [9.0]]), 64, axis=1) * 100)
    assert len(survivors(apart, apart, np.array([64e4, 64e4 * 81]))[0]) < 4


# --- fill-in-the-middle -----------------------------------------------------------

TEXTS = [None, "", " ", "one", "a b c", "\t\n x  y ", "has <P> mark", "ends with <", "<", "S> <M", "日本 語 😀 x", "w " * 30000, "x" * 50000, " a b", "a <S b> c <"]


def brute_fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+", text)
    n = len(units)
    digits = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[8 * i : 8 * i + 8], 16) for i in range(4)]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    if text == "" or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < 80 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return (doc_id, n, form, len(p), len(m), sha(out), sha(text))


def test_fill_in_middle_equals_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, t) for i, t in enumerate(TEXTS * 8)] + [(i, "".join(rng.choices("ab <>PSM\n", k=40))) for i in range(200, 400)] + [(None, "no id"), (3, "one"), (3, "one")]
    df = spark.createDataFrame([(i, t, "n", "r") for i, t in rows], "doc_id long, text string, n string, output string").repartition(3)
    got = fill_in_middle(df)
    assert rows_of(got.drop("output")) == sorted([brute_fim(*r) for r in rows], key=repr)
    forms = {r["form"] for r in got.select("form").distinct().collect()}
    assert forms == {"plain", "psm", "spm"}
    for r in got.select("output", "form", "restored_sha256").collect():
        assert hashlib.sha256(restore(r.output, r.form).encode()).hexdigest() == r.restored_sha256
    assert fill_in_middle(df.limit(0)).count() == 0


def test_shares_and_ends(spark):
    df = spark.createDataFrame([(i, "a b c d") for i in range(300)], "doc_id long, text string")
    forms = Counter(r["form"] for r in fill_in_middle(df, Shares(seed="7", cut=100, suffix_first=0)).collect())
    assert forms == {"psm": 300}
    assert list(ends(" a  b ")) == [0, 2, 5, 6]


# --- phrases ----------------------------------------------------------------------


def brute_phrases(rows, longest=3, least=10, covered=50, first=2000):
    counts, sizes = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", lower):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            sizes[lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    key = (lang, *words[i : i + m])
                    counts[key] = counts.get(key, 0) + 1
    fitting = {k: a for k, a in counts.items() if len(k) > 2 and a >= least}
    out = {}
    for key, a in fitting.items():
        lang, words = key[0], key[1:]
        cuts = [(1_000_000 * a * a // (counts[lang, *words[:k]] * counts[lang, *words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        longer = [b for other, b in fitting.items() if other[0] == lang and len(other) > len(key) and any(other[i : i + len(words)] == words for i in range(1, len(other) - len(words) + 1))]
        if not any(100 * b >= covered * a for b in longer):
            out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), counts[lang, *words[:k]], counts[lang, *words[k:]]))
    return sorted([(lang, i + 1, p.decode(), -a, el, r, sizes[lang], -s) for lang, found in out.items() for i, (s, a, p, el, r) in enumerate(sorted(found)[:first])], key=repr)


def phrase_rows(seed):
    rng = random.Random(seed)
    words = ["the", "of", "New", "york", "city", "a", "b", "é", "x y", "日本"]
    weights = [40, 20, 5, 5, 5, 3, 3, 2, 1, 1]
    texts = [" ".join(w + rng.choice(["", "", "", ".", ",", "\n", "\t", "  "]) for w in rng.choices(words, weights, k=rng.choice([1, 5, 60]))) for _ in range(120)]
    rows = [(t, rng.choice(["en", "en", "en", "fr", None, ""])) for t in texts]
    return rows + [(None, "en"), ("", None), (" . , ", "de"), ("the of new york " * 3000, "en"), ("und so", "und"), (rows[0][0], rows[0][1])] + [("NEW york city of the", "fr")] * 40


@pytest.mark.parametrize("longest, least, held", [(3, 10, None), (3, 10, 5), (5, 4, 3), (2, 2, None)])
def test_phrases_equal_brute_force(spark, monkeypatch, longest, least, held):
    rows = phrase_rows(longest * 10 + least)
    if held:  # prefixes with more windows are counted by sums
        monkeypatch.setattr(phrases.frequent_phrases, "__defaults__", (held,))
    df = spark.createDataFrame([(t, lang, "x", 1) for t, lang in rows], "text string, lang string, phrase string, n int").repartition(4)
    got = collocations(df, longest=longest, least=least)
    assert rows_of(got) == brute_phrases(rows, longest, least)
    assert collocations(df, longest=longest, least=least, first=3).groupBy("lang").count().filter("count > 3").isEmpty()


def test_no_phrases(spark):
    df = spark.createDataFrame([], "text string, lang string")
    assert collocations(df).count() == 0
    windows = spark.createDataFrame([("en", ["a", "b"], 3)], "lang string, words array<string>, n long")
    assert frequent_phrases(windows, 3, 10).count() == 0


def test_a_task_counts_its_texts_together(spark):
    df = spark.range(300, numPartitions=1).select(F.lit("en").alias("lang"), F.repeat(F.lit("one two three. "), 700).alias("text"))
    assert sorted(map(tuple, phrases.word_counts(df).collect())) == [("en", w, 210_000) for w in ("one", "three", "two")]
    every = np.full(1024, 2**64 - 1, np.uint64)
    assert sorted((list(r.words), r.n) for r in phrases.windows(df, every, 3).collect()) == [(["one", "two", "three"], 210_000), (["two", "three"], 210_000)]


def test_blocks_part_texts_and_languages(monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 40)
    batch = pa.RecordBatch.from_arrays([pa.array(["a", "b", "a", "a"]), pa.array(["x y x", None, "y, x", "z" * 50])], names=["lang", "text"])
    found = [(lang, [words[c] for c in codes]) for lang, codes, words in phrases.blocks(iter([batch, batch]))]
    one = [("a", [b"x", b"y", b"x", b"\xff", b"y", b"\xff", b"x", b"\xff", b"z" * 50, b"\xff"]), ("b", [b"\xff"])]
    assert [(lang, [w for w in words if w != b"\xff"]) for lang, words in found] == [(lang, [w for w in words if w != b"\xff"]) for lang, words in one * 2]
    assert all(words[-1] == b"\xff" for _, words in found)


def test_wide_codes_are_kept_apart():
    columns = [np.array([2**40, 1, 2**40]), np.array([5, 6, 5])]
    table, n = phrases.distinct_rows(columns, 2**41)
    assert table.tolist() == [[1, 6], [2**40, 5]] and n.tolist() == [1, 2]
    assert list(phrases.by_language(pa.RecordBatch.from_arrays([pa.array(["a", "b", "a"]), pa.array(["1", None, "3"])], names=["l", "t"]))) == [("a", ["1", "3"]), ("b", [None])]


# --- key filters ------------------------------------------------------------------


def test_key_filters_follow_the_number_of_keys(spark):
    keys = spark.range(20_000).select(F.xxhash64("id").alias("key"))
    bits = filter_bits(keys, 20_000)
    assert len(bits) == 8192
    own = np.array([r.key for r in keys.collect()], dtype=np.int64)
    assert has_key(bits, own).all()
    others = spark.range(20_000, 40_000).select(F.xxhash64("id").alias("key"))
    assert has_key(bits, np.array([r.key for r in others.collect()], dtype=np.int64)).mean() < 0.05
    row = key_filter(keys, 20_000)
    assert keys.join(row).filter(~may_hold(F.col("bits"), F.col("key"))).count() == 0
    assert row.collect()[0]["bits"] == bits.view(np.int64).tolist()
    assert others.join(row).filter(may_hold(F.col("bits"), F.col("key"))).count() == int(has_key(bits, np.array([r.key for r in others.collect()], dtype=np.int64)).sum())


def test_key_filter_needs_no_join(spark):
    keys = spark.range(100).select(F.xxhash64("id").alias("key"))
    assert "Join" not in key_filter(keys, 100)._jdf.queryExecution().toString()
    assert key_filter(keys.limit(0), 0).collect()[0]["bits"] == [0] * 1024
