import itertools
import random
import re

import numpy as np
import pytest

from veilwork.llm import near_dup
from veilwork.llm.components import components
from veilwork.llm.near_dup import deduplicated, near_duplicates
from veilwork.llm.shared import saved


def brute(rows, percent, size):
    words = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t in rows]
    sets = [{tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set() for w in words]
    low = {i: i for i, _ in rows}
    changed = True
    pairs = [(rows[a][0], rows[b][0]) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in pairs:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return low, [len(s) for s in sets]


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    shared = [word() for _ in range(60)]
    texts = [None, "", " \t", "One two", "one TWO", "one two three"]
    for _ in range(12):
        base = [word() for _ in range(rng.choice([20, 120, 400]))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 12)):
            copy = list(base)
            for _ in range(rng.randint(0, len(base) // 25)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(("  " if rng.random() < 0.3 else " ").join(copy))
    texts += [" ".join(shared + [word() for _ in range(60)]) for _ in range(25)]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("size", [4, 5])
def test_components_equal_brute_force(spark, size):
    rows = corpus()
    want, n = brute(rows, 80, size)
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, component_id int").repartition(5)
    got = near_duplicates(df, 80, size).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == dict(enumerate(n))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_edges(spark):
    schema = "doc_id long, text string"
    rows = [(None, "some words are here now"), (5, "some words are here now"), (5, "some words are here now"), (9, "Some words are here NOW")]
    got = sorted((str(r.doc_id), r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, schema), 80, 4).collect())
    assert got == [("5", 5, True), ("5", 5, True), ("9", 5, False), ("None", None, True)]
    assert near_duplicates(spark.createDataFrame([], schema)).count() == 0
    assert [r.kept for r in near_duplicates(spark.createDataFrame([(1, None)], schema)).collect()] == [True]


def test_one_id_with_several_texts(spark):
    rows = [(1, "a b c d e"), (7, "a b c d e"), (7, "v w x y z"), (7, "k l m n o"), (3, "v w x y z"), (9, "k l m n o"), (8, "q q q q")]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 80, 4).collect()}
    assert got == {1: 1, 7: 1, 3: 1, 9: 1, 8: 8}


def test_near_copies_of_each_text_of_an_id(spark):
    from corpus_pipeline import near_dedup

    one, two = [" ".join(f"{x}{i}" for i in range(100)) for x in "xy"]
    rows = [(7, one), (7, two), (7, one), (9, one + " z"), (11, two + " z"), (12, "q q q q q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_duplicates(docs, 80, 5).collect()} == {7: 7, 9: 7, 11: 7, 12: 12}
    assert not near_dup.similar(np.empty(0, np.uint64), np.empty(0, np.uint64), 80)  # blank texts are not alike
    assert sorted(map(tuple, near_dedup(spark, docs, "").collect())) == [(7, one), (7, two), (12, "q q q q q")]


def test_links_of_many_ids_with_two_texts(spark):
    word = lambda x, i, k: f"{x}{i}w{k}"
    text = lambda x, i: " ".join(word(x, i, k) for k in range(60))
    rows = [(i, text(x, i)) for i in range(80) for x in "ab"] + [(1000 + i, text("ab"[i % 2], i) + " z") for i in range(80)]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 80, 4).collect()}
    assert got == {i: i for i in range(80)} | {1000 + i: i for i in range(80)}


def test_blank_rows_of_an_id_go_with_its_texts(spark):
    rows = [(1, "a b c d e"), (7, "a b c d e"), (7, " "), (7, None), (9, None)]
    got = sorted((r.doc_id, r.component_id, r.n_shingles) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 80, 4).collect())
    assert got == [(1, 1, 2), (7, 1, 0), (7, 1, 0), (7, 1, 2), (9, 9, 0)]


def test_very_long_text(spark):
    long = " ".join(f"w{i}" for i in range(300_000))
    rows = [(1, long), (2, long + " end"), (3, "x" * 1_000_000), (4, "x" * 1_000_000 + "y")]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 80, 4).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_one_of_each_group_stays(spark):
    one, two = [" ".join(f"{x}{i}" for i in range(100)) for x in "xy"]
    rows = [(5, one, "a"), (5, one, "a"), (None, one, "a"), (9, one + " z", "b"), (None, two, "c"), (None, two + " z", "c"), (None, None, "d"), (3, "", "e"), (3, "", "e"), (5, "other words are in this one", "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, same string").repartition(3)
    got = deduplicated(df, 80, 5).collect()
    two_left = [r for r in got if r.same == "c"]
    assert len(two_left) == 1 and two_left[0].text in (two, two + " z")
    assert sorted((str(r.doc_id), r.text or "", r.same) for r in got if r.same != "c") == [("3", "", "e"), ("3", "", "e"), ("5", "other words are in this one", "f"), ("5", one, "a"), ("None", "", "d")]
    assert deduplicated(df.limit(0), 80, 5).count() == 0


def test_confirmation_runs_once(spark, monkeypatch):
    from veilwork.llm import components as graph

    plans = []

    def spy(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return saved(df)

    monkeypatch.setattr(graph, "saved", spy)
    near_duplicates(spark.createDataFrame(corpus(), "doc_id long, text string"), 80, 4).count()
    assert max(p.count("MapInArrow") for p in plans) == 1


def test_long_chain(spark):
    edges = spark.range(300).selectExpr("id AS a", "id + 1 AS b")
    assert {r.component for r in components(edges).collect()} == {0}


def family(spark, words, members, pairs):
    """Pages of one template below 0.8, and copies at 0.81 of some of them, which are further from the others.

    Division of the ids by hashes of two rounds leaves them together, so random centres do not help.
    """
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    base = [word() for _ in range(words)]

    def changed(page, n):
        page = list(page)
        for i in range(n):
            page[rng.randrange(i * words // n, (i + 1) * words // n - 5)] = word()
        return page

    pages = [changed(base, words // 75) for _ in range(members)]
    pages += [changed(p, words // 46) for p in pages[members - pairs :]]
    ids = spark.range(20 * len(pages)).filter("xxhash64(id, 1) % 2 = 0 and pmod(xxhash64(id, 2), 4) = 0").limit(len(pages)).collect()
    return list(zip(sorted(r.id for r in ids), map(" ".join, pages), strict=True))


@pytest.mark.parametrize("counters", [1 << 22, 64])
def test_pairs_within_a_template_family(spark, monkeypatch, counters):
    monkeypatch.setattr(near_dup, "COUNTERS", counters)  # with few of them, rare shingles are hardly known
    rows = family(spark, 600, 200, 40)
    want, _ = brute(rows, 80, 5)
    assert 100 < len(set(want.values())) < 200
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r.doc_id: r.component_id for r in near_duplicates(df, 80, 5).collect()} == want


@pytest.mark.parametrize("most", [0, 1 << 40])
def test_stars_and_pairs_of_a_family_agree(spark, monkeypatch, most):
    monkeypatch.setattr(near_dup, "PAIRS_A_ROW", most)  # stars until they link nothing, or pairs at once
    rows = family(spark, 600, 100, 30)
    want, _ = brute(rows, 80, 5)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r.doc_id: r.component_id for r in near_duplicates(df, 80, 5).collect()} == want


@pytest.mark.parametrize("percent, counters", [(50, 1 << 22), (80, 1 << 22), (80, 256), (100, 1 << 22)])
def test_index_leaves_out_no_similar_pair(spark, monkeypatch, percent, counters):
    monkeypatch.setattr(near_dup, "COUNTERS", counters)
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    sets = [np.unique(rng.choice(pool[: rng.choice([1, 3, 40, 3000])], rng.integers(1, 900))) for _ in range(80)]
    sets += [np.unique(rng.choice(s, max(1, len(s) - 3), replace=False)) for s in sets]
    rows = [(bytes([i]), bytes([min(i, 100)]), len(s), s.tobytes()) for i, s in enumerate(sets)]  # the last ones are one component
    active = spark.createDataFrame(rows, "same binary, component binary, size long, hashes binary").repartition(3)
    found = [(r.a[0], r.b[0]) for r in near_dup.indexed_pairs(near_dup.rare_index(active, percent), percent).collect()]
    assert len(found) == len(set(found)) and all(a < b and a < 100 for a, b in found)
    for a, b in itertools.combinations(range(len(sets)), 2):
        common = len(np.intersect1d(sets[a], sets[b]))
        similar = 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common)
        assert not similar or a >= 100 or (a, b) in found


def test_pages_of_one_template_do_not_meet(spark):
    rng = np.random.default_rng(2)
    template = rng.integers(0, 2**64, 700, dtype=np.uint64)
    sets = [np.unique(np.concatenate([template, rng.integers(0, 2**64, 300, dtype=np.uint64)])) for _ in range(400)]
    rows = [(i.to_bytes(2, "big"), i.to_bytes(2, "big"), len(s), s.tobytes()) for i, s in enumerate(sets)]
    active = spark.createDataFrame(rows, "same binary, component binary, size long, hashes binary")
    assert near_dup.mixed_tokens(near_dup.rare_index(active, 80), 0).count() == 0 or near_dup.indexed_pairs(near_dup.rare_index(active, 80), 80).count() == 0


def test_parities_differ_at_most_as_often_as_sets(spark):
    rng = np.random.default_rng(4)
    for n in (0, 1, 50, 5000):
        a, b = [np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)) for _ in range(2)]
        b = np.unique(np.concatenate([a[n // 5 :], b[: n // 5]]))
        apart = sum(int(x).bit_count() for x in (near_dup.parities(a) ^ near_dup.parities(b)).view(np.uint64))
        assert len(near_dup.parities(a)) == len(near_dup.PARITIES) and apart <= len(np.setxor1d(a, b))
        assert n != 50 or apart > 0


def test_buckets_of_one_class_shuffle_their_numbers_only(spark):
    rng = random.Random(11)
    rows = [(i, " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(20))) for i in range(600)]
    df = saved(spark.createDataFrame(rows, "doc_id long, text string"))
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).head().totalShuffleWrite()
    before = written()
    assert near_duplicates(df, 80, 4).filter("kept").count() == 600
    assert written() - before < 40 * near_dup.BANDS * len(rows)
    pairs = spark.createDataFrame([(b"a" * 16, b"b" * 16)], "a binary, b binary")
    same = bytes(range(64))
    sets = saved(spark.createDataFrame([(c * 16, 8, same) for c in (b"a", b"b")], "same binary, size long, hashes binary"))
    assert [tuple(r) for r in near_dup.confirmed(saved(pairs), sets, 80).collect()] == [(b"a" * 16, b"b" * 16)]


def test_repeated_rows_of_a_place_give_one_set(spark):
    base = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(None, base), (None, base), (3, base), (3, base), (4, base + " more"), (None, base + " more")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.component_id) for r in near_duplicates(df, 80, 4).collect() if r.doc_id)
    assert got == [(3, 3), (3, 3), (4, 3)]
    assert [(r.doc_id, r.text) for r in deduplicated(df, 80, 4).collect()] == [(3, base)]


def test_counts_of_hashes_reach_the_driver_narrow(spark, monkeypatch):
    rng = np.random.default_rng(8)
    sets = [np.sort(rng.integers(0, 5000, 3000).astype(np.uint64)) for _ in range(4)]
    frame, got, real = spark.createDataFrame([(bytearray(s.tobytes()),) for s in sets], "hashes binary"), [], type(spark.range(0)).toArrow
    monkeypatch.setattr(type(spark.range(0)), "toArrow", lambda self: got.append(real(self)) or got[-1])
    common = near_dup.commonness(frame, 12_000)
    n = np.bincount((np.concatenate(sets) & np.uint64(len(common) - 1)).astype(np.int64), minlength=len(common))
    assert (common == np.where(n > 1, np.ceil(np.log2(np.maximum(n, 1))), 0)).all()
    assert got[0].num_rows == (n > 1).sum() and sum(f.type.bit_width for f in got[0].schema) == 40
