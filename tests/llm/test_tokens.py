import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veilwork.llm.bpe import MergeTable, count_tokens
from veilwork.llm.packing import assemble, closest_multiset, min_slack_patterns, pack_documents

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", "  \n", "Hello <|endoftext|> world", "ΑΣ ŻÓŁĆ İ ² ½", "x\x1cy\x85z", "日本語テキスト 😀", "don't I'LL we've", "a" * 3000, "e\u0301 é", "..!? -- ##"]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    words = ["alpha", "Beta,", "gamma-ray", "1234", "été", "x"]
    texts = ODD + [" ".join(rng.choices(words, k=rng.choice([1, 20, 300, 9000]))) for _ in range(40)]
    rows = [(i, t, "a", "b") for i, t in enumerate(texts)] + [(None, "no id", "a", "b"), (3, texts[3], "a", "b")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, sequence_id string").repartition(3)


def test_merging_equals_the_library():
    table, library = MergeTable(PATH), Tokenizer.from_file(PATH)
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choices("aAbBeé '.,\n\t12#日Σ", k=200)) for _ in range(100)]
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(b, "<u4").tolist() for b in table.encode(texts)] == want


def test_every_character_is_split_like_the_library_does():
    table, library = MergeTable(PATH), Tokenizer.from_file(PATH)
    texts = [f"a{chr(c)}b {chr(c)} 1{chr(c)}{chr(c)}." for c in range(0x20, 0x30000) if not 0xD800 <= c < 0xE000]
    for b in range(0, len(texts), 20_000):
        part = texts[b : b + 20_000]
        want = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(part, add_special_tokens=False)]
        wrong = [t for t, got, own in zip(part, table.encode(part), want, strict=True) if got != own]
        assert not wrong


def test_random_texts_of_all_scripts():
    table, library = MergeTable(PATH), Tokenizer.from_file(PATH)
    rng = random.Random(7)
    texts = ["".join(chr(rng.choice([rng.randrange(0x20, 0xD800), rng.randrange(0xE000, 0x30000), rng.randrange(0x20, 0x250)])) for _ in range(12)) for _ in range(30_000)]
    want = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [t for t, got, own in zip(texts, table.encode(texts), want, strict=True) if got != own] == []


def test_counts(docs):
    library = Tokenizer.from_file(PATH)
    got = {r.doc_id: r for r in count_tokens(docs, PATH, limit=100).collect()}
    for r in docs.collect():
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        if r.doc_id is not None:
            assert (got[r.doc_id].n_tokens, got[r.doc_id].n_bytes, got[r.doc_id].over_limit) == (n, len((r.text or "").encode()), n > 100)
    assert count_tokens(docs, PATH).count() == docs.count()
    assert count_tokens(docs.limit(0), PATH).count() == 0


def test_packing(docs):
    library = Tokenizer.from_file(PATH)
    rows = pack_documents(docs, PATH, window=512, keep_ids=True).cache()
    pieces = sorted(rows.collect(), key=lambda r: (r.sequence_id, r.offset))
    at = {}
    for p in pieces:
        assert p.offset == at.get(p.sequence_id, 0)
        at[p.sequence_id] = p.offset + p.length
        assert p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
    assert sorted(at) == list(range(len(at))) and max(at.values()) <= 512
    assert sum(at.values()) / (512 * len(at)) > 0.9
    texts = {r.doc_id: r.text for r in docs.collect()}
    for doc_id, text in texts.items():
        own = sorted({(p.start, tuple(p.ids), p.doc_tokens) for p in pieces if p.doc_id == doc_id})
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert [i for _, part, _ in own for i in part] == ids and own[0][2] == len(ids)
    again = pack_documents(docs.repartition(2), PATH, window=512)
    key = lambda df: sorted((str(r.doc_id), r.start, r.sequence_id, r.offset) for r in df.select("doc_id", "start", "sequence_id", "offset").collect())
    assert key(again) == key(rows)
    full = {r.sequence_id: len(r.input_ids) for r in assemble(rows).collect()}
    assert full == at
    assert pack_documents(docs.limit(0), PATH).count() == 0


def test_one_length_has_most_pieces(spark):
    """A third and more of equal pieces is spread over many groups."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 < 2, F.lit("same text here")).otherwise(F.repeat(F.lit("word "), (F.col("id") % 200).cast("int"))).alias("text"))
    rows = pack_documents(docs, PATH, window=256)
    fill = rows.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("e"))
    r = fill.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum((F.col("n") != F.col("e")).cast("int")).alias("bad"), F.max("n").alias("most")).first()
    assert r.bad == 0 and r.most <= 256 and rows.count() == 3000
    assert r.n / (256 * r.k) > 0.95


def test_multiset_is_closest():
    rng = random.Random(4)
    for _ in range(200):
        counts = {n: rng.randint(1, 3) for n in rng.sample(range(1, 30), rng.randint(1, 5))}
        capacity = rng.randint(1, 60)
        reach = {0}
        for n, k in counts.items():
            for _ in range(k):
                reach |= {x + n for x in reach if x + n <= capacity}
        used = closest_multiset(counts, sorted(counts, reverse=True), capacity)
        assert sum(n * k for n, k in used.items()) == max(reach)
        assert all(k <= counts[n] for n, k in used.items())
        left = dict(counts)
        for pattern, times in min_slack_patterns(counts, 60):
            assert sum(n * k for n, k in pattern.items()) <= 60
            for n, k in pattern.items():
                left[n] -= k * times
        assert not any(left.values())


def test_many_chunks_are_learned_once():
    bpe, learned = MergeTable(PATH), []
    bpe.memory = "chunks of a test"
    learn = bpe.learn
    bpe.learn = lambda new: learned.append(len(new)) or learn(new)
    texts = [" ".join(f"{a}{b}{c}," for b in "abcdefghijklmnopqrstuvwxyz" for c in "abcdefghijklmnopqrstuvwxyzßéñ") for a in ("".join(x) for x in itertools.product("abcdef", "ghijkl", "mnopqr"))]
    first = list(bpe.encode(texts))
    assert list(bpe.encode(texts)) == first and learned == [216 * 26 * 29, 0]


def test_letters_and_a_mark_are_split_like_the_library_does():
    texts = ["don't stop, d' it's, 's. 'll! re; ve: été, naïve. ª, º. ß) x) ²) ǅ, ʰ. ˤ, ˂, ``, a,, .a a_, 1, a1, ', ,"]
    want = [np.array(Tokenizer.from_file(PATH).encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert list(MergeTable(PATH).encode(texts)) == want
