import random
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from veilwork.llm import cotrain, registry
from veilwork.llm.mixing import mix_sources
from veilwork.llm.secrets import BASE_RULES, MORE_RULES, python_pattern

SF = "/root/testdata/sf0.001"
STAGE = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    """Texts with copies, secrets, nulls, repeated rows and a hot source, and a column of a name that stages use."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(400)]
    texts = [" ".join(rng.choices(words, k=rng.randint(40, 120))) for _ in range(25)]
    texts += [texts[i] + " end" for i in range(5)] + [t.upper() for t in texts[:3]]
    texts += [f"{texts[i]} password=abcdefgh{i} and AKIA{'A1B2' * 4}" for i in range(6, 9)] + ["0123456789abcdef" * 3, "", " ", None, None]
    rows = [(i, t, rng.choice(["en", "de", None]), "hot" if i % 3 else rng.choice(["a", None]), len(t or ""), "x") for i, t in enumerate(texts)]
    rows += [(7, "quite another text of an id that is there before", "en", "a", 48, "x"), (None, texts[9] + " y", "en", "a", 9, "x"), (None, None, None, None, None, "x"), rows[4], rows[4]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, same string").repartition(3)


def test_near_dedup_by_brute_force(spark, docs):
    rows = [tuple(r) for r in docs.collect()]
    words = [(r[1] or "").lower().split() for r in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    want = {g: min((rows[i][0] is None, rows[i][0] or 0) for i in range(len(rows)) if group[i] == g) for g in set(group)}
    got = [tuple(r) for r in STAGE["near_dedup"](spark, docs, SF).collect()]
    assert len(got) == len(want)  # rows without words are groups of their own
    assert Counter((r[0] is None, r[0] or 0) for r in got) == Counter(want.values())
    assert not Counter(got) - Counter(rows)


def test_secrets_by_brute_force(spark, docs):
    def clean(text):
        spans = sorted((m.start(), n, m.end(), r.kind) for n, r in enumerate(BASE_RULES + MORE_RULES) for m in python_pattern(r).finditer(text) if len(m.group(r.group)) >= r.least)
        out, at = "", 0
        for start, _, end, kind in spans:
            if start >= at:
                out, at = out + text[at:start] + f"<secret:{kind}>", end
            else:
                at = max(at, end)
        return out + text[at:]

    want = Counter((*r[:1], t := None if r.text is None else clean(r.text), *r[2:4], None if t is None else len(t), r.same) for r in docs.collect())
    assert Counter(tuple(r) for r in STAGE["secrets"](spark, docs, SF).collect()) == want
    assert any("<secret:assign>" in (k[1] or "") for k in want)


def test_mixing_is_what_the_operator_says(spark, docs):
    rows = Counter((r.doc_id, r.source, len((r.text or "").split())) for r in STAGE["mixing"](spark, docs, SF).collect())
    want = Counter()
    for r in mix_sources(docs).collect():
        want[r.doc_id, r.source, r.size] += r.copies
    assert rows == +want


def test_packing_by_the_library(spark, docs):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = STAGE["packing"](spark, docs, SF).collect()
    want = sum(len(library.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect())
    assert sum(r.length for r in pieces) == want
    fill = Counter()
    for r in pieces:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 4096 and sorted(fill) == list(range(len(fill)))


def test_quality_keeps_what_the_classifier_keeps(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r.id for r in cotrain.decisions(docs, labels).collect() if r.kept}
    out = STAGE["quality"](spark, docs, SF)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == kept


def test_stages_of_an_empty_table(spark, docs):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), SF)
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns), name


def test_run(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "secrets", "mixing", "packing"]
    r = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(r.columns) and r.count() > 0


def test_registry():
    numbers = sorted(int(k[2:].split("_")[0]) for k in registry.queries())
    assert numbers == list(range(1, 11))
    assert set(registry.oracle_sql()) <= set(registry.queries())
