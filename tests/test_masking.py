import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from veilwork.functions import checks
from veilwork.functions.spans import cut, find_all
from veilwork.operators import mask
from veilwork.operators.person import PersonRules, require_person
from veilwork.operators.recognizers import RECOGNIZERS, registry

FIXTURES = (Path(__file__).parent.parent / "FIXTURES.md").read_text()


def section(n):
    return FIXTURES.split(f"\n## {n}. ")[1].split("\n## ")[0]


def table(n):
    rows = [[c.strip() for c in line.strip("|").split("|")] for line in section(n).splitlines() if re.match(r"\| \d", line)]
    return [(r[2], re.findall(r"`([^`]+)`", r[3])) for r in rows]


def masked(spark, texts, **kw):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.r for r in df.select("i", mask.anonymize(F.col("t"), **kw).alias("r")).orderBy("i").collect()]


def test_must_mask(spark):
    cases = table(2)
    assert len(cases) == 32
    for (text, values), r in zip(cases, masked(spark, [c[0] for c in cases]), strict=True):
        assert not [v for v in values if v in r.anonymized], (text, r.anonymized)


def test_must_keep(spark):
    cases = table(3)
    assert len(cases) == 6
    for (text, values), r in zip(cases, masked(spark, [c[0] for c in cases]), strict=True):
        assert values[0] in r.anonymized, (text, r.anonymized)


def test_negatives(spark):
    texts = re.findall(r"^\d+\. (.+)$", section(4), re.M)
    assert len(texts) == 20
    assert sum(bool(r.entities_found) for r in masked(spark, texts)) <= 1


def test_sentence_end_stops_an_anchor(spark):
    (r,) = masked(spark, ["У меня нет ИНН. Мой заказ 5551234567 не пришёл."])
    assert "5551234567" in r.anonymized


def test_checksums(spark):
    rows = [("inn", "772012345670", True), ("inn", "7701234560", True), ("inn", "772012345678", False), ("inn", "77", False), ("snils", "123-456-789 64", True), ("snils", "123 456 789 64", True), ("snils", "123-456-789 65", False)]
    df = spark.createDataFrame(rows, "k string, v string, ok boolean")
    got = df.select("ok", F.when(F.col("k") == "inn", checks.inn_valid(F.col("v"))).otherwise(checks.snils_valid(F.col("v"))).alias("r"))
    assert all(r.ok == r.r for r in got.collect())
    assert spark.range(1).select(checks.iban_valid(F.lit("DE89 3704 0044 0532 0130 00"))).first()[0]
    assert not spark.range(1).select(checks.iban_valid(F.lit("DE89 3704 0044 0532 0130 01"))).first()[0]


def test_edges(spark):
    r = masked(spark, ["", "  \n", None, "Привет, как дела?"])
    assert [x and x.anonymized for x in r] == ["", "  \n", None, "Привет, как дела?"]
    assert all(x is None or (x.entities_found == [] and x.mapping == {}) for x in r)


def test_numbering_and_restoring(spark):
    text = "Тел. +79991234567, ещё 8 (999) 123-45-68 😀 и +7 999 123 45 69, почта a@b.ru"
    (r,) = masked(spark, [text])
    assert r.anonymized == "Тел. <PHONE>, ещё <PHONE_2> 😀 и <PHONE_3>, почта <EMAIL>"
    assert all(text[e.start : e.end] == e.value for e in r.entities_found)
    df = spark.createDataFrame([(r.anonymized, r.mapping), ("Основной <PHONE>, запасной <PHONE_2>.", {"<PHONE>": "1", "<PHONE_2>": "2"}), ("", {"<A>": "x"}), ("<A>", {}), ("<A> <A>", {"<A>": "x"})], "t string, m map<string,string>")
    back = [x.d for x in df.select(mask.deanonymize(F.col("t"), F.col("m")).alias("d")).collect()]
    assert [(b.text, b.replaced) for b in back] == [(text, 4), ("Основной 1, запасной 2.", 2), ("", 0), ("<A>", 0), ("x x", 2)]


def test_policy_falls_through(spark):
    text = ["Дата рождения: 15.03.1990"]
    assert masked(spark, text)[0].anonymized.endswith("<DATE_OF_BIRTH>")
    assert masked(spark, text, disable=["date_of_birth "])[0].anonymized.endswith("<PII>")
    assert masked(spark, text, disable=F.array(F.lit("DATE_OF_BIRTH")))[0].anonymized.endswith("<PII>")
    assert masked(spark, text, disable=["DATE_OF_BIRTH", "DATE_TIME"])[0].anonymized.endswith("15.03.1990")
    form = spark.range(1).select(mask.parse_disable(F.lit(" inn ,, SNILS")).alias("a"), mask.parse_disable(F.lit(" , ")).alias("b")).first()
    assert (form.a, form.b) == (["inn", "SNILS"], None)


def test_gate(spark):
    df = spark.createDataFrame([("почта a@b.ru",)], "t string").select(mask.anonymize(F.col("t")).alias("r"))
    shown, hidden = df.select(mask.gated(F.col("r"), True).alias("a"), mask.gated(F.col("r")).alias("b")).first()
    assert shown.mapping == {"<EMAIL>": "a@b.ru"} and hidden.mapping == {}
    assert hidden.entities_found[0].value == "" and hidden.original == "почта a@b.ru"


def test_spans_equal_python(spark):
    """Every pattern against Python's ``re`` on the fixtures, emoji included."""
    texts = [c[0] for c in table(2) + table(3)] + ["😀 +79161234567 😀 ИНН 7701234560", "г. Москва, ул. Ленина, д. 5, кв. 7"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in RECOGNIZERS:
        for pattern, _ in r.patterns:
            flags = re.I | (re.M | re.S if r.group == 0 else 0)
            want = [[m.span(1 if r.group else 0) for m in re.finditer(pattern, t, flags)] for t in texts]
            got = [[(s.start, s.end) for s in x.s] for x in df.select(find_all(F.col("t"), r.flags + pattern, r.group).alias("s")).collect()]
            assert got == want, r.name


def test_resolution_by_brute_force(spark):
    rng = random.Random(7)
    docs = []
    for k in range(300):
        spans = [(rng.choice(["INN", "PERSON"]), b, b + rng.randint(1, 9), rng.choice([0.5, 0.9, 1.0]), i) for i, b in enumerate(rng.sample(range(40), rng.randint(0, 12)))]
        docs.append((k, spans))
    df = spark.createDataFrame(docs, "k int, s array<struct<entity_type:string,start:int,end:int,score:double,rank:int>>")
    for r in df.select("s", mask.resolve(F.col("s")).alias("r")).collect():
        kept = []
        for s in sorted(r.s, key=lambda s: (-s.score, s.start - s.end, s.start, s.rank)):
            if all(s.end <= c.start or s.start >= c.end for c in kept):
                kept.append(s)
        assert list(r.r) == kept


def test_round_trip_of_random_texts(spark):
    rng = random.Random(3)
    pieces = ["+79991234567", "a.b@mail.ru", "ИНН 7701234560", "слово", "😀", "\n", "СНИЛС 123-456-789 64", "4000 1234 5678 9010", ",", "12.03.1999", "Ёж"]
    texts = [" ".join(rng.choices(pieces, k=rng.randint(1, 12))) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", mask.anonymize(F.col("t")).alias("r"))
    for x in df.select("t", "r", mask.deanonymize(F.col("r.anonymized"), F.col("r.mapping")).alias("d")).collect():
        assert x.d.text == x.t
        ends = [(e.start, e.end) for e in x.r.entities_found]
        assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:], strict=False))


def test_no_shuffle(spark):
    plan = spark.createDataFrame([("x",)], "t string").select(mask.anonymize(F.col("t")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_person(spark):
    rules = (PersonRules(),)
    texts = ["Меня зовут Иванова Мария Петровна.", "спасибоАнна", "Паспорт готов", "Звоните, Сергей Кузнецов!"]
    r = masked(spark, texts, recognizers=rules)
    assert [x.anonymized for x in r] == ["Меня зовут <PERSON>.", "спасибоАнна", "Паспорт готов", "Звоните, <PERSON>!"]
    df = spark.createDataFrame([("звоню Анне", 4, 5), ("это Анна, ", 4, 10), ("спасибоАнна", 7, 11), ("банковская", 0, 6), ("СНИЛС тут", 0, 5)], "t string, start int, end int")
    got = [x.s and (x.s.start, x.s.end) for x in df.select(checks.clean_person(F.col("t"), F.struct("start", "end")).alias("s")).collect()]
    assert got == [None, (4, 8), (0, 11), None, None]
    with pytest.raises(ValueError):
        require_person(registry())
    assert require_person(registry(), allow_no_person=True) and require_person((*registry(), PersonRules()))


def test_long_text(spark):
    text = "слово и дело at that in the " * 3000 + "почта a@b.ru"
    (r,) = masked(spark, [text])
    assert r.anonymized.endswith("<EMAIL>")


def test_cut(spark):
    assert spark.range(1).select(cut(F.lit("a😀bc"), F.struct(F.lit(1).alias("start"), F.lit(3).alias("end")))).first()[0] == "😀b"


def test_digits_of_a_digest_are_no_phone(spark):
    texts = ['token = "34cf1be9225426587b06121cb35ab512e5a1beb5"', 'token = "b7852d4e73166f43a80132626729b5fa5141a7a6"', "9225426587b06121cb35ab512e5a1beb50123456 да", "тел89161234567, tel89161234567доб", "a9161234567b"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(mask.anonymize(F.col("t"))["anonymized"]).collect()
    assert [g[0] for g in got] == [*texts[:3], "тел<PHONE>, tel<PHONE_2>доб", "a<PHONE>b"]
