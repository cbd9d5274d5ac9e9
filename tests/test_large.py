"""Costly expressions run once a row and in many tasks, however the files lie."""

import hashlib
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from veilwork.functions import checks
from veilwork.operators import conversation, evaluate
from veilwork.operators.person import complete
from veilwork.operators.recognizers import detect
from veilwork.plans import queries as core

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def base58(payload):
    data = payload + hashlib.sha256(hashlib.sha256(payload).digest()).digest()[:4]
    n, out = int.from_bytes(data, "big"), ""
    while n:
        n, r = divmod(n, 58)
        out = checks.BASE58[r] + out
    return "1" * (len(data) - len(data.lstrip(b"\0"))) + out


def test_base58_is_short_work(spark):
    payloads = [bytes([v]) + hashlib.sha256(bytes([i])).digest()[:20] for i in range(20) for v in (0, 5)] + [b"\0" * 21, b"\0" * 20 + b"\1"]
    good = [base58(p) for p in payloads]
    bad = [g[:-1] + ("2" if g[-1] != "2" else "3") for g in good]
    rows = spark.createDataFrame([(g, True) for g in good] + [(b, False) for b in bad], "v string, want boolean")
    assert rows.filter(checks.base58_valid(F.col("v")) != F.col("want")).count() == 0
    # limbs of four bytes, not one array element a byte and character
    assert "array_repeat(0, 25)" not in str(checks.base58_valid(F.col("v")))


@pytest.mark.parametrize("name", ["find_wallets", "address_spans", "mask_text", "mapping_entries", "mapping_gate", "deanonymize_roundtrip", "placeholder_map", "policy_disable", "leak_rate"])
def test_customers_are_dealt_out(spark, name):
    df = core.FOUND[name].run(spark, SF)
    assert "Repartition" in plan(df)
    if name != "leak_rate":
        assert df.rdd.getNumPartitions() >= 3 * spark.sparkContext.defaultParallelism


def test_mapping_entries_mask_once(spark):
    assert plan(core.mapping_entries(spark, SF)).count("array_sort(") == plan(core.mask_text(spark, SF)).count("array_sort(")


def test_type_presence_analyses_each_text_once_in_many_tasks(spark):
    rows = spark.createDataFrame([(f"t{i % 7}" if i % 50 else None, "AB"[i % 2] if i % 11 else None) for i in range(700)], "text string, entity_type string")
    calls = spark.sparkContext.accumulator(0)

    @F.udf("array<struct<entity_type:string>>")
    def detected(t):
        calls.add(1)
        return [("A",)] if t in ("t1", "t2") else [("B",), ("C",)]

    got = evaluate.type_presence(rows, detected.asNondeterministic())
    assert "Join" not in plan(got)
    got = {r.entity_type: (r.found, r.total, r.recall) for r in got.collect()}
    data = [(r.text, r.entity_type) for r in rows.collect() if r.text]
    for t in "AB":
        total = sum(k == t for _, k in data)
        found = sum(k == t and (x in ("t1", "t2")) == (t == "A") for x, k in data)
        assert got[t] == (found, total, found / total)
    assert got[None] == (None, sum(k is None for _, k in data), None)
    assert calls.value == 7


def test_numeric_recognizers_are_passed_over_without_loss(spark):
    chosen = complete()
    assert all(any(r.name == n and r.numeric for r in chosen) for n in ("phone", "inn_anchored", "card", "ip", "segwit"))
    texts = ["Спасибо", "", "почта a@b.ru", "ул. Ленина", "тел ٨٩١٦١٢٣٤٥٦٧", "тел 89161234567, ИНН 7707083893, 2001:db8::1, Анна Петровна", "см. https://x.org", "дата рождения: ٠١.٠٢.١٩٩٠"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = tuple(replace(r, numeric=False) for r in chosen)
    got = rows.select(detect(F.col("t"), chosen).alias("a"), detect(F.col("t"), plain).alias("b")).collect()
    assert all(r.a == r.b for r in got) and sum(len(r.a) for r in got) > 6


def test_contacts_are_dealt_out_after_their_join(spark):
    orders, contacts, lines = core._chat(spark, SF)
    text = plan(conversation.assemble(orders, contacts, lines, orders.select("id")))
    assert text.count("Repartition ") >= 2
