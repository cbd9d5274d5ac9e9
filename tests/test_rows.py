"""Interval joins, chunks, the token classifier, JSON in one pass, split files, responses, audit in the same pass."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from veilwork.operators import chunks, conversation, evaluate, generate, intervals, mask, tagger
from veilwork.operators.jsonmask import json_leaves, mask_json
from veilwork.operators.person import PersonRules
from veilwork.sources import conll, tables
from veilwork.streaming import webhook


def spans(seed, n, docs=3, most=60):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        b = rng.randrange(most)
        out.append((rng.choice([*range(docs), None]), b, b + rng.choice([0, 1, 3, 30]), rng.choice("ab")))
    return out


@pytest.mark.parametrize("width", [1, 7, 256])
def test_interval_join(spark, width):
    schema = "doc_id int, start int, end int, entity_type string"
    a, b = spans(1, 80), spans(2, 80)
    got = intervals.overlapping(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["doc_id"], width)
    pairs = sorted((tuple(r.l), tuple(r.r)) for r in got.collect())
    assert pairs == sorted((x, y) for x in a for y in b if x[0] is not None and x[0] == y[0] and x[1] < y[2] and y[1] < x[2])
    lonely = sorted(map(tuple, evaluate.spurious(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)).collect()), key=repr)
    assert lonely == sorted((x for x in a if not any(x[0] is not None and x[0] == y[0] and x[1] < y[2] and y[1] < x[2] for y in b)), key=repr)


def test_a_document_with_many_spans_is_no_task(spark):
    n = 100_000
    side = spark.range(n).select(F.lit(1).alias("doc_id"), (F.col("id") * 5).alias("start"), (F.col("id") * 5 + 4).alias("end"))
    began = time.time()
    assert intervals.overlapping(side, side, ["doc_id"]).count() == n
    assert time.time() - began < 60


def test_resolution_in_rounds_equals_the_fold(spark):
    rng = random.Random(4)
    rows = [(d, rng.choice(["INN", "SNILS"]), b, b + rng.randrange(1, 12), rng.choice([0.4, 0.5, 0.9]), rng.randrange(4)) for d in range(6) for b in [rng.randrange(40) for _ in range(30)]]
    df = spark.createDataFrame(rows, "doc int, entity_type string, start int, end int, score double, rank int")
    want = df.groupBy("doc").agg(mask.resolve(F.collect_list(F.struct("entity_type", "start", "end", "score", "rank"))).alias("s")).select("doc", F.explode("s").alias("s")).select("doc", "s.*")
    assert sorted(map(tuple, intervals.resolved(df, ["doc"]).collect())) == sorted(map(tuple, want.collect()))
    assert intervals.resolved(df.limit(0), ["doc"]).count() == 0


@pytest.mark.parametrize("width, held", [(16, 1000), (64, 8)])
def test_bins_alone_and_in_rounds_equal_the_fold(spark, width, held):
    rng = random.Random(width + held)
    rows = [(d, rng.choice(["INN", "SNILS"]), b, b + rng.randrange(1, 12), rng.choice([0.4, 0.5, 0.9]), rng.randrange(4)) for d in range(4) for b in [rng.randrange(-40, 200) for _ in range(12 * d)]]
    df = spark.createDataFrame(rows + rows[:9], "bin int, entity_type string, start int, end int, score double, rank int")
    want = df.distinct().groupBy("bin").agg(mask.resolve(F.collect_list(F.struct("entity_type", "start", "end", "score", "rank"))).alias("s")).select("bin", F.explode("s").alias("s")).select("bin", "s.*")
    got = intervals.resolved(df, ["bin"], width, held=held)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_bins_that_no_span_crosses_need_no_join(spark, monkeypatch):
    monkeypatch.setattr(intervals, "overlapping", None)
    rows = [(d, "INN", b, b + 9, 0.5, 0) for d in range(9) for b in (0, 3, 300, 304, 309)]
    got = intervals.resolved(spark.createDataFrame(rows, "doc int, entity_type string, start int, end int, score double, rank int"), ["doc"])
    assert sorted((r.doc, r.start) for r in got.collect()) == [(d, b) for d in range(9) for b in (0, 300, 309)]


def test_chunks(spark):
    tags = {1: ["B-A", "I-A", "I-B", "B-B", None, "I-A"], 2: ["O", "I-A", "I-A", "B-A", "x"], 3: ["O"]}
    rows = spark.createDataFrame([(k, i, t) for k, v in tags.items() for i, t in enumerate(v)], "k int, pos int, tag string")
    got = sorted((r.k, r.type, r.first, r.last) for r in chunks.tag_chunks(rows, ["k"]).collect())
    assert got == [(1, "A", 0, 1), (1, "A", 5, 5), (1, "B", 2, 2), (1, "B", 3, 3), (2, "A", 1, 2), (2, "A", 3, 3)]
    gold = spark.createDataFrame([(1, 0, "B-A"), (1, 1, "I-A"), (2, 1, "B-A"), (2, 2, "I-A"), (4, 0, "B-C")], "k int, pos int, tag string")
    r = {x.type: x for x in chunks.chunk_scores(gold, rows, ["k"]).collect()}
    assert (r["A"].tp, r["A"].fp, r["A"].fn) == (2, 2, 0) and r["A"].f1 == pytest.approx(2 / 3) and r["A"].f2 == pytest.approx(5 / 6)
    assert (r["C"].fn, r["C"].f2, r["micro"].tp) == (1, 0.0, 2)
    assert chunks.chunk_scores(rows.limit(0), rows.limit(0), ["k"]).filter("tp + fp + fn > 0").isEmpty()


def best_path(scores, step):
    best = [([b], scores[0][b] + (tagger.NEVER if b == 2 else 0)) for b in range(3)]
    for row in scores[1:]:
        best = [max(((p + [b], v + step[p[-1]][b] + row[b]) for p, v in best), key=lambda x: x[1]) for b in range(3)]
    return max(best, key=lambda x: x[1])[0]


def test_viterbi(spark):
    rng = random.Random(5)
    rows = [(i, [[rng.random() for _ in range(3)] for _ in range(rng.choice([1, 2, 9]))]) for i in range(40)] + [(40, [])]
    step = [[0.3, 0.1, -0.5], [0.0, -1.0, 0.7], [0.2, 0.1, 0.4]]
    hard = [[0, 0, tagger.NEVER], [0, 0, 0], [0, 0, 0]]
    df = spark.createDataFrame(rows, "i int, s array<array<double>>")
    for r in df.select("s", tagger.viterbi(F.col("s")).alias("hard"), tagger.viterbi(F.col("s"), step).alias("soft")).collect():
        assert r.hard == (best_path(r.s, hard) if r.s else []) and r.soft == (best_path(r.s, step) if r.s else [])


def test_classifier_finds_more_names_than_the_rules(spark, tmp_path):
    here = lambda df: spark.createDataFrame(df.collect(), df.schema)
    chat = lambda df: here(df.select("id", generate.person(F.col("id"))["text"].alias("p"))).select("id", generate._sentence(generate.CHATS, {"p": F.col("p")}, F.col("id"), 53).alias("s")).select("id", "s.text", "s.spans")
    negative = lambda df: generate.negatives(df, "id").select("id", "text", "spans")
    ids = lambda a, b: spark.range(a, b)
    labelled = here(chat(ids(0, 700)).unionByName(negative(ids(1000, 1400))))
    held = here(chat(ids(5000, 5200)).unionByName(negative(ids(6000, 6150))))

    def rows(df, weight):
        each = tagger.token_rows(df, "id", "text")
        tags = df.select(F.col("id").alias("key"), F.posexplode(generate.bio(generate.tokens(F.col("text")), F.col("spans"))).alias("pos", "x")).select("key", "pos", "x.tag")
        return each.join(tags, ["key", "pos"]).select("features", "tag", F.lit(weight).alias("weight"))

    silver = here(ids(20000, 20300).select("id", generate.silver(F.col("id")).alias("text")))
    guessed = silver.select("id", "text", F.transform(PersonRules().spans(F.col("text"), 0), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("stop"), s["entity_type"].alias("type"))).alias("spans"))
    # where the rules see no name, there may still be one: such texts teach nothing
    model = tagger.train(here(rows(labelled, 1.0).unionByName(rows(here(guessed.filter(F.size("spans") > 0)), 0.3))), features=1 << 13, rounds=25)
    tagger.save(model, str(tmp_path / "model"))
    found = tagger.find_names(tagger.load(str(tmp_path / "model")), held, "id", "text")
    gold = held.select("id", F.explode("spans").alias("s")).select("id", F.col("s.start").alias("start"), F.col("s.stop").alias("end"))
    flat = lambda df, name: df.select("id", F.explode(name).alias("s")).select("id", "s.start", "s.end")
    model_spans = flat(found, "spans").cache()
    rule_spans = flat(held.select("id", PersonRules().spans(F.col("text"), 0).alias("r")), "r")
    hit = lambda df: gold.join(df, ["id", "start", "end"], "left_semi").count() / gold.count()
    by_model, by_rules = hit(model_spans), hit(rule_spans)
    assert by_model > by_rules and by_model > 0.9
    assert model_spans.join(gold, ["id", "start", "end"], "left_semi").count() / model_spans.count() > 0.9


def test_json_of_many_strings_takes_time_in_proportion(spark):
    one = lambda n: json.dumps({"k": [f"строка {i}" if i % 500 else "почта a@b.ru" for i in range(n)], 'a"b : c': {"x : y": '"q": v@w.ru'}}, ensure_ascii=False)
    df = spark.createDataFrame([(one(16_000),)], "t string")
    only_email = tuple(r for r in mask.complete() if r.name == "email")
    run = lambda d: d.select(mask_json(F.col("t"), lambda c: mask.anonymize(c, recognizers=only_email)).alias("r")).first().r
    run(spark.createDataFrame([(one(10),)], "t string"))
    began = time.time()
    r = run(df)
    assert time.time() - began < 20
    want = json.loads(one(16_000).replace("a@b.ru", "<EMAIL>").replace("v@w.ru", "<EMAIL>"))
    assert json.loads(r.anonymized) == want and len(r.entities_found) == 33


def test_json_leaves(spark):
    rows = [(1, '{"a": {"b": ["x", 1, {"c": "y"}]}, "d": null, "e": ""}'), (2, '"top"'), (3, "no json"), (4, None), (5, "[]"), (6, "[" * 30 + '"deep"' + "]" * 30)]
    got = sorted((r.id, r.path, r.value) for r in json_leaves(spark.createDataFrame(rows, "id int, t string"), "id", "t").collect())
    assert got == sorted([(1, "$.a.b[0]", "x"), (1, "$.a.b[2].c", "y"), (1, "$.e", ""), (2, "$", "top"), (6, "$" + "[0]" * 30, "deep")])


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_conll_over_several_splits(spark, tmp_path, end):
    rng = random.Random(6)
    want, lines = [], []
    for _ in range(400):
        own = [(f"t{rng.randrange(99)}", rng.choice(["O", "B-PERSON", "B-X", ""])) for _ in range(rng.randrange(1, 6))]
        lines += [f"{t}\t{g}" if g else t for t, g in own] + rng.choice([[""], ["  "], ["", "\t"]])
        want.append([(t, g if g == "B-PERSON" else "O") for t, g in own])
    (tmp_path / "a.conll").write_bytes(end.join(lines).encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        found = conll.read_conll(spark, str(tmp_path / "a.conll"), ["B-PERSON", "I-PERSON"])
        assert conll.numbered_lines(spark, str(tmp_path)).select("line_no").distinct().count() == len(end.join(lines).splitlines())
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 3
        assert [[(t.token, t.tag) for t in r.tokens] for r in found.orderBy("sent_id").collect()] == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_no_event_is_lost_and_none_answered_twice(spark, tmp_path):
    bodies = ['{"event": "message_created", "id": 5, "content": "a@b.ru"}', '{"event": "message_updated", "id": 5, "content": "a@b.ru"}', '{"content": "x"}', '{"content": "y"}', '{"content": "y"}', "broken"]
    spark.createDataFrame([(b,) for b in bodies], "value string").coalesce(1).write.text(str(tmp_path / "in"))
    seen, ledger = [], str(tmp_path / "ledger")
    start = lambda ck: webhook.respond(spark.readStream.text(str(tmp_path / "in")), lambda batch: seen.extend(batch.collect()), str(tmp_path / ck), ledger)
    for ck in ("one", "two"):  # a checkpoint that is lost makes Spark try the batch again
        q = start(ck)
        q.processAllAvailable()
        q.stop()
    assert len(seen) == 6 and webhook.responses(spark, ledger).count() == 6
    assert sorted(str(r.content) for r in seen) == ["<EMAIL>", "<EMAIL>", "None", "x", "y", "y"]
    assert len({r.event_key for r in seen}) == 5


def test_audit_in_the_same_pass(spark):
    texts = spark.createDataFrame([("a@b.ru",), ("a@b.ru c@d.ru +79991234567",), ("x",), (None,)], "t string")
    done, seen = tables.audited(texts.select(mask.anonymize(F.col("t")).alias("result")), ["EMAIL_ADDRESS", "PHONE_NUMBER"])
    want = {r.entity_type: (r.n_entities, r.n_texts) for r in tables.audit(done).collect()}
    done.write.format("noop").mode("overwrite").save()
    m = seen.get
    assert (m["texts"], m["entities"]) == (4, 4)
    assert {t: (m[f"n_entities.{t}"], m[f"n_texts.{t}"]) for t in want} == want == {"EMAIL_ADDRESS": (3, 2), "PHONE_NUMBER": (1, 1)}


def test_only_contacts_of_chosen_conversations_are_masked(spark):
    contacts = spark.createDataFrame([(i, "n", "a@b.ru", None, None, None) for i in range(5)], "id int, name string, email string, phone string, additional_attributes string, custom_attributes string")
    talks = spark.createDataFrame([(i, i % 5, "u", 1, "", None, None) for i in range(10)], "id int, contact_id int, uuid string, display_id int, identifier string, additional_attributes string, custom_attributes string")
    words = spark.createDataFrame([], tables.MESSAGES)
    r = conversation.assemble(talks, contacts, words, spark.createDataFrame([(3,), (3,), (77,)], "id int"))
    assert [(x.id, x.contact.email, x.total_entities_found) for x in r.collect()] == [(3, "<EMAIL>", 1)]
    assert r._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi") >= 3
