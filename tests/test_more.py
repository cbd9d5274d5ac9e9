import io
import zipfile
from xml.etree import ElementTree as ET

import pytest
from pyspark.sql import functions as F

from veilwork.operators import evaluate, generate, mask
from veilwork.operators.jsonmask import mask_json
from veilwork.operators.person import PersonModel, PersonRules, complete, model_spans, require_person
from veilwork.operators.recognizers import describe, registry
from veilwork.sources import docx, pdf, tables
from veilwork.sources.settings import settings
from veilwork.streaming import webhook

NAME = "Меня зовут Иванова Мария Петровна"


def test_a_text_without_matches_is_searched_once(spark):
    plan = spark.createDataFrame([("x",)], "t string").select(mask.anonymize(F.col("t")).alias("r"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") <= 45 and "Exchange" not in plan and "Python" not in plan


def test_names_do_not_leak_by_default(spark):
    df = spark.createDataFrame([(NAME,)], "t string")
    assert df.select(mask.anonymize(F.col("t"))["anonymized"]).first()[0] == "Меня зовут <PERSON>"
    assert df.select(mask_json(F.lit('{"n": "' + NAME + '"}'))["anonymized"]).first()[0] == '{"n": "Меня зовут <PERSON>"}'
    assert any(r.entity == "PERSON" for r in require_person(complete())) and "person_rules" not in [r.name for r in complete(without=("person_rules",))]
    with pytest.raises(ValueError):
        require_person(registry())
    assert describe(complete())["status"] == "ok" and describe()["status"] == "degraded" and describe()["supported"] == sorted(describe()["supported"])


def test_a_model_finds_names(spark):
    def load():
        return lambda text: [(text.index("Zed"), text.index("Zed") + 3)] if "Zed" in text else []

    df = model_spans(spark.createDataFrame([("I am Zed now",), ("nobody",), (None,)], "t string"), "t", PersonModel(load=load))
    got = [r[0] for r in df.select(mask.anonymize(F.col("t"), recognizers=registry(), found=F.col("person_spans"))["anonymized"]).collect()]
    assert got == ["I am <PERSON> now", "nobody", None]


def test_blanks_after_a_json_key(spark):
    text = '{"a@b.ru"' + " " * 500 + ': 1, "k": "a@b.ru"' + " " * 500 + "}"
    got = spark.range(1).select(mask_json(F.lit(text))["anonymized"]).first()[0]
    assert got.startswith('{"a@b.ru"') and '"<EMAIL>"' in got


def test_context_far_before_a_span(spark):
    near = spark.range(1).select(mask.anonymize(F.lit("родился" + " " * 900 + "01.02.1990"), recognizers=tuple(r for r in registry() if r.name == "birth"))["entities_found"]).first()[0]
    assert near[0].score == 0.75


def test_aliases_and_error_classes(spark):
    span = "array<struct<entity_type:string,start:int,end:int>>"
    rows = [([("DATE_OF_BIRTH", 0, 5)], [("DATE_TIME", 0, 5)]), ([("PERSON", 0, 9), ("PERSON", 20, 25)], [("PERSON", 1, 9), ("PERSON", 40, 45)]), ([("PERSON", 0, 4)], [("PERSON", 0, 4)])]
    df = spark.createDataFrame(rows, f"gold {span}, predicted {span}")
    assert {r.entity_type: (r.tp, r.fp, r.fn) for r in evaluate.match_counts(df).collect()} == {"DATE_OF_BIRTH": (1, 0, 0), "PERSON": (1, 2, 2)}
    assert {r["class"]: r.n for r in evaluate.error_classes(df).collect()} == {"correct": 1, "partial": 1, "missing": 2, "spurious": 1}
    names = spark.createDataFrame([("иван",), ("Иван Орлов",), ("И.П. Орлов",), ("Иван Петрович Орлов",)], "n string")
    got = [tuple(r) for r in names.select(evaluate.letter_case(F.col("n")), evaluate.name_format(F.col("n"))).collect()]
    assert got == [("lower", "1 word"), ("capital", "2 words"), ("capital", "initials"), ("capital", "3 words")]


def test_generated_texts(spark):
    made = generate.negatives(spark.range(350), "id").collect()
    assert len(made) == 350 and {r.kind for r in made} == set(generate.NEGATIVE_SHARES) and all((len(r.spans) == 1) == (r.kind == "person_town") for r in made)
    people = spark.range(2000).select(generate.person(F.col("id")).alias("p")).select("p.*").collect()
    assert {r.case for r in people} == set(generate.CASES) and {r.format for r in people} == set(generate.FORMATS)
    assert 0.1 < sum(r.text == r.text.lower() for r in people) / 2000 < 0.3
    for r in made:
        for s in r.spans:
            assert r.text[s.start : s.stop].strip() == r.text[s.start : s.stop] != ""
    corpus = generate.silver_corpus(spark, 3000).filter("text is not null").count()
    assert corpus == 3000


def test_settings(spark):
    assert settings(spark).document_max_pages == tables.MAX_PAGES and settings(spark).allow_no_person is False
    spark.conf.set("spark.veilwork.document_max_bytes", "5")
    spark.conf.set("spark.veilwork.webhook_enabled", "true")
    try:
        with pytest.raises(ValueError):
            settings(spark)
        spark.conf.set("spark.veilwork.database_url", "jdbc:x")
        assert (settings(spark).document_max_bytes, settings(spark).webhook_enabled) == (5, True)
    finally:
        for k in ("document_max_bytes", "webhook_enabled", "database_url"):
            spark.conf.unset(f"spark.veilwork.{k}")


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "e.csv").write_text('text,entity_type,entity_value,start,end\n"a ""b""\nc",INN,1,0,1\n', encoding="utf-8")
    assert [tuple(r) for r in tables.read_entities(spark, str(tmp_path / "e.csv")).collect()] == [('a "b"\nc', "INN", "1", 0, 1)]
    rows = spark.createDataFrame([("t a", [(0, 1, "INN")], 3)], "text string, spans array<struct<start:int,stop:int,type:string>>, n int")
    tables.write_labelled(rows, str(tmp_path / "l"))
    assert [tuple(r) for r in tables.read_labelled(spark, str(tmp_path / "l")).collect()] == [("t a", [(0, 1, "INN")])]
    tables.write_corpus(spark.createDataFrame([("a\nb",), ("c",)], "text string"), str(tmp_path / "c"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "c")).collect()) == ["a b", "c"]
    tables.write_metrics(rows.select("n"), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).first().n == 3
    done = spark.createDataFrame([("a@b.ru",), ("a@b.ru c@d.ru",), ("x",)], "t string").select(mask.anonymize(F.col("t")).alias("result"))
    assert [tuple(r) for r in tables.audit(done).collect()] == [("EMAIL_ADDRESS", 3, 2)]
    both = tables.union_weighted((rows, 1.0), (rows, 0.5)).select("weight").collect()
    assert sorted(r.weight for r in both) == [0.5, 1.0]
    with pytest.raises(ValueError):
        tables.read_jdbc(spark, "jdbc:x", "t", ids=[])
    assert tables.spread(spark.range(10, numPartitions=1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert tables.spread(spark.range(10, numPartitions=50)).rdd.getNumPartitions() == 50
    words = spark.createDataFrame([("d", 1), ("d", 200), ("e", 1)], "doc string, page int")
    assert {r.doc: r.rejected for r in pdf.within_limit(words).collect()} == {"d": "too many pages", "e": None}


def test_a_response_for_each_event(spark, tmp_path):
    rows = [('{"id": 5, "content": "a@b.ru"}',), ('{"id": 6, "content": "x"}',)]
    spark.createDataFrame(rows, "value string").write.text(str(tmp_path / "in"))
    seen = []
    q = webhook.respond(spark.readStream.text(str(tmp_path / "in")), lambda batch: seen.extend(batch.collect()), str(tmp_path / "ck"), str(tmp_path / "ledger"))
    q.processAllAvailable()
    q.stop()
    assert sorted((r.message_id, r.content) for r in seen) == [(5, "<EMAIL>"), (6, "x")]


WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
MC = "http://schemas.openxmlformats.org/markup-compatibility/2006"
W14 = "http://schemas.microsoft.com/office/word/2010/wordml"


def archive(document):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", document)
    return out.getvalue()


def test_documents_keep_their_namespaces(spark, monkeypatch):
    body = "<w:body><w:p><w:r><w:t>почта a@b.ru</w:t></w:r></w:p></w:body>"
    good = archive(f'<w:document xmlns:w="{WORD}" xmlns:mc="{MC}" xmlns:w14="{W14}" mc:Ignorable="w14">{body}</w:document>')
    files = spark.createDataFrame([("x/a.docx", bytearray(good))], "path string, content binary")
    done = docx.write_back(files, docx.mask_paragraphs(docx.read_paragraphs(files))).first()
    text = zipfile.ZipFile(io.BytesIO(done.content)).read("word/document.xml").decode()
    assert 'mc:Ignorable="w14"' in text and f'xmlns:w14="{W14}"' in text and "<w:t>почта &lt;EMAIL&gt;</w:t>" in text and "ns0:" not in text
    assert ET.fromstring(text).tag == f"{{{WORD}}}document"
    assert done.summary == '{"entities":1,"paragraphs":1,"tracked_insertions":false,"comments":false}'


def test_archives_that_unpack_to_too_much(spark):
    bomb = archive(f'<w:document xmlns:w="{WORD}">' + " " * (docx.MAX_UNPACKED + 1) + "</w:document>")
    assert len(bomb) < tables.MAX_FILE_BYTES
    files = spark.createDataFrame([("a.docx", bytearray(bomb))], "path string, content binary")
    assert docx.read_paragraphs(files).count() == 0
    done = docx.write_back(files, docx.mask_paragraphs(docx.read_paragraphs(files))).first()
    assert done.content is None and done.summary is None


def test_rules_for_names_are_a_recognizer():
    assert PersonRules().entity == "PERSON"


def test_recall_of_rules_by_case(spark):
    made = spark.range(400).select(generate.person(F.col("id")).alias("p")).select("p.text", "p.case")
    gold = F.array(F.struct(F.lit(0).alias("start"), F.length("text").alias("end"), F.lit("PERSON").alias("entity_type"), F.col("case")))
    rows = made.select("text", "case", gold.alias("gold"), PersonRules().spans(F.col("text"), 0).alias("predicted"))
    want = {}
    for r in rows.collect():
        hit = any(s.start < len(r.text) and s.end > 0 for s in r.predicted)
        tp, fn = want.get(r.case, (0, 0))
        want[r.case] = (tp + hit, fn + (not hit))
    got = {r.bucket: (r.tp, r.fn) for r in evaluate.recall_by(rows, "case").collect()}
    assert got == want and set(got) == set(generate.CASES) and all(0 < tp and 0 < fn for tp, fn in got.values())
