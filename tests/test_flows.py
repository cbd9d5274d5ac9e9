import hashlib
import hmac
import io
import json
import zipfile

from pyspark.sql import functions as F

from veilwork.operators import conversation, evaluate, generate
from veilwork.operators.jsonmask import mask_columns, mask_json
from veilwork.sources import conll, docx, pdf
from veilwork.sources.tables import CONTACTS, CONVERSATIONS, MESSAGES, check_text, read_files, read_labelled
from veilwork.streaming import webhook


def test_json(spark):
    data = {"a@b.ru": "a@b.ru", "n": 1, "b": True, "z": None, "list": ["+79991234567", {"deep": "x \" \\ c@d.ru и e@f.ru"}], "u": "é \n"}
    df = spark.createDataFrame([(json.dumps(data),), (None,), ("[]",), ('"a@b.ru"',)], "t string")
    r = [x.r for x in df.select(mask_json(F.col("t")).alias("r")).collect()]
    got = json.loads(r[0].anonymized)
    assert got == data | {"a@b.ru": "<EMAIL>", "list": ["<PHONE>", {"deep": "x \" \\ <EMAIL> и <EMAIL_2>"}]}
    assert [e.entity_type for e in r[0].entities_found] == ["EMAIL_ADDRESS", "PHONE_NUMBER", "EMAIL_ADDRESS", "EMAIL_ADDRESS"]
    assert r[1] is None and r[2].anonymized == "[]" and r[3].anonymized == '"<EMAIL>"'


def test_long_json(spark):
    text = json.dumps({"t": "word \\ \" " * 20000 + "a@b.ru"})
    r = spark.createDataFrame([(text,)], "t string").select(mask_json(F.col("t")).alias("r")).first().r
    assert json.loads(r.anonymized)["t"].endswith("<EMAIL>")


def test_typed(spark):
    df = spark.createDataFrame([({"k": "a@b.ru"}, [("a@b.ru", 3)], None)], "m map<string,string>, s array<struct<t:string,n:int>>, z struct<t:string>")
    r = mask_columns(df, ["m", "s", "z"]).first()
    assert (r.m, r.s[0].t, r.s[0].n, r.z) == ({"k": "<EMAIL>"}, "<EMAIL>", 3, None)


def test_conversations(spark):
    contacts = spark.createDataFrame([(1, 1, "x", "a@b.ru", "+79991234567", None, '{"c": "d@e.ru"}', "", None, None, None)], CONTACTS)
    conv = spark.createDataFrame([(10, 1, "u", 1, "", None, None, None), (11, 9, "u", 2, None, None, None, None)], CONVERSATIONS)
    msg = spark.createDataFrame([(3, 10, 0, "тел 89991234567", None, "Contact", None), (2, 10, 0, "", None, "Contact", None)], MESSAGES)
    ids = spark.createDataFrame([(10,), (10,), (11,), (77,)], "id int")
    r = conversation.assemble(conv, contacts, msg, ids).orderBy("id").collect()
    assert [x.id for x in r] == [10, 11]
    assert (r[0].contact.email, r[0].contact.additional_attributes, r[0].contact.custom_attributes) == ("<EMAIL>", '{"c": "<EMAIL>"}', None)
    assert [(m.id, m.content) for m in r[0].messages] == [(2, None), (3, "тел <PHONE>")]
    assert (r[0].total_entities_found, r[1].total_entities_found, r[1].contact, r[1].messages) == (4, 0, None, [])
    t = conversation.batch_totals(ids, conversation.assemble(conv, contacts, msg, ids)).first()
    assert (t.total, t.processed, t.total_entities) == (4, 2, 4)


def test_webhook_stream(spark, tmp_path):
    body = json.dumps({"event": "message_created", "id": 5, "content": "почта a@b.ru", "conversation": {"id": 7}, "sender": {"name": "x", "email": "c@d.ru"}, "more": 1}, ensure_ascii=False)
    sign = lambda b: hmac.new(b"key" * 40, b.encode(), hashlib.sha256).hexdigest()
    rows = [(body, sign(body)), (body, "00"), ("not json", sign("not json")), ("{}", sign("{}")), (body, None)]
    spark.createDataFrame(rows, "value string, signature string").write.json(str(tmp_path / "in"))
    events = spark.readStream.schema("value string, signature string").json(str(tmp_path / "in"))
    q = webhook.stream(events, str(tmp_path / "out"), str(tmp_path / "ck"), "key" * 40)
    q.processAllAvailable()
    q.stop()
    r = spark.read.parquet(str(tmp_path / "out")).orderBy(F.desc("total_entities")).collect()
    assert len(r) == 3
    assert (r[0].content, json.loads(r[0].sender), r[0].conversation_id, r[0].total_entities) == ("почта <EMAIL>", {"name": "x", "email": "<EMAIL>"}, 7, 2)
    assert all(x.total_entities == 0 and x.content is None for x in r[1:])


def test_conll(spark, tmp_path):
    (tmp_path / "a.conll").write_text("Анна\tB-PERSON\nздесь\n\nИНН\tO\n77\tB-INN\n")
    r = conll.read_conll(spark, str(tmp_path / "a.conll"), ["B-PERSON", "I-PERSON"])
    rows = [[(t.token, t.tag) for t in x.tokens] for x in r.orderBy("sent_id").collect()]
    assert rows == [[("Анна", "B-PERSON"), ("здесь", "O")], [("ИНН", "O"), ("77", "O")]]
    conll.write_conll(r, str(tmp_path / "out"))
    again = conll.read_conll(spark, str(tmp_path / "out"))
    assert sorted([[(t.token, t.tag) for t in x.tokens] for x in again.collect()]) == sorted(rows)
    person = r.select(conll.only_person(F.col("tokens")).alias("t")).first().t
    assert person[0].tag == "B-PERSON"


def test_labelled_and_limits(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text": "x", "spans": [{"start": 0, "stop": 1, "type": "INN"}]}\n\n')
    assert read_labelled(spark, str(tmp_path / "a.jsonl")).first().spans[0].type == "INN"
    df = spark.createDataFrame([("",), ("x",), ("x" * 50_001,), (None,)], "t string")
    assert [x[0] for x in df.select(check_text(F.col("t"))).collect()] == ["empty", None, "too long", "empty"]


def docx_bytes():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda *runs: "<w:p>" + "".join(f"<w:r><w:t>{r}</w:t></w:r>" for r in runs) + "</w:p>"
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    body = p("Почта a@", "b.ru", " тут") + f"<w:tbl><w:tr>{cell('ИНН')}{cell('772012345678')}</w:tr></w:tbl>" + "<w:p><w:del><w:r><w:delText>секрет</w:delText></w:r></w:del></w:p>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("word/footer1.xml", f"<w:ftr {w}>{p('Тел. +79991234567')}</w:ftr>")
        z.writestr("docProps/core.xml", '<c:p xmlns:c="x" xmlns:d="y"><d:creator>Иван</d:creator></c:p>')
    return out.getvalue()


def test_docx(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.docx").write_bytes(docx_bytes())
    (tmp_path / "in/b.docx").write_bytes(b"broken")
    (tmp_path / "in/c.txt").write_bytes(b"x")
    files = read_files(spark, str(tmp_path / "in")).cache()
    assert {x.path[-5:]: x.rejected for x in files.collect()} == {".docx": None, "c.txt": "unsupported format"}
    good = files.filter("rejected is null")
    masked = docx.mask_paragraphs(docx.read_paragraphs(good))
    out = {x.out_name: x for x in docx.write_back(good, masked).collect()}
    assert out["anonymized_b.docx"].content is None
    with zipfile.ZipFile(io.BytesIO(out["anonymized_a.docx"].content)) as z:
        text = " ".join(z.read(n).decode() for n in z.namelist())
    for gone in ("a@", "772012345678", "+7999", "секрет", "Иван"):
        assert gone not in text
    assert "&lt;EMAIL&gt;" in text and "&lt;INN&gt;" in text and "&lt;PHONE&gt;" in text


def test_pdf_boxes(spark):
    words = spark.createDataFrame([("d", 1, i, t, float(i), 0.0, i + 1.0, 1.0) for i, t in enumerate(["Тел.", "+7", "999", "да"])], "doc string, page int, idx int, text string, x0 double, top double, x1 double, bottom double")
    spans = spark.createDataFrame([("d", 1, 5, 11)], "doc string, page int, start int, end int")
    r = pdf.boxes(words, spans, 144).orderBy("idx").collect()
    assert [(x.text, x.x0) for x in r] == [("+7", 2.0), ("999", 4.0)]
    assert pdf.page_texts(words).first().text == "Тел. +7 999 да"


def test_evaluation(spark):
    span = "array<struct<entity_type:string,start:int,end:int>>"
    df = spark.createDataFrame([([("INN", 0, 5), ("INN", 6, 9)], [("INN", 0, 5), ("INN", 7, 8), ("SNILS", 20, 22)])], f"gold {span}, predicted {span}")
    strict = {r.entity_type: (r.tp, r.fp, r.fn) for r in evaluate.match_counts(df).collect()}
    relaxed = {r.entity_type: (r.tp, r.fp, r.fn) for r in evaluate.match_counts(df, strict=False).collect()}
    assert strict == {"INN": (1, 1, 1), "SNILS": (0, 1, 0)} and relaxed == {"INN": (2, 0, 0), "SNILS": (0, 1, 0)}
    r = {x.entity_type: x for x in evaluate.prf2(evaluate.match_counts(df, strict=False)).collect()}
    assert r["INN"].f2 == 1.0 and r["SNILS"].precision == 0.0 and r["micro"].tp == 2 and r["macro"].precision == 0.5
    leak = spark.range(1).select(evaluate.leaked(F.lit(" a "), F.lit("xay")), evaluate.leaked(F.lit(" "), F.lit("x")), evaluate.name_leaked(F.lit("Иванов И. Пётр"), F.lit("тут Пётр"))).first()
    assert tuple(leak) == (True, None, True)


def test_generators(spark):
    from veilwork.functions import checks

    made = spark.range(200).select(*[f((F.col("id") * 7919 + 13)).alias(n) for n, f in (("a", generate.make_inn10), ("b", generate.make_inn12), ("c", generate.make_snils))])
    bad = made.filter(~(checks.inn_valid(F.col("a")) & checks.inn_valid(F.col("b")) & checks.snils_valid(F.col("c"))))
    assert bad.count() == 0
    split = generate.split_exact(spark.range(1000), {"train": 0.7, "dev": 0.15, "test": 0.15}, "id")
    assert {r.split: r["count"] for r in split.groupBy("split").count().collect()} == {"train": 700, "dev": 150, "test": 150}
