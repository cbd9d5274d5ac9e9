"""The driver's queries on the synthetic tables, each with its SQL.

The tables hold no Russian identifiers, so texts are derived from keys by SQL
expressions that Spark and DuckDB share.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checks
from ..functions.spans import cut, find_all
from ..operators import chunks, conversation, evaluate, generate, intervals, mask, tagger
from ..operators.jsonmask import json_leaves, mask_json
from ..operators.person import PersonRules
from ..operators.recognizers import RECOGNIZERS, Recognizer, registry
from ..sources import pdf
from ..sources.tables import dealt, spread, union_weighted
from ..streaming import webhook

Query = Callable[[SparkSession, str], DataFrame]
BY_NAME = {r.name: r for r in registry()}


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None = None


FOUND: dict[str, Entry] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        FOUND[f.__name__] = Entry(f, sql)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(*names: str) -> tuple[Recognizer, ...]:
    return tuple(BY_NAME[n] for n in names)


def values(text: Column, *names: str) -> Column:
    """Resolved values by start, joined."""
    return F.array_join(F.transform(mask.anonymize(text, recognizers=only(*names))["entities_found"], lambda e: e["value"]), "|")


# --- Detection over real texts --------------------------------------------------

EMAIL_RX, IP_RX, DATE_RX, URL_RX = (BY_NAME[n].patterns[0][0] for n in ("email", "ip", "date", "url"))
CARD_RX = BY_NAME["card"].patterns[1][0]  # it finds all that the other one finds


def _found_sql(rx: str) -> str:
    return f"""
      SELECT doc_id, len(m) AS n, array_to_string(m, '|') AS found FROM (
        SELECT doc_id, regexp_extract_all(text, '{rx}') AS m FROM documents) t"""


def _found(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spans = BY_NAME[name].spans(F.col("text"), 0)
    one = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", spans.alias("s"))
    return one.select("doc_id", F.size("s").alias("n"), F.array_join(F.transform("s", lambda s: cut(F.col("text"), s)), "|").alias("found"))


@query(_found_sql(EMAIL_RX))
def find_email(spark, sf_dir):
    return _found(spark, sf_dir, "email")


@query(_found_sql(IP_RX))
def find_ip(spark, sf_dir):
    return _found(spark, sf_dir, "ip")


@query(_found_sql(CARD_RX))
def find_card(spark, sf_dir):
    kept = mask.resolve(BY_NAME["card"].spans(F.col("text"), 0))
    one = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", F.array_sort(F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))).alias("s"))
    return one.select("doc_id", F.size("s").alias("n"), F.array_join(F.transform("s", lambda s: cut(F.col("text"), s)), "|").alias("found"))


@query(f"""
  SELECT doc_id, i AS nth, substr(text, CAST(start_ AS BIGINT) + 1, len(m[i])) AS value, CAST(start_ AS INTEGER) AS start_at FROM (
    SELECT doc_id, text, m, i, list_sum(list_transform(g[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: len(x))), 0) AS start_
    FROM (SELECT doc_id, text, regexp_extract_all(text, '{EMAIL_RX}') AS m, string_split_regex(text, '{EMAIL_RX}') AS g, unnest(range(1, len(regexp_extract_all(text, '{EMAIL_RX}')) + 1)) AS i
          FROM documents) a) b""")
def find_email_offsets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", find_all(F.col("text"), "(?iUsm)" + EMAIL_RX).alias("s"))
    rows = docs.select("doc_id", "text", F.posexplode_outer("s").alias("i", "span")).filter(F.col("i").isNotNull())  # outer: see mapping_entries
    return rows.select("doc_id", (F.col("i") + 1).cast("long").alias("nth"), cut(F.col("text"), F.col("span")).alias("value"), F.col("span.start").alias("start_at"))


def _masked_sql() -> str:
    """Masking as SQL, for the kinds that occur in the texts: their matches, resolved one by one in order, numbered, put in."""
    kinds = [(n, i) for n in ("email", "email_spoken", "birth", "card", "date", "url", "ip") for i in range(len(BY_NAME[n].patterns))]
    found = []
    for name, i in kinds:
        r = BY_NAME[name]
        rx, score = r.patterns[i]
        rx = "(?i)" + rx.replace("'", "''").replace(r"[\w", r"[\p{L}\p{M}\p{N}_")
        base = mask.PLACEHOLDERS.get(r.entity, mask.OTHER)
        found.append(f"""SELECT doc_id, '{r.entity}' AS kind, '{base}' AS base, {score} AS score, {list(BY_NAME).index(name)} AS nth,
          regexp_extract_all(text, '{rx}') AS m, string_split_regex(text, '{rx}') AS g FROM documents WHERE regexp_matches(text, '{rx}')""")
    return f"""
  WITH RECURSIVE found AS ({" UNION ALL ".join(found)}),
  each_ AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM found),
  spans AS (
    SELECT doc_id, kind, base, score, nth, m[i] AS v, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS b FROM each_),
  ordered AS (SELECT *, b + length(v) AS e, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, length(v) DESC, b, nth) AS k FROM spans),
  walk AS (
    SELECT doc_id, k, [{{'b': b, 'e': e, 'k': k}}] AS kept FROM ordered WHERE k = 1
    UNION ALL
    SELECT w.doc_id, o.k, CASE WHEN len(list_filter(w.kept, lambda x: x.b < o.e AND o.b < x.e)) > 0 THEN w.kept ELSE list_append(w.kept, {{'b': o.b, 'e': o.e, 'k': o.k}}) END
    FROM walk w JOIN ordered o ON o.doc_id = w.doc_id AND o.k = w.k + 1),
  chosen AS (SELECT doc_id, unnest(kept).k AS k FROM (SELECT doc_id, kept, row_number() OVER (PARTITION BY doc_id ORDER BY k DESC) AS r FROM walk) t WHERE r = 1),
  named AS (
    SELECT o.*, CASE WHEN row_number() OVER base_ = 1 THEN base ELSE concat(rtrim(base, '>'), '_', CAST(row_number() OVER base_ AS VARCHAR), '>') END AS name, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS before
    FROM ordered o JOIN chosen c USING (doc_id, k) WINDOW base_ AS (PARTITION BY doc_id, base ORDER BY b)),
  joined AS (
    SELECT n.doc_id, concat(string_agg(concat(substr(text, CAST(before + 1 AS BIGINT), CAST(b - before AS BIGINT)), name), '' ORDER BY b), substr(any_value(text), CAST(max(e) + 1 AS BIGINT))) AS anonymized,
      concat('[', string_agg(concat('{{"entity_type":"', kind, '","start":', b, ',"end":', e, ',"score":', CAST(score AS DOUBLE), ',"value":', CAST(to_json(v) AS VARCHAR), '}}'), ',' ORDER BY b), ']') AS entities_found,
      concat('{{', string_agg(concat('"', name, '":', CAST(to_json(v) AS VARCHAR)), ',' ORDER BY b), '}}') AS mapping
    FROM named n JOIN documents d ON d.doc_id = n.doc_id GROUP BY n.doc_id)
  SELECT d.doc_id, coalesce(anonymized, text) AS anonymized, coalesce(entities_found, '[]') AS entities_found, coalesce(mapping, '{{}}') AS mapping FROM documents d LEFT JOIN joined j ON d.doc_id = j.doc_id"""


@query(_masked_sql())
def mask_documents(spark, sf_dir):
    """The flagship: every document masked, with its entities and mapping."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    r = docs.select("doc_id", mask.anonymize(F.col("text")).alias("r"))
    return r.select("doc_id", "r.anonymized", F.to_json("r.entities_found").alias("entities_found"), F.to_json("r.mapping").alias("mapping"))


# --- Detection over texts derived from keys -------------------------------------

N = "lpad(CAST(c_custkey * 7919 % 1000000000 AS STRING), CAST(9 + c_custkey % 4 AS INT), '1')"
PHONE = "concat('+7 (9', lpad(CAST(c_custkey % 100 AS STRING), 2, '0'), ') ', lpad(CAST(c_custkey * 31 % 1000 AS STRING), 3, '0'), '-', lpad(CAST(c_custkey * 17 % 100 AS STRING), 2, '0'), '-', lpad(CAST(c_custkey * 13 % 100 AS STRING), 2, '0'))"
MAIL = "concat('user', CAST(c_custkey AS STRING), '@mail.ru')"
CARD = "concat('4', lpad(CAST(c_custkey % 1000 AS STRING), 3, '0'), ' ', lpad(CAST(c_custkey * 7 % 10000 AS STRING), 4, '0'), ' ', lpad(CAST(c_custkey * 11 % 10000 AS STRING), 4, '0'), ' 0042')"
BORN = "concat(lpad(CAST(1 + c_custkey % 28 AS STRING), 2, '0'), '.', lpad(CAST(1 + c_custkey % 12 AS STRING), 2, '0'), '.', CAST(1950 + c_custkey % 50 AS STRING))"
GAPS = "CASE c_custkey % 3 WHEN 0 THEN ' ' WHEN 1 THEN ': № ' ELSE ' гражданина ' END"
CONTACT = f"concat('Тел. ', {PHONE}, ', почта ', {MAIL}, ', карта ', {CARD}, '.')"


def _customers(spark: SparkSession, sf_dir: str, **exprs: str) -> DataFrame:
    return dealt(table(spark, sf_dir, "customer")).select("c_custkey", *[F.expr(v).alias(k) for k, v in exprs.items()])


def _by_key(name: str, text: str, expected: str, *recognizers: str) -> None:
    """A query that must find ``expected`` in ``text``, both SQL expressions over ``customer``."""

    def run(spark, sf_dir):
        return _customers(spark, sf_dir, t=text).select("c_custkey", values(F.col("t"), *recognizers).alias("found"))

    FOUND[name] = Entry(run, f"SELECT c_custkey, {expected} AS found FROM customer")


_by_key("find_phone", f"concat('Звоните: ', {PHONE}, ' или 8-916-000-', lpad(CAST(c_custkey % 100 AS STRING), 2, '0'), '-11, не ', {N})", f"concat({PHONE}, '|8-916-000-', lpad(CAST(c_custkey % 100 AS STRING), 2, '0'), '-11')", "phone")
_by_key("anchored_inn", f"concat('Указан ИНН', {GAPS}, substr({N}, 1, 2), '-', substr({N}, 3, 20), ' в анкете.')", f"CASE WHEN length({N}) IN (10, 12) THEN concat(substr({N}, 1, 2), '-', substr({N}, 3, 20)) ELSE '' END", "inn_anchored")
_by_key("anchored_snils", f"concat('СНИЛС', {GAPS}, substr({N}, 1, 3), '-', substr({N}, 4, 3), '-', substr({N}, 7, 9), ' клиента.')", f"CASE WHEN length({N}) = 11 THEN concat(substr({N}, 1, 3), '-', substr({N}, 4, 3), '-', substr({N}, 7, 9)) ELSE '' END", "snils_anchored")
_by_key("anchored_passport", f"concat('Паспорт', {GAPS}, substr({N}, 1, 2), ' ', substr({N}, 3, 2), ' ', substr({N}, 5, 3), ' ', substr({N}, 8, 3), '; выдан.')", f"CASE WHEN length({N}) >= 10 THEN concat(substr({N}, 1, 2), ' ', substr({N}, 3, 2), ' ', substr({N}, 5, 3), ' ', substr({N}, 8, 3)) ELSE '' END", "passport_anchored")
_by_key("anchored_birth", f"concat('Дата рождения клиента: ', {BORN}, ' г.')", BORN, "birth_anchored")
_by_key("anchored_card", f"concat('Карта', {GAPS}, substr({N}, 1, 4), ' ', substr({N}, 5, 20), ' привязана.')", f"CASE WHEN length({N}) = 12 THEN concat(substr({N}, 1, 4), ' ', substr({N}, 5, 20)) ELSE '' END", "card_anchored")
_by_key("address_spans", "concat('Живу: г. Москва, ул. Ленина, д. ', CAST(c_custkey % 90 AS STRING), ', кв. ', CAST(c_custkey % 400 AS STRING), '. Город Тверь знаю.')", "concat('г. Москва, ул. Ленина, д. ', CAST(c_custkey % 90 AS STRING), ', кв. ', CAST(c_custkey % 400 AS STRING))", "address")
_by_key("spoken_email", "concat('Пишите: user', CAST(c_custkey AS STRING), ' собака mail точка ru.')", "concat('user', CAST(c_custkey AS STRING), ' собака mail точка ru')", "email_spoken")
_by_key("passport_by_word", f"concat('Документ ', substr(lpad({N}, 12, '7'), 1, 4), ' номер ', substr(lpad({N}, 12, '7'), 5, 6), '.')", f"concat(substr(lpad({N}, 12, '7'), 1, 4), ' номер ', substr(lpad({N}, 12, '7'), 5, 6))", "passport")

_by_key("find_birth", f"concat('Родился ', {BORN}, ' в Твери; счёт от 3.4.2020.')", BORN, "birth")
_by_key("passport_series_first", "concat('Вот: серия 45', ' ', lpad(CAST(c_custkey % 100 AS STRING), 2, '0'), ' номер 123 ', lpad(CAST(c_custkey % 1000 AS STRING), 3, '0'), '.')", "concat('серия 45', ' ', lpad(CAST(c_custkey % 100 AS STRING), 2, '0'), ' номер 123 ', lpad(CAST(c_custkey % 1000 AS STRING), 3, '0'))", "passport_anchored")
_by_key("passport_number_first", "concat('Вот: номер 123', lpad(CAST(c_custkey % 1000 AS STRING), 3, '0'), ', серия 45 ', lpad(CAST(c_custkey % 100 AS STRING), 2, '0'), '.')", "concat('номер 123', lpad(CAST(c_custkey % 1000 AS STRING), 3, '0'), ', серия 45 ', lpad(CAST(c_custkey % 100 AS STRING), 2, '0'))", "passport_anchored")
STREETS = "CASE c_custkey % 4 WHEN 0 THEN 'улице Садовой' WHEN 1 THEN 'проспекте Мира' WHEN 2 THEN 'переулке Тихом' ELSE 'набережной Реки' END"
_by_key("address_inflected", f"concat('Адрес: ', {STREETS}, ', дом ', CAST(c_custkey % 90 AS STRING), ', квартира ', CAST(c_custkey % 400 AS STRING), '.')", f"concat({STREETS}, ', дом ', CAST(c_custkey % 90 AS STRING), ', квартира ', CAST(c_custkey % 400 AS STRING))", "address")
_by_key("find_dates", f"concat('С ', {BORN}, ' по 2024-01-', lpad(CAST(1 + c_custkey % 28 AS STRING), 2, '0'), ', не 1.2.345')", f"concat({BORN}, '|2024-01-', lpad(CAST(1 + c_custkey % 28 AS STRING), 2, '0'))", "date")
_by_key("find_urls", "concat('См. https://site', CAST(c_custkey AS STRING), '.ru/a?b=1 и http://x.org, не ftp://y')", "concat('https://site', CAST(c_custkey AS STRING), '.ru/a?b=1|http://x.org,')", "url")
_by_key("find_iban", "concat('Счёт DE89 3704 0044 0532 0130 ', CASE WHEN c_custkey % 2 = 0 THEN '00' ELSE '01' END, ' открыт')", "CASE WHEN c_custkey % 2 = 0 THEN 'DE89 3704 0044 0532 0130 00' ELSE '' END", "iban")
_by_key("find_wallets", "concat('Кошельки 1A1zP1eP5QGefi2DMPTfTL5SLmv7Divf', CASE WHEN c_custkey % 3 = 0 THEN 'Na' ELSE 'Nb' END, ', bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t', CASE WHEN c_custkey % 2 = 0 THEN '4' ELSE '5' END)", "concat(CASE WHEN c_custkey % 3 = 0 THEN '1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa' ELSE '' END, CASE WHEN c_custkey % 6 = 0 THEN '|' ELSE '' END, CASE WHEN c_custkey % 2 = 0 THEN 'bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4' ELSE '' END)", "wallet", "segwit")
_by_key("find_ipv6", "concat('Узел 2001:db8::', lower(lpad(CAST(c_custkey % 10000 AS STRING), 4, '0')), ' и fe80:0:0:0:1:2:3:', CAST(c_custkey % 10 AS STRING), ' в 12:30:45')", "concat('2001:db8::', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0'), '|fe80:0:0:0:1:2:3:', CAST(c_custkey % 10 AS STRING))", "ipv6")

D9 = "lpad(CAST(o_orderkey * 7919 % 1000000000 AS STRING), 9, '0')"


def _weights(w: tuple[int, ...], s: str) -> str:
    return " + ".join(f"CAST(substr({s}, {i + 1}, 1) AS INT) * {k}" for i, k in enumerate(w))


INN_CONTROL = f"(({_weights(checks.INN10, D9)}) % 11 % 10)"
SNILS_SUM = f"(({_weights(checks.SNILS, D9)}) % 101)"
SNILS_CONTROL = f"(CASE WHEN {SNILS_SUM} = 100 THEN 0 ELSE {SNILS_SUM} END)"


@query(f"SELECT o_orderkey, {INN_CONTROL} = o_orderkey % 10 AS valid, concat({D9}, CAST({INN_CONTROL} AS STRING)) AS made FROM orders")
def inn_checksum(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    number = F.concat(F.expr(D9), (F.col("o_orderkey") % 10).cast("string"))
    return o.select("o_orderkey", checks.inn_valid(number).alias("valid"), generate.make_inn10(F.col("o_orderkey") * 7919).alias("made"))


@query(f"SELECT o_orderkey, {SNILS_CONTROL} = o_orderkey % 100 AS valid, concat(substr({D9}, 1, 3), '-', substr({D9}, 4, 3), '-', substr({D9}, 7, 3), ' ', lpad(CAST({SNILS_CONTROL} AS STRING), 2, '0')) AS made FROM orders")
def snils_checksum(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    number = F.concat(F.expr(D9), F.lpad((F.col("o_orderkey") % 100).cast("string"), 2, "0"))
    return o.select("o_orderkey", checks.snils_valid(number).alias("valid"), generate.make_snils(F.col("o_orderkey") * 7919).alias("made"))


def _numbers(spark, sf_dir, number: str, *names: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(f"concat('Код ', {number}, '.')").alias("t"))
    return o.select("o_orderkey", values(F.col("t"), *names).alias("found"))


INN_TEXT = f"concat({D9}, CAST(o_orderkey % 10 AS STRING))"
SNILS_TEXT = f"concat(substr({D9}, 1, 3), '-', substr({D9}, 4, 3), '-', substr({D9}, 7, 3), ' ', lpad(CAST(o_orderkey % 100 AS STRING), 2, '0'))"


@query(f"SELECT o_orderkey, CASE WHEN {INN_CONTROL} = o_orderkey % 10 THEN {INN_TEXT} ELSE '' END AS found FROM orders")
def find_inn(spark, sf_dir):
    return _numbers(spark, sf_dir, INN_TEXT, "inn")


@query(f"SELECT o_orderkey, CASE WHEN {SNILS_CONTROL} = o_orderkey % 100 THEN {SNILS_TEXT} ELSE '' END AS found FROM orders")
def find_snils(spark, sf_dir):
    return _numbers(spark, sf_dir, SNILS_TEXT, "snils")


@query("SELECT p_partkey, length(regexp_replace(concat(p_name, ' ', CAST(p_partkey AS STRING), '-', CAST(p_size AS STRING)), '[^0-9]', '', 'g')) AS n FROM part")
def digit_count_filter(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", checks.digit_count(F.expr("concat(p_name, ' ', CAST(p_partkey AS STRING), '-', CAST(p_size AS STRING))")).cast("long").alias("n"))


# --- Resolution, numbering, masking, restoring -----------------------------------

KIND = "CASE l_returnflag WHEN 'A' THEN 'PERSON' WHEN 'N' THEN 'INN' ELSE 'SNILS' END"
START = "CAST(l_partkey % 40 AS INT)"
STOP = "CAST(l_partkey % 40 + 1 + l_suppkey % 9 AS INT)"
SCORE = "CAST(l_linenumber % 3 AS DOUBLE)"


@query(f"""
  WITH RECURSIVE s AS (
    SELECT l_orderkey AS k, {START} AS b, {STOP} AS e, row_number() OVER (PARTITION BY l_orderkey ORDER BY {SCORE} DESC, {STOP} - {START} DESC, {START}, l_linenumber) AS i FROM lineitem),
  walk AS (
    SELECT k, i, [{{'b': b, 'e': e}}] AS kept FROM s WHERE i = 1
    UNION ALL
    SELECT w.k, s.i, CASE WHEN len(list_filter(w.kept, lambda x: x.b < s.e AND s.b < x.e)) > 0 THEN w.kept ELSE list_append(w.kept, {{'b': s.b, 'e': s.e}}) END
    FROM walk w JOIN s ON s.k = w.k AND s.i = w.i + 1),
  last_ AS (SELECT k, kept FROM (SELECT k, kept, row_number() OVER (PARTITION BY k ORDER BY i DESC) AS r FROM walk) t WHERE r = 1)
  SELECT k AS l_orderkey, len(kept) AS n, list_sum(list_transform(kept, lambda x: x.e - x.b)) AS covered, list_sum(list_transform(kept, lambda x: x.b * x.e)) AS mark FROM last_""")
def overlap_resolution(spark, sf_dir):
    span = F.struct(F.lit("PERSON").alias("entity_type"), F.expr(START).alias("start"), F.expr(STOP).alias("end"), F.expr(SCORE).alias("score"), F.col("l_linenumber").alias("rank"))
    kept = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(mask.resolve(F.collect_list(span)).alias("s"))
    total = lambda f: F.aggregate("s", F.lit(0).cast("long"), lambda acc, x: acc + f(x))
    return kept.select("l_orderkey", F.size("s").cast("long").alias("n"), total(lambda x: x["end"] - x["start"]).alias("covered"), total(lambda x: x["end"] * x["start"]).alias("mark"))


@query(f"""
  SELECT l_orderkey, l_linenumber, CASE WHEN r = 1 THEN concat('<', kind, '>') ELSE concat('<', kind, '_', CAST(r AS STRING), '>') END AS placeholder FROM (
    SELECT l_orderkey, l_linenumber, {KIND} AS kind, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber) AS r FROM lineitem) t""")
def placeholder_numbering(spark, sf_dir):
    span = F.struct(F.expr(KIND).alias("entity_type"), (F.col("l_linenumber") * 2).alias("start"), (F.col("l_linenumber") * 2 + 1).alias("end"), F.lit(1.0).alias("score"), F.lit(0).alias("rank"))
    spans = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(span).alias("s"))
    rows = spans.select("l_orderkey", F.explode(mask.numbered(F.col("s"), F.lit("x" * 40))).alias("e"))
    return rows.select("l_orderkey", (F.col("e.start") / 2).cast("int").alias("l_linenumber"), "e.placeholder")


def _masked(spark, sf_dir, disable=None) -> DataFrame:
    return _customers(spark, sf_dir, t=CONTACT).select("c_custkey", mask.anonymize(F.col("t"), disable, only("phone", "email", "card")).alias("r"))


@query(f"SELECT c_custkey, 'Тел. <PHONE>, почта <EMAIL>, карта <CREDIT_CARD>.' AS anonymized, {CONTACT} AS original, 3 AS n FROM customer")
def mask_text(spark, sf_dir):
    return _masked(spark, sf_dir).select("c_custkey", "r.anonymized", "r.original", F.size("r.entities_found").alias("n"))


@query(f"SELECT c_custkey, '<PHONE>' AS placeholder, {PHONE} AS value FROM customer UNION ALL SELECT c_custkey, '<EMAIL>', {MAIL} FROM customer UNION ALL SELECT c_custkey, '<CREDIT_CARD>', {CARD} FROM customer")
def mapping_entries(spark, sf_dir):
    # an outer explode: of an inner one Spark makes a filter that masks every text once more
    return _masked(spark, sf_dir).select("c_custkey", F.explode_outer("r.mapping").alias("placeholder", "value")).filter(F.col("placeholder").isNotNull())


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 3 ELSE 0 END AS n_mapping, CASE WHEN c_custkey % 2 = 0 THEN 3 ELSE 0 END AS n_values FROM customer")
def mapping_gate(spark, sf_dir):
    r = _masked(spark, sf_dir).select("c_custkey", mask.gated(F.col("r"), F.col("c_custkey") % 2 == 0).alias("g"))
    return r.select("c_custkey", F.size("g.mapping").alias("n_mapping"), F.size(F.filter("g.entities_found", lambda e: e["value"] != "")).alias("n_values"))


@query(f"SELECT c_custkey, {CONTACT} AS text, 3 AS replaced FROM customer")
def deanonymize_roundtrip(spark, sf_dir):
    return _masked(spark, sf_dir).select("c_custkey", mask.deanonymize(F.col("r.anonymized"), F.col("r.mapping")).alias("d")).select("c_custkey", "d.text", "d.replaced")


@query("SELECT c_custkey, 'Тел. <PHONE>, почта <MAIL>, карта <CREDIT_CARD>.' AS anonymized FROM customer")
def placeholder_map(spark, sf_dir):
    """Another placeholder for a type, as a parameter."""
    c = _customers(spark, sf_dir, t=CONTACT)
    return c.select("c_custkey", mask.anonymize(F.col("t"), recognizers=only("phone", "email", "card"), operators={"EMAIL_ADDRESS": "<MAIL>"})["anonymized"].alias("anonymized"))


@query("SELECT c_custkey, 'Меня зовут <PERSON>, живу в Твери.' AS anonymized, 1 AS n FROM customer")
def names_by_default(spark, sf_dir):
    """Nothing is chosen: names must not leak for want of a model."""
    name = "CASE c_custkey % 3 WHEN 0 THEN 'Иванова Мария Петровна' WHEN 1 THEN 'Сергей Кузнецов' ELSE 'Олег Ильич' END"
    c = _customers(spark, sf_dir, t=f"concat('Меня зовут ', {name}, ', живу в Твери.')").select("c_custkey", mask.anonymize(F.col("t")).alias("r"))
    return c.select("c_custkey", "r.anonymized", F.size("r.entities_found").alias("n"))


@query(f"""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN concat('Тел. ', {PHONE}, ', почта <EMAIL>, карта <CREDIT_CARD>.')
             WHEN 1 THEN concat('Тел. <PHONE>, почта ', {MAIL}, ', карта <CREDIT_CARD>.') ELSE 'Тел. <PHONE>, почта <EMAIL>, карта <CREDIT_CARD>.' END AS anonymized,
             CASE c_custkey % 3 WHEN 2 THEN 'NOTHING' ELSE '' END AS ignored FROM customer""")
def policy_disable(spark, sf_dir):
    off = "CASE c_custkey % 3 WHEN 0 THEN ' phone_number ,,' WHEN 1 THEN 'Email_Address' ELSE 'nothing' END"
    rows = _customers(spark, sf_dir, t=CONTACT, form=off).withColumn("off", mask.parse_disable(F.col("form")))
    types = mask.policy(RECOGNIZERS)
    r = mask.anonymize(F.col("t"), mask.narrowed(F.col("off"), types), only("phone", "email", "card"))
    return rows.select("c_custkey", r["anonymized"].alias("anonymized"), F.array_join(mask.ignored(F.col("off"), types), ",").alias("ignored"))


@query("""SELECT event_id, concat('{"user@mail.ru": {"to": "<EMAIL>"}, "n": ', CAST(event_id AS STRING), ', "list": [null, true, "x \\" <EMAIL>"]}') AS anonymized, 2 AS n FROM events""")
def json_mask(spark, sf_dir):
    body = """concat('{"user@mail.ru": {"to": "u', CAST(user_id AS STRING), '@mail.ru"}, "n": ', CAST(event_id AS STRING), ', "list": [null, true, "x \\\\" v', CAST(user_id AS STRING), '@mail.ru"]}')"""
    m = table(spark, sf_dir, "events").select("event_id", F.expr(body).alias("t"))
    r = m.select("event_id", mask_json(F.col("t"), lambda c: mask.anonymize(c, recognizers=only("email"))).alias("r"))
    return r.select("event_id", "r.anonymized", F.size("r.entities_found").alias("n"))


@query("SELECT event_id, 'Пишите <EMAIL>' AS content, '{\"name\":\"<EMAIL>\"}' AS sender, CAST(user_id AS INT) AS conversation_id, 2 AS total_entities FROM events WHERE event_id % 2 = 0")
def webhook_mask(spark, sf_dir):
    body = """concat('{"event":"message_created","id":', CAST(event_id AS STRING), ',"content":"Пишите u', CAST(user_id AS STRING), '@mail.ru","conversation":{"id":', CAST(user_id AS STRING), '},"sender":{"name":"s', CAST(user_id AS STRING), '@mail.ru"},"more":[1]}')"""
    raw = table(spark, sf_dir, "events").select("event_id", F.expr(body).alias("value"))
    signature = F.when(F.col("event_id") % 2 == 0, webhook.hmac_sha256("secret", F.col("value").cast("binary"))).otherwise("00")
    gate = webhook.signed(raw.withColumn("signature", signature), "secret")
    return webhook.mask_events(gate).select("event_id", "content", "sender", "conversation_id", "total_entities")


# --- Conversations ----------------------------------------------------------------


def _chat(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    contacts = _customers(spark, sf_dir, name="c_name", email=MAIL, phone=PHONE).withColumn("id", F.col("c_custkey")).withColumns({"additional_attributes": F.lit('{"city": "x"}'), "custom_attributes": F.lit(None).cast("string")})
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("contact_id"), F.lit("u").alias("uuid"), F.lit(1).alias("display_id"), F.lit("").alias("identifier"), F.lit(None).cast("string").alias("additional_attributes"), F.lit(None).cast("string").alias("custom_attributes"))
    content = "CASE WHEN l_linenumber % 2 = 0 THEN concat('Мой адрес m', CAST(l_partkey AS STRING), '@mail.ru') ELSE 'Спасибо' END"
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("conversation_id"), F.lit(0).alias("message_type"), F.lit("Contact").alias("sender_type"), F.expr(content).alias("content"), F.lit(None).cast("string").alias("content_attributes"), F.when(F.col("l_linenumber") != 3, F.col("l_shipdate")).alias("created_at"))
    return orders, contacts, lines


@query("""
  SELECT o_orderkey AS id, '<EMAIL>' AS email, '<PHONE>' AS phone, coalesce(n, 0) AS n_messages, CAST(coalesce(e, 0) + 2 AS BIGINT) AS total_entities_found
  FROM orders JOIN customer ON o_custkey = c_custkey
  LEFT JOIN (SELECT l_orderkey, count(*) AS n, sum(CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE 0 END) AS e FROM lineitem GROUP BY l_orderkey) l ON l_orderkey = o_orderkey""")
def conversation_join(spark, sf_dir):
    orders, contacts, lines = _chat(spark, sf_dir)
    ids = orders.select("id").union(spark.range(-3, 0).toDF("id"))
    r = conversation.assemble(orders, contacts, lines, ids)
    return r.select("id", "contact.email", "contact.phone", F.size("messages").cast("long").alias("n_messages"), "total_entities_found")


@query("""
  SELECT count(*) * 2 AS total, count(*) AS processed, CAST(sum(2 + coalesce(e, 0)) AS BIGINT) AS total_entities FROM orders
  LEFT JOIN (SELECT l_orderkey, sum(CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE 0 END) AS e FROM lineitem GROUP BY l_orderkey) l ON l_orderkey = o_orderkey""")
def batch_totals(spark, sf_dir):
    orders, contacts, lines = _chat(spark, sf_dir)
    ids = orders.select("id")
    ids = ids.union(ids)
    return conversation.batch_totals(ids, conversation.assemble(orders, contacts, lines, ids))


@query("""
  SELECT l_orderkey AS conversation_id, string_agg(CAST(l_orderkey * 10 + l_linenumber AS STRING), ',' ORDER BY CASE WHEN l_linenumber <> 3 THEN l_shipdate END NULLS FIRST, l_linenumber) AS ids
  FROM lineitem GROUP BY l_orderkey""")
def message_order(spark, sf_dir):
    _, _, lines = _chat(spark, sf_dir)
    plain = lines.select("conversation_id", "created_at", "id", F.struct("id", F.array().cast("array<int>").alias("entities_found")).alias("message"))
    return conversation.ordered_messages(plain).select("conversation_id", F.array_join(F.transform("messages", lambda m: m["id"].cast("string")), ",").alias("ids"))


# --- Words, tags, templates ----------------------------------------------------------

WORDS_SQL = """
  words AS (SELECT p_partkey, p_size, list_transform(string_split(p_name, ' '), lambda x: x) AS w FROM part),
  each_ AS (SELECT p_partkey, p_size, w, unnest(range(1, len(w) + 1)) AS i FROM words),
  placed AS (SELECT p_partkey, p_size, i, w[i] AS word, CAST(coalesce(list_sum(list_transform(w[1:i-1], lambda x: len(x) + 1)), 0) AS INT) AS b FROM each_)"""


@query(f"WITH {WORDS_SQL} SELECT p_partkey AS doc, CAST(i AS INT) AS idx, word AS text, b AS start FROM placed WHERE b < p_size % 10 + 5 AND p_size % 10 < b + len(word)")
def word_span_overlap(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    words = part.select(F.col("p_partkey").alias("doc"), F.lit(1).alias("page"), F.posexplode(F.split("p_name", " ")).alias("i", "text")).withColumn("idx", (F.col("i") + 1).cast("int"))
    spans = part.select(F.col("p_partkey").alias("doc"), F.lit(1).alias("page"), (F.col("p_size") % 10).alias("start"), (F.col("p_size") % 10 + 5).alias("end"))
    return pdf.boxes(words, spans).select("doc", "idx", "text", "start")


@query(f"""WITH {WORDS_SQL} SELECT p_partkey, string_agg(CASE WHEN b = 0 THEN 'B-PERSON' WHEN b + len(word) <= 12 THEN 'I-PERSON' ELSE 'O' END, ' ' ORDER BY i) AS tags FROM placed GROUP BY p_partkey""")
def bio_tags(spark, sf_dir):
    spans = F.array(F.struct(F.lit(0).alias("start"), F.greatest(F.lit(12), F.length(F.substring_index("p_name", " ", 1))).alias("stop"), F.lit("PERSON").alias("type")))
    words = F.transform(find_all(F.col("p_name"), "[^ ]+"), lambda s: F.struct(cut(F.col("p_name"), s).alias("token"), s["start"].alias("start"), s["end"].alias("stop")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(generate.bio(words, spans), lambda t: t["tag"]), " ").alias("tags"))


@query(f"SELECT c_custkey, concat('Я ', c_name, ', мой телефон ', {PHONE}, '.') AS text, CAST(2 AS INT) AS b1, CAST(2 + length(c_name) AS INT) AS e1, CAST(2 + length(c_name) + 14 AS INT) AS b2, CAST(2 + length(c_name) + 14 + 18 AS INT) AS e2 FROM customer")
def template_fill(spark, sf_dir):
    filled = generate.fill("Я {name}, мой телефон {phone}.", {"name": F.col("c_name"), "phone": F.col("p")}, {"name": "PERSON", "phone": "PHONE_NUMBER"})
    r = table(spark, sf_dir, "customer").withColumn("p", F.expr(PHONE)).select("c_custkey", filled.alias("f"))
    s = F.col("f.spans")
    return r.select("c_custkey", "f.text", s[0]["start"].alias("b1"), s[0]["stop"].alias("e1"), s[1]["start"].alias("b2"), s[1]["stop"].alias("e2"))


def _draw_sql(salt: int, n: str) -> str:
    return f"((({n}) % 999983 * {7919 + 2 * salt} + {104_729 * salt}) % 999979)"


def _choose_sql(values: tuple[str, ...], salt: int, n: str) -> str:
    return "([" + ", ".join(f"'{v}'" for v in values) + f"])[{_draw_sql(salt, n)} // 7 % {len(values)} + 1]"


def _template_sql(templates: tuple[str, ...], filled: dict[str, str], salt: int, n: str) -> str:
    """One of the templates with its slots filled."""
    cases = []
    for i, t in enumerate(templates):
        parts = [filled[x[1:-1]] if x[0] == "{" else "'" + x + "'" for x in re.split(r"(\{\w\})", t) if x]
        cases.append(f"WHEN {i} THEN concat({', '.join(parts)})")
    return f"CASE {_draw_sql(salt, n)} // 7 % {len(templates)} {' '.join(cases)} END"


def _person_sql(n: str) -> str:
    """``p``: names by the rules of their endings, written out by case."""
    forms = lambda kind: "([" + ", ".join(f"'{e}'" for e in generate.ENDINGS[kind]) + f"])[{_draw_sql(2, n)} // 7 % 6 + 1]"
    male = f"{_draw_sql(1, n)} % 2 = 0"
    women = tuple(x[:-1] for x in generate.FEMALE)
    first = f"CASE WHEN {male} THEN concat({_choose_sql(generate.MALE, 3, n)}, {forms('male')}) ELSE concat({_choose_sql(women, 3, n)}, {forms('female')}) END"
    father = f"concat({_choose_sql(generate.FATHERS, 4, n)}, CASE WHEN {male} THEN {forms('father_m')} ELSE {forms('father_f')} END)"
    surname = f"concat({_choose_sql(generate.SURNAMES, 5, n)}, CASE WHEN {male} THEN {forms('surname_m')} ELSE {forms('surname_f')} END)"
    return f"""(SELECT k, CASE WHEN low THEN lower(t) ELSE t END AS p, form FROM (
        SELECT k, low, form, CASE form WHEN 'fps' THEN concat(f, ' ', p, ' ', s) WHEN 'sfp' THEN concat(s, ' ', f, ' ', p) WHEN 'fs' THEN concat(f, ' ', s) WHEN 'sf' THEN concat(s, ' ', f)
          WHEN 'fp' THEN concat(f, ' ', p) ELSE concat(substr(f, 1, 1), '.', substr(p, 1, 1), '. ', s) END AS t
        FROM (SELECT {n} AS k, {first} AS f, {father} AS p, {surname} AS s, {_choose_sql(generate.FORMATS, 6, n)} AS form, {_draw_sql(7, n)} // 7 % 5 = 0 AS low FROM keys) a) b)"""


CUSTOMERS = "WITH keys AS (SELECT c_custkey FROM customer)"


@query(f"{CUSTOMERS} SELECT k AS c_custkey, p AS name, form FROM {_person_sql('c_custkey')} x")
def person_names(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", generate.person(F.col("c_custkey")).alias("p")).select("c_custkey", F.col("p.text").alias("name"), F.col("p.format").alias("form"))


@query(f"""SELECT c_custkey, concat({_choose_sql(("ivan", "anna", "sales", "info", "client"), 11, "c_custkey")}, '.', CAST({_draw_sql(12, "c_custkey")} % 1000 AS VARCHAR), '@', {_choose_sql(("mail.ru", "yandex.ru", "example.com", "test.org"), 13, "c_custkey")}) AS email,
  concat(CAST({_draw_sql(21, "c_custkey")} % 90 + 10 AS VARCHAR), ' ', CAST({_draw_sql(22, "c_custkey")} % 90 + 10 AS VARCHAR), ' ', CAST({_draw_sql(23, "c_custkey")} % 900000 + 100000 AS VARCHAR)) AS passport,
  concat(lpad(CAST({_draw_sql(31, "c_custkey")} % 28 + 1 AS VARCHAR), 2, '0'), sep, lpad(CAST({_draw_sql(32, "c_custkey")} % 12 + 1 AS VARCHAR), 2, '0'), sep, CAST({_draw_sql(33, "c_custkey")} % 51 + 1955 AS VARCHAR)) AS birth
  FROM (SELECT c_custkey, {_choose_sql((".", "/"), 34, "c_custkey")} AS sep FROM customer) c""")
def generated_values(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", generate.make_email(k).alias("email"), generate.make_passport(k).alias("passport"), generate.make_birth(k).alias("birth"))


def _negative_sql(kind: str, n: str) -> str:
    words, templates = generate.NEGATIVES[kind]
    return _template_sql(templates, {"x": _choose_sql(words, 41, n)}, 42, n)


def _negatives_sql() -> str:
    spot, kind, text, begin = f"{_draw_sql(44, 'k')} % {sum(generate.NEGATIVE_SHARES.values())}", [], [], 0
    for name, share in generate.NEGATIVE_SHARES.items():
        begin += share
        one = _template_sql(generate.WITH_TOWN, {"p": "p", "x": _choose_sql(generate.TOWNS, 41, "k")}, 42, "k") if name == "person_town" else _negative_sql(name, "k")
        kind.append(f"WHEN {spot} < {begin} THEN '{name}'")
        text.append(f"WHEN {spot} < {begin} THEN {one}")
    return f"""{CUSTOMERS} SELECT k AS c_custkey, kind, text, CASE WHEN kind = 'person_town' THEN p ELSE '' END AS name FROM (
      SELECT k, p, CASE {' '.join(kind)} END AS kind, CASE {' '.join(text)} END AS text FROM {_person_sql('c_custkey')} x) y"""


@query(_negatives_sql())
def negative_texts(spark, sf_dir):
    s = F.col("spans")
    name = F.when(F.size(s) > 0, F.substring(F.col("text"), F.get(s, F.lit(0))["start"] + 1, F.get(s, F.lit(0))["stop"] - F.get(s, F.lit(0))["start"])).otherwise("")
    return generate.negatives(table(spark, sf_dir, "customer"), "c_custkey").select("c_custkey", "kind", "text", name.alias("name"))


def _silver_sql(n: str) -> str:
    other = f"CASE WHEN {_draw_sql(54, n)} % 100 < 30 THEN {_negative_sql('town', n)} WHEN {_draw_sql(54, n)} % 100 < 55 THEN {_negative_sql('street', n)} WHEN {_draw_sql(54, n)} % 100 < 78 THEN {_negative_sql('thing', n)} ELSE {_negative_sql('firm', n)} END"
    stuck = f"concat({_choose_sql(generate.GLUE, 51, n)}, upper(substr(p, 1, 1)), substr(p, 2), ' на связи.')"
    chat = f"CASE WHEN {_draw_sql(52, n)} % 100 < 12 THEN {stuck} ELSE {_template_sql(generate.CHATS, {'p': 'p'}, 53, n)} END"
    return f"CASE WHEN {_draw_sql(55, n)} % 100 < 55 THEN {chat} ELSE {other} END"


@query(f"WITH keys AS (SELECT o_orderkey FROM orders) SELECT k AS o_orderkey, {_silver_sql('k')} AS text FROM {_person_sql('o_orderkey')} x")
def silver_texts(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", generate.silver(F.col("o_orderkey")).alias("text"))


@query("SELECT weight, count(*) AS n, CAST(sum(k) AS BIGINT) AS keys FROM (SELECT c_custkey AS k, 1.0 AS weight FROM customer UNION ALL SELECT s_suppkey, 0.5 FROM supplier UNION ALL SELECT p_partkey, 3.0 FROM part) t GROUP BY weight")
def weighted_union(spark, sf_dir):
    parts = [(table(spark, sf_dir, t).select(F.col(c).cast("long").alias("k")), w) for t, c, w in (("customer", "c_custkey", 1.0), ("supplier", "s_suppkey", 0.5), ("part", "p_partkey", 3.0))]
    return union_weighted(*parts).groupBy("weight").agg(F.count("*").alias("n"), F.sum("k").alias("keys"))


@query("SELECT split, count(*) AS n FROM (SELECT CASE WHEN row_number() OVER (ORDER BY c_custkey) <= floor(round(count(*) OVER () * 0.7, 6)) THEN 'train' WHEN row_number() OVER (ORDER BY c_custkey) <= floor(round(count(*) OVER () * 0.85, 6)) THEN 'dev' ELSE 'test' END AS split FROM customer) t GROUP BY split")
def dataset_split(spark, sf_dir):
    s = generate.split_exact(table(spark, sf_dir, "customer"), {"train": 0.7, "dev": 0.15, "test": 0.15}, "c_custkey")
    return s.groupBy("split").agg(F.count("*").alias("n"))


# --- Evaluation -------------------------------------------------------------------------

EVENT_KIND = "CASE event_id % 3 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'INN' ELSE 'SNILS' END"
PRED_KIND = f"CASE WHEN event_id % 7 = 0 THEN 'INN' ELSE {EVENT_KIND} END"
DOC, AT = "CAST(floor(event_id / 10) AS BIGINT)", "CAST(event_id % 10 * 20 AS INT)"
MATCH = f"(SELECT {DOC} AS doc_id, {AT} AS b, {EVENT_KIND} AS t, event_id % 4 AS d, {PRED_KIND} AS u, event_id % 4 = 3 AS missed, event_id % 11 = 0 AS extra FROM events) m"


def _spans(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Gold spans of ten characters, and predictions that are shifted, of another type, missing or spare."""
    events = table(spark, sf_dir, "events")
    span = lambda df, low, high, kind: df.select(F.expr(DOC).alias("doc_id"), F.expr(f"CAST({AT} + {low} AS INT)").alias("start"), F.expr(f"CAST({AT} + {high} AS INT)").alias("end"), F.expr(kind).alias("entity_type"))
    pred = span(events.filter("event_id % 4 <> 3"), "event_id % 4", "10 + event_id % 4", PRED_KIND)
    return span(events, "0", "10", EVENT_KIND), pred.union(span(events.filter("event_id % 11 = 0"), "14", "18", "'PERSON'"))


def _arrays(gold: DataFrame, pred: DataFrame) -> DataFrame:
    pack = lambda df, name: df.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "entity_type"))).alias(name))
    empty = F.array().cast("array<struct<start:int,end:int,entity_type:string>>")
    both = pack(gold, "gold").join(pack(pred, "predicted"), "doc_id", "full_outer")
    return both.select("doc_id", F.coalesce("gold", empty).alias("gold"), F.coalesce("predicted", empty).alias("predicted"))


def _counts_sql(fit: str) -> str:
    return f"""
      SELECT t AS entity_type, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM (
        SELECT t, CASE WHEN {fit} THEN 1 ELSE 0 END AS tp, 0 AS fp, CASE WHEN {fit} THEN 0 ELSE 1 END AS fn FROM {MATCH}
        UNION ALL SELECT u, 0, 1, 0 FROM {MATCH} WHERE NOT missed AND NOT ({fit})
        UNION ALL SELECT 'PERSON', 0, 1, 0 FROM {MATCH} WHERE extra) c GROUP BY t"""


STRICT, RELAXED = "(d = 0 AND t = u)", "(d < 3 AND t = u)"


@query(_counts_sql(STRICT))
def gold_match_strict(spark, sf_dir):
    return evaluate.match_counts(_arrays(*_spans(spark, sf_dir)))


@query(_counts_sql(RELAXED))
def gold_match_relaxed(spark, sf_dir):
    return evaluate.match_counts(_arrays(*_spans(spark, sf_dir)), strict=False)


_RATIO = "CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp / CAST(tp + fp AS DOUBLE) END AS p, CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp / CAST(tp + fn AS DOUBLE) END AS r"


@query(f"""
  WITH c AS ({_counts_sql(RELAXED)}), a AS (SELECT * FROM c UNION ALL SELECT 'micro', CAST(sum(tp) AS BIGINT), CAST(sum(fp) AS BIGINT), CAST(sum(fn) AS BIGINT) FROM c),
  q AS (SELECT entity_type, tp, {_RATIO} FROM a), z AS (SELECT entity_type, tp, p, r, 5 * p * r / (4 * p + r) AS f2 FROM q)
  SELECT entity_type, tp, round(p, 6) AS p, round(r, 6) AS r, round(f2, 6) AS f2 FROM z
  UNION ALL SELECT 'macro', NULL, round(avg(p), 6), round(avg(r), 6), round(avg(f2), 6) FROM z WHERE entity_type <> 'micro'""")
def prf2_micro_macro(spark, sf_dir):
    r = evaluate.prf2(evaluate.match_counts(_arrays(*_spans(spark, sf_dir)), strict=False))
    return r.select("entity_type", "tp", F.round("precision", 6).alias("p"), F.round("recall", 6).alias("r"), F.round("f2", 6).alias("f2"))


BEST = "CASE WHEN missed THEN '<miss>' ELSE u END"


@query(f"SELECT t AS entity_type, sum(CASE WHEN {BEST} = 'INN' THEN 1 ELSE 0 END) AS \"INN\", sum(CASE WHEN {BEST} = 'PERSON' THEN 1 ELSE 0 END) AS \"PERSON\", sum(CASE WHEN {BEST} = 'SNILS' THEN 1 ELSE 0 END) AS \"SNILS\", sum(CASE WHEN missed THEN 1 ELSE 0 END) AS \"<miss>\" FROM {MATCH} GROUP BY t")
def confusion_pivot(spark, sf_dir):
    return evaluate.confusion(evaluate.best_overlaps(*_spans(spark, sf_dir)), ["INN", "PERSON", "SNILS", "<miss>"])


@query(f"SELECT doc_id, b + 14 AS start FROM {MATCH} WHERE extra")
def spurious_predictions(spark, sf_dir):
    gold, pred = _spans(spark, sf_dir)
    return evaluate.spurious(pred, gold).select("doc_id", "start")


@query("SELECT c_mktsegment, round(100.0 * avg(CASE WHEN c_custkey % 5 = 0 THEN 1.0 ELSE 0.0 END), 6) AS leak_rate, count(*) AS n FROM customer GROUP BY c_mktsegment")
def leak_rate(spark, sf_dir):
    disable = F.when(F.col("c_custkey") % 5 == 0, F.array(F.lit("EMAIL_ADDRESS"))).otherwise(F.array().cast("array<string>"))
    c = dealt(table(spark, sf_dir, "customer")).select("c_custkey", "c_mktsegment", F.expr(CONTACT).alias("t"), F.expr(MAIL).alias("v"))
    c = c.withColumn("a", mask.anonymize(F.col("t"), disable, only("phone", "email", "card"))["anonymized"])
    rate = F.round(F.avg(evaluate.leaked(F.col("v"), F.col("a")).cast("double")) * 100.0, 6)
    return c.groupBy("c_mktsegment").agg(rate.alias("leak_rate"), F.count("*").alias("n"))


@query("SELECT l_returnflag, round(avg(CASE WHEN l_linenumber = 1 THEN 1.0 ELSE 0.0 END), 6) AS overmask FROM lineitem GROUP BY l_returnflag")
def overmask_rate(spark, sf_dir):
    text = F.when(F.col("l_linenumber") == 1, F.lit("Пишите <EMAIL_2>")).otherwise("Заказ №4509 собран")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg(evaluate.has_placeholder(text).cast("double")), 6).alias("overmask"))


@query("""SELECT kind AS entity_type, CAST(sum(CASE WHEN kind = 'INN' OR kind = 'PHONE_NUMBER' AND c_custkey % 4 = 0 THEN 0 ELSE 1 END) AS BIGINT) AS found, count(*) AS total,
  round(avg(CASE WHEN kind = 'INN' OR kind = 'PHONE_NUMBER' AND c_custkey % 4 = 0 THEN 0.0 ELSE 1.0 END), 6) AS recall FROM customer, (VALUES ('PHONE_NUMBER'), ('EMAIL_ADDRESS'), ('CREDIT_CARD'), ('INN')) v(kind) GROUP BY kind""")
def type_presence(spark, sf_dir):
    """Each text is labelled with four types, of which one is never in it and one not in every fourth."""
    rows = _customers(spark, sf_dir, text=f"CASE WHEN c_custkey % 4 = 0 THEN concat('почта ', {MAIL}, ', карта ', {CARD}, ' у №', CAST(c_custkey AS STRING)) ELSE concat({CONTACT}, CAST(c_custkey AS STRING)) END")
    kinds = F.explode(F.array(*map(F.lit, ("PHONE_NUMBER", "EMAIL_ADDRESS", "CREDIT_CARD", "INN"))))
    r = evaluate.type_presence(rows.withColumn("entity_type", kinds), lambda t: mask.anonymize(t, recognizers=only("phone", "email", "card", "inn_anchored"))["entities_found"])
    return r.withColumn("recall", F.round("recall", 6))


def _recall_sql(bucket: str) -> str:
    return f"{CUSTOMERS} SELECT bucket, CAST(sum(hit) AS BIGINT) AS tp, CAST(sum(1 - hit) AS BIGINT) AS fn, round(avg(hit), 6) AS recall FROM (SELECT {bucket} AS bucket, CASE WHEN k % 4 = 0 THEN 0 ELSE 1 END AS hit FROM {_person_sql('c_custkey')} x) y GROUP BY bucket"


def _recall(spark, sf_dir, bucket) -> DataFrame:
    """Names found but for every fourth, with bounds that are one character off."""
    c = table(spark, sf_dir, "customer").select("c_custkey", generate.person(F.col("c_custkey")).alias("p")).select("c_custkey", "p.text", "p.case")
    span = lambda begin: F.struct(F.lit(begin).alias("start"), F.length("text").alias("end"), F.lit("PERSON").alias("entity_type"))
    empty = F.array().cast("array<struct<start:int,end:int,entity_type:string>>")
    c = c.withColumn("gold", F.array(span(0).withField("case", F.col("case")))).withColumn("predicted", F.when(F.col("c_custkey") % 4 != 0, F.array(span(1))).otherwise(empty))
    return evaluate.recall_by(c, bucket).withColumn("recall", F.round("recall", 6))


@query(_recall_sql("CASE WHEN p = lower(p) THEN 'lower' ELSE 'capital' END"))
def recall_by_letter_case(spark, sf_dir):
    return _recall(spark, sf_dir, evaluate.letter_case)


@query(_recall_sql("CASE form WHEN 'ips' THEN 'initials' WHEN 'fps' THEN '3 words' WHEN 'sfp' THEN '3 words' ELSE '2 words' END"))
def recall_by_name_format(spark, sf_dir):
    return _recall(spark, sf_dir, evaluate.name_format)


@query(_recall_sql(f"({list(generate.CASES)})[{_draw_sql(2, 'k')} // 7 % {len(generate.CASES)} + 1]"))
def recall_by_case(spark, sf_dir):
    return _recall(spark, sf_dir, "case")


@query(f"""SELECT class, count(*) AS n FROM (
    SELECT CASE WHEN missed OR t <> u THEN 'missing' WHEN d = 0 THEN 'correct' ELSE 'partial' END AS class FROM {MATCH} UNION ALL SELECT 'spurious' FROM {MATCH} WHERE extra) c GROUP BY class""")
def error_classes(spark, sf_dir):
    return evaluate.error_classes(_arrays(*_spans(spark, sf_dir)))


@query(f"""
  WITH t AS (SELECT doc_id, string_agg(DISTINCT t, ',' ORDER BY t) AS types FROM {MATCH} WHERE doc_id >= 0 GROUP BY doc_id),
  f AS (SELECT doc_id, types, doc_id <> min(doc_id) OVER (PARTITION BY types) AS later FROM t)
  SELECT doc_id, types FROM f ORDER BY later, doc_id LIMIT 6""")
def diverse_examples(spark, sf_dir):
    """A report of six documents, of different types first."""
    gold = _spans(spark, sf_dir)[0].groupBy("doc_id").agg(F.collect_list(F.struct(F.col("entity_type").alias("type"))).alias("spans"))
    types = F.array_join(F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["type"]))), ",")
    return evaluate.pick_diverse(gold, 6, "doc_id").select("doc_id", types.alias("types"))


@query(f"SELECT c_custkey, c_custkey % 3 <> 0 AS leaked FROM customer")
def name_parts_leak(spark, sf_dir):
    shown = "CASE c_custkey % 3 WHEN 0 THEN '<PERSON> из И. ждёт' WHEN 1 THEN 'ждёт Петрова' ELSE 'Анна звонила' END"
    c = _customers(spark, sf_dir, a=shown)
    return c.select("c_custkey", evaluate.name_leaked(F.lit("Петрова Анна И."), F.col("a")).alias("leaked"))


@query(f"SELECT t AS entity_type, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM {MATCH} GROUP BY t")
def type_distribution(spark, sf_dir):
    return _spans(spark, sf_dir)[0].groupBy("entity_type").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


@query("SELECT event_type, round(median(value), 6) AS median, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events GROUP BY event_type")
def latency_stats(spark, sf_dir):
    r = evaluate.latency(table(spark, sf_dir, "events"), "event_type", "value")
    return r.select("event_type", F.round("median", 6).alias("median"), F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("SELECT c_custkey, 'Здравствуйте, <PERSON>, ждём вас.' AS anonymized FROM customer")
def person_rules(spark, sf_dir):
    name = "concat(CASE c_custkey % 3 WHEN 0 THEN 'Иванова Мария Петровна' WHEN 1 THEN 'Сергей Кузнецов' ELSE 'Олег Ильич' END)"
    c = _customers(spark, sf_dir, t=f"concat('Здравствуйте, ', {name}, ', ждём вас.')")
    return c.select("c_custkey", mask.anonymize(F.col("t"), recognizers=(PersonRules(),))["anonymized"].alias("anonymized"))


# --- Tag sequences ------------------------------------------------------------------------

PLACE = "CAST(event_id % 10 AS INT)"
GOLD_TAG = "CASE WHEN user_id % 3 = 0 THEN 'O' WHEN user_id % 5 = 0 THEN 'B-' ELSE 'I-' END"
TAG_KIND = f"CASE WHEN {DOC} % 2 = 0 THEN 'PERSON' WHEN event_id % 10 > 3 THEN 'INN' ELSE 'SNILS' END"
GOLD_TAGS = f"CASE WHEN {GOLD_TAG} = 'O' THEN 'O' ELSE concat({GOLD_TAG}, {TAG_KIND}) END"
FOUND_TAGS = f"CASE WHEN user_id % 7 = 0 THEN 'O' WHEN user_id % 11 = 0 THEN concat('I-', {TAG_KIND}) ELSE {GOLD_TAGS} END"


def _chunks_sql(tag: str) -> str:
    return f"""
      SELECT k, kind, min(i) AS first, max(i) AS last FROM (
        SELECT *, sum(CASE WHEN kind IS NOT NULL AND (tag LIKE 'B-%' OR kind IS DISTINCT FROM before) THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY i) AS island FROM (
          SELECT *, lag(kind) OVER (PARTITION BY k ORDER BY i) AS before FROM (
            SELECT {DOC} AS k, {PLACE} AS i, {tag} AS tag, CASE WHEN {tag} <> 'O' THEN substr({tag}, 3) END AS kind FROM events) a) b) c
      WHERE kind IS NOT NULL GROUP BY k, kind, island"""


@query(_chunks_sql(FOUND_TAGS).replace("SELECT k, kind,", "SELECT k AS doc_id, kind AS type,", 1))
def tag_chunks(spark, sf_dir):
    """Chunks of tags that often begin with ``I-``."""
    rows = table(spark, sf_dir, "events").select(F.expr(DOC).alias("doc_id"), F.expr(PLACE).alias("pos"), F.expr(FOUND_TAGS).alias("tag"))
    return chunks.tag_chunks(rows, ["doc_id"])


@query(f"""
  WITH g AS ({_chunks_sql(GOLD_TAGS)}), p AS ({_chunks_sql(FOUND_TAGS)}),
  j AS (SELECT coalesce(g.kind, p.kind) AS type, g.k AS gk, p.k AS pk FROM g FULL JOIN p ON g.k = p.k AND g.kind = p.kind AND g.first = p.first AND g.last = p.last),
  c AS (SELECT coalesce(type, 'micro') AS type, count(gk + pk) AS tp, count(pk) - count(gk + pk) AS fp, count(gk) - count(gk + pk) AS fn FROM j GROUP BY ROLLUP (type)),
  r AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS q FROM c)
  SELECT type, tp, fp, fn, round(p, 6) AS precision, round(q, 6) AS recall, round(CASE WHEN p + q = 0 THEN 0.0 ELSE 2 * p * q / (p + q) END, 6) AS f1, round(CASE WHEN 4 * p + q = 0 THEN 0.0 ELSE 5 * p * q / (4 * p + q) END, 6) AS f2 FROM r""")
def chunk_scores(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.expr(DOC).alias("doc_id"), F.expr(PLACE).alias("pos"), F.expr(GOLD_TAGS).alias("gold"), F.expr(FOUND_TAGS).alias("found"))
    side = lambda c: rows.select("doc_id", "pos", F.col(c).alias("tag"))
    r = chunks.chunk_scores(side("gold"), side("found"), ["doc_id"])
    return r.select("type", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "f2")])


TAG_SCORES = ("user_id % 7", "(user_id + event_id) % 6", "(user_id * 3 + event_id % 10) % 9")


@query(f"""
  WITH RECURSIVE s AS (
    SELECT {DOC} AS k, event_id % 10 AS i, {", ".join(f"{c} AS {n}" for c, n in zip(TAG_SCORES, "obn", strict=True))} FROM events),
  walk AS (
    SELECT k, i, o AS so, b AS sb, CAST(-1000000 AS BIGINT) AS si, 'O' AS po, 'B' AS pb, 'I' AS pi FROM s WHERE i = 0
    UNION ALL
    SELECT s.k, s.i, s.o + greatest(so, sb, si), s.b + greatest(so, sb, si), s.n + greatest(sb, si),
      concat(CASE WHEN so >= greatest(sb, si) THEN po WHEN sb >= si THEN pb ELSE pi END, 'O'),
      concat(CASE WHEN so >= greatest(sb, si) THEN po WHEN sb >= si THEN pb ELSE pi END, 'B'),
      concat(CASE WHEN sb >= si THEN pb ELSE pi END, 'I')
    FROM walk w JOIN s ON s.k = w.k AND s.i = w.i + 1),
  last_ AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY k ORDER BY i DESC) = 1)
  SELECT k AS doc_id, CASE WHEN so >= greatest(sb, si) THEN po WHEN sb >= si THEN pb ELSE pi END AS tags FROM last_""")
def viterbi_tags(spark, sf_dir):
    """The best tags of each ten events, an inside tag never following an outside one."""
    rows = table(spark, sf_dir, "events").select(F.expr(DOC).alias("doc_id"), F.struct("event_id", F.array(*[F.expr(c).cast("double") for c in TAG_SCORES]).alias("s")).alias("x"))
    found = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    best = tagger.viterbi(F.transform("x", lambda x: x["s"]))
    return found.select("doc_id", F.array_join(F.transform(best, lambda i: F.element_at(F.array(*map(F.lit, tagger.TAGS)), i + 1)), "").alias("tags"))


@query("""
  SELECT event_id, path, value FROM (
    SELECT event_id, unnest(['$.to', '$.list[2].name', '$.list[3][0]']) AS path, unnest([concat('u', user_id, '@mail.ru'), concat('v', user_id), event_type]) AS value FROM events) t""")
def json_paths(spark, sf_dir):
    """The string values of each event's JSON with their paths."""
    body = """concat('{"to": "u', CAST(user_id AS STRING), '@mail.ru", "n": ', CAST(event_id AS STRING), ', "list": [null, true, {"name": "v', CAST(user_id AS STRING), '"}, ["', event_type, '", 1.5]]}')"""
    return json_leaves(table(spark, sf_dir, "events").select("event_id", F.expr(body).alias("t")), "event_id", "t")


@query(f"""
  WITH RECURSIVE s AS (
    SELECT l_orderkey AS k, {START} AS b, {STOP} AS e, row_number() OVER (PARTITION BY l_orderkey ORDER BY {SCORE} DESC, {STOP} - {START} DESC, {START}, l_linenumber) AS i FROM lineitem),
  walk AS (
    SELECT k, i, [{{'b': b, 'e': e}}] AS kept FROM s WHERE i = 1
    UNION ALL
    SELECT w.k, s.i, CASE WHEN len(list_filter(w.kept, lambda x: x.b < s.e AND s.b < x.e)) > 0 THEN w.kept ELSE list_append(w.kept, {{'b': s.b, 'e': s.e}}) END
    FROM walk w JOIN s ON s.k = w.k AND s.i = w.i + 1),
  last_ AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY k ORDER BY i DESC) = 1)
  SELECT l_orderkey, x.b AS "start", x.e AS "end" FROM (SELECT k AS l_orderkey, unnest(kept) AS x FROM last_) t""")
def resolution_in_rounds(spark, sf_dir):
    """Overlaps resolved over rows instead of arrays."""
    span = (F.lit("PERSON").alias("entity_type"), F.expr(START).alias("start"), F.expr(STOP).alias("end"), F.expr(SCORE).alias("score"), F.col("l_linenumber").alias("rank"))
    return intervals.resolved(table(spark, sf_dir, "lineitem").select("l_orderkey", *span), ["l_orderkey"]).select("l_orderkey", "start", "end")


def queries() -> dict[str, Query]:
    return {k: e.run for k, e in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {k: e.sql for k, e in FOUND.items() if e.sql}
