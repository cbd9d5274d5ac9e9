import hashlib
import random
import re
from collections import defaultdict

import duckdb
from pyspark.sql import functions as F

from veilwork.llm import chat, mixing, registry, urls
from veilwork.llm.mixing import mix_sources, mixed
from veilwork.llm.secrets import BASE_RULES, MORE_RULES, Rule, candidates, postings, python_pattern, scan_secrets, redact_secrets, secret_columns, selective, trigram_query, trigrams_in
from veilwork.llm.urls import filter_urls, rule_table

SF = "/root/testdata/sf0.001"


def sql_rows(sql):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = con.execute(sql)
    return [d[0] for d in got.description], got.fetchall()


def test_sql(spark):
    for name, sql in ((mixing.ORACLE_SQL, "op5_mixing"), (urls.ORACLE_SQL, "op7_url_filter"), (chat.ORACLE_SQL, "op10_preferences")):
        names, want = sql_rows(name)
        df = registry.queries()[sql](spark, SF).select(*names)
        flat = lambda rows: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in [tuple("" if x is None else x for x in r) for r in rows])
        assert flat(map(tuple, df.collect())) == flat(want)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_mixing_by_brute_force(spark):
    rng = random.Random(6)
    sources = [None, "a", "b", "ä", "hot", "tiny"]
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), "hot" if i % 3 else rng.choice(sources), "x") for i in range(3000)]
    rows += [(None, "null id", "a", "x"), (7, "again again", "b", "x"), (9001, None, "zero", "x"), (9002, "one", "tiny", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string").repartition(4)
    got = mix_sources(df).collect()
    assert len(got) == len(rows)
    size = defaultdict(int)
    for _, t, s, _ in rows:
        size[s] += len((t or "").split())
    order = sorted(size, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, total, capped = {}, 1.5 * sum(size.values()), set()
    while True:
        left = total - sum(2 * size[s] for s in capped)
        open_ = sum(weight[s] for s in order if s not in capped)
        target = {s: 2.0 * size[s] if s in capped else left * weight[s] / open_ for s in order}
        over = {s for s in order if target[s] > 2 * size[s] and s not in capped}
        if not over:
            break
        capped |= over
    taken = defaultdict(int)
    for r in got:
        assert abs(r.target - target[r.source]) < 1e-6 and r.source_size == size[r.source] and r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= 60, (s, taken[s], target[s])
    assert sorted(map(str, got)) == sorted(map(str, mix_sources(df.repartition(2)).collect()))
    assert mix_sources(df.limit(0)).count() == 0
    copies = defaultdict(int)
    for r in got:
        copies[r.doc_id] += r.copies
    again = defaultdict(int)
    for r in mixed(df.withColumn("copies", F.lit(1)).withColumn("b0", F.lit("x"))).collect():
        again[r.doc_id] += 1
    assert again == {k: v for k, v in copies.items() if v}


SECRETS = [
    None, "", "nothing here", "password: hunter2hunter", "PassWd = 'abcd1234'", "token=short", "secret=token:abcdefgh12", "api_key\"  :  \"AAAABBBBCCCC",
    "AKIA" + "A1" * 8, "akia" + "A1" * 8, "AKIAAKIA" + "B" * 9, "f" * 31, "0123456789abcdef" * 3, "x" + "ab" * 20 + "G", "😀 token: ééé abcdefgh",
    "ſecret=abcdefgh1", "a" * 200_000 + " password=longenough1 " + "0" * 40, "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a" * 40, "http://u:pass@h/",
    "password=secret=token=abcdefghij", "apikey:12345678 token:87654321\ntoken:123456789",
]


def brute_spans(text, rules):
    out = []
    for n, r in enumerate(rules):
        out += [(m.start(), n, r.kind, m.end()) for m in python_pattern(r).finditer(text or "") if len(m.group(r.group)) >= r.least]
    return sorted(out)


def test_secrets_by_brute_force(spark):
    rows = [(i, t, "x") for i, t in enumerate(SECRETS)] + [(None, SECRETS[3], "x"), (3, SECRETS[3], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, secrets string").repartition(3)
    join = lambda s: ",".join(f"{k}:{a}:{b}" for a, _, k, b in s)
    got = secret_columns(df).collect()
    assert len(got) == len(rows)
    for r in got:
        text = SECRETS[3 if r.doc_id is None else r.doc_id]
        every = brute_spans(text, BASE_RULES + MORE_RULES)
        base = [s for s in every if s[1] < 3]
        assert r.spans == join(every), text[:80]
        assert r.base_sha256 == hashlib.sha256(join(base).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[1] == k for s in base) for k in range(3)]
    assert secret_columns(df.limit(0)).count() == 0
    clean = {r.doc_id: r.text for r in redact_secrets(df).collect()}
    assert clean[3] == "<secret:assign>" and clean[2] == "nothing here" and clean[0] is None


def test_trigram_queries(spark):
    assert trigram_query(r"AKIA[A-Z0-9]{12,}") == ("and", ("aki", "kia"))
    assert trigram_query(r"[0-9a-f]{32,}") is True and trigram_query("ab?c") is True
    assert trigram_query("(abc|xyz)+d") == ("or", ("abc", "xyz"))
    rules = BASE_RULES + MORE_RULES
    assert selective(trigram_query("password|xyzzy")) == ("or", (("and", ("pas", "ssw")), ("and", ("yzz", "zzy"))))
    assert trigram_query("abcd(xy)?") == ("and", ("abc", "bcd"))  # what an alternative adds says nothing
    queries = [selective(trigram_query(r.pattern)) for r in rules]
    trigrams = list(dict.fromkeys(t for q in queries for t in trigrams_in(q)))
    texts = [t or "" for t in SECRETS]
    df = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("document", F.xxhash64("text"))
    named = {r.text: r.document for r in df.collect()}
    index = postings(df, trigrams).cache()
    assert {(r.trigram, r.document) for r in index.collect()} == {(t, named[x]) for t in trigrams for x in texts if t in x.lower()}
    found = {(r.document, r.rule) for r in candidates(index, queries).collect()}

    def fits(q, text):
        return q in text.lower() if isinstance(q, str) else (all if q[0] == "and" else any)(fits(p, text) for p in q[1])

    assert found == {(named[x], i) for x in texts for i, q in enumerate(queries) if q is not True and fits(q, x)}
    for x in texts:  # no match is ever ruled out
        for i, r in enumerate(rules):
            assert queries[i] is True or (named[x], i) in found or not re.search(r.pattern, x, re.ASCII)


def test_secrets_without_trigrams(spark):
    rows = [(1, "abc 11 x", "kept"), (2, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, document string")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.secrets] for r in scan_secrets(df, more=(Rule("pair", r"\d\d"),)).collect()}
    assert got == {1: [("pair", 4, 6)], 2: []}


def test_columns_of_any_name_stay(spark):
    df = spark.createDataFrame([(1, "token=abcdefgh1", "a", "b", "c")], "doc_id long, text string, secrets string, __secrets string, Secrets_ string")
    assert [tuple(r) for r in redact_secrets(df).collect()] == [(1, "<secret:assign>", "a", "b", "c")]
    odd = spark.createDataFrame([(1, "w w", "s", "x", 5, 6, 7)], "doc_id long, text string, source string, __of string, __whole int, __threshold int, plan_of int")
    assert {tuple(r) for r in mixed(odd).collect()} <= {(1, "w w", "s", "x", 5, 6, 7)}


def test_urls_by_brute_force(spark):
    hosts = ["org", "Example.ORG", "a.example.org", "notexample.org", "x.com", "com", "", "org:80", "a..org", "u@b.org"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12/x", "/fr/a?b", "/de/#c", "?q=/de/", "/fr"]
    cases = [(f"http://{h}{p}", "x") for h in hosts for p in paths] + [(None, "x"), ("", "x"), ("no scheme.org/", "x"), ("a://b.com/de/://c.org/", "x"), ("://org/", "x")]
    cases += cases[:5]
    df = spark.createDataFrame([(i, u, v) for i, (u, v) in enumerate(cases)], "page_id long, url string, rule string").repartition(3)
    got = {r.page_id: r for r in filter_urls(df, rule_table(spark)).collect()}
    assert len(got) == len(cases)
    for i, (url, _) in enumerate(cases):
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [(len(h + p), v, h + p) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, "allow", None))
        r = got[i]
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best[2], best[1]), url
    assert filter_urls(df.limit(0), rule_table(spark)).count() == 0


def test_rows_without_ids_reach_their_targets(spark):
    rng = random.Random(7)
    rows = [(None if i % 3 else i, " ".join(rng.choices("abcdefghij", k=rng.randint(1, 60))), "abc"[i % 3]) for i in range(3000)]
    got = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)).collect()
    taken = defaultdict(int)
    for r in got:
        taken[r.source] += r.taken
    assert all(abs(taken[r.source] - r.target) <= 120 for r in got)
