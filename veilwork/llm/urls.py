"""URL filters by hash-prefix lookups.

Every distinct host and path head is expanded into its host suffixes joined
with the path prefixes that rules can have.  The expressions meet the rules in
an equi-join on a short prefix of their digests; whole digests confirm, and the
longest rule decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import saved

#: Hexadecimal digits of the digest on which expressions and rules are joined.
SHORT = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The rules of the query.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def rule_table(spark: SparkSession, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules])
    return spark.range(1).select(F.inline(rows))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def filter_urls(pages: DataFrame, rules: DataFrame, otherwise: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Judge every url by the longest rule that fits its host and path.

    ``rules`` has ``verdict, host, path``; a rule fits its host and all
    subdomains if the path starts with the rule's; of equal rules, ``block``
    wins.  Returns ``page_id, host, path, rule, verdict``, one row an input row.
    A null url, or one without ``://``, has an empty host and path; without a
    fitting rule, ``rule`` is null and the verdict is ``otherwise``.  Empty
    tables give empty results; other columns are not read.
    """
    rule_text = F.concat("host", "path")
    rules = rules.groupBy(rule_text.alias("rule"), F.length("host").alias("host_length")).agg(F.max("verdict").alias("rule_verdict"), F.max(F.length("path")).alias("path_length"), F.max(F.size(F.split("host", r"\."))).alias("labels"))
    lengths = sorted(r[0] for r in rules.select("path_length").distinct().collect())  # at most as many as a path has characters
    labels = rules.agg(F.max("labels")).first()[0] or 0
    digest = F.sha2(F.col("rule").cast("binary"), 256)
    # what is joined is written first, so that Spark can split the rows of a hot prefix or host among tasks
    known = saved(rules.select("rule", "rule_verdict", "host_length", digest.alias("rule_digest"), F.substring(digest, 1, SHORT).alias("short")))

    longest = max(lengths, default=0)
    judged = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    judged = judged.withColumn("head", F.substring("path", 1, longest))
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(max(labels, 1)))), lambda k: F.array_join(F.slice(parts, -k, k), "."))
    heads = F.filter(F.array(*[F.lit(n) for n in lengths] or [F.lit(0)]), lambda n: n <= F.length("head"))
    expressions = F.flatten(F.transform(suffixes, lambda s: F.transform(heads, lambda n: F.struct(F.concat(s, F.substring("head", F.lit(1), n)).alias("text"), F.length(s).alias("host_length")))))
    asked = judged.select("host", "head").distinct().select("host", "head", F.explode(expressions).alias("e"))
    asked = asked.withColumn("digest", F.sha2(F.col("e.text").cast("binary"), 256)).withColumn("short", F.substring("digest", 1, SHORT))
    hits = asked.join(known, "short").filter((F.col("digest") == F.col("rule_digest")) & (F.col("e.host_length") == F.col("host_length")))
    best = F.max(F.struct(F.length("rule").alias("n"), F.col("rule_verdict").alias("verdict"), F.col("rule").alias("rule"))).alias("best")
    verdicts = saved(hits.groupBy("host", "head").agg(best))
    return judged.join(verdicts, ["host", "head"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), F.lit(otherwise)).alias("verdict")
    )


ORACLE_SQL = r"""
WITH parsed AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules(verdict, rhost, rpath) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
  ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
hits AS (
  SELECT DISTINCT host, path, rhost || rpath AS rule, verdict FROM (SELECT DISTINCT host, path FROM parsed) p JOIN rules r
    ON (p.host = r.rhost OR p.host LIKE '%.' || r.rhost) AND starts_with(p.path, r.rpath)),
best AS (
  SELECT host, path, rule, verdict FROM (
    SELECT *, row_number() OVER (PARTITION BY host, path ORDER BY length(rule) DESC) AS nth FROM hits) t WHERE nth = 1)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') AS verdict
FROM parsed p LEFT JOIN best b ON p.host = b.host AND p.path = b.path
"""
