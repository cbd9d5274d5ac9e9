"""Secret scans with a trigram inverted index.

Each rule's regular expression is read as a syntax tree from which a Boolean
query over mandatory trigrams follows.  One pass over the texts writes the
posting lists of those trigrams: rows of a trigram and a document.  Lists are
intersected and united by document, which yields the candidates of each rule.
Candidates go back to the texts as the bits of a filter of a fixed size, so no
text is shuffled; the expression itself verifies them where they lie, and a
text that the filter lets through in error only costs a search.  Rules without
mandatory trigrams scan every text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as sre_parse

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lets import let
from .shared import fresh, key_filter, may_hold, saved

#: Trigrams in a word of bits, and posting lists that are intersected for a run of letters.
WORD_BITS, MOST_LISTS = 62, 2
LETTERS = "etaoinshrdlcumwfgypbvkjxqz"
#: A query is True (no mandatory trigram), a trigram, or ("and" | "or", parts).
Query = bool | str | tuple
#: Strings that a run of literals may stand for before it is cut.
MAX_STRINGS = 32


@dataclass(frozen=True)
class Rule:
    """A kind of secret: an expression, and the least length of one of its groups."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# The three base kinds.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
# Public formats of keys and tokens.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*"),
    Rule("url_password", r"://[^\s:/@]{1,64}:[^\s:/@]{3,64}@"),
)


def both(parts: list[Query]) -> Query:
    parts = [p for p in parts if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(dict.fromkeys(parts)))


def either(parts: list[Query]) -> Query:
    """Any of the parts; one that asks for all that another asks for, and more, says nothing."""
    if any(p is True for p in parts):
        return True
    asked = {p: frozenset(p[1]) if p[0] == "and" else frozenset([p]) for p in parts}
    needed = [p for p in asked if not any(asked[q] < asked[p] for q in asked)]
    return needed[0] if len(needed) == 1 else ("or", tuple(needed))


def of_string(s: str) -> Query:
    return both([s[i : i + 3] for i in range(len(s) - 2)])


def strings_of(node: list) -> set[str] | None:
    """All strings, in lower case, that a sequence can match; None if there are many."""
    found = {""}
    for op, arg in node:
        if op is sre.LITERAL:
            more = {chr(arg).lower()}
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg):
            more = {chr(a).lower() for _, a in arg}
        elif op is sre.SUBPATTERN:
            more = strings_of(arg[3])
        elif op is sre.BRANCH:
            own = [strings_of(x) for x in arg[1]]
            more = None if None in own else set().union(*own)
        elif op is sre.MAX_REPEAT and arg[1] != sre.MAXREPEAT and arg[1] <= 2:
            one = strings_of(arg[2])
            more = None if one is None else {s * k for s in one for k in range(arg[0], arg[1] + 1)}
        else:
            return None
        if more is None or len(found) * len(more) > MAX_STRINGS:
            return None
        found = {a + b for a in found for b in more}
    return found


def query_of(node: list) -> Query:
    """The trigrams that any match of a sequence must hold."""
    parts: list[Query] = []
    run: set[str] = {""}

    def close() -> None:
        nonlocal run
        parts.append(either([of_string(s) for s in sorted(run)]))
        run = {""}

    for item in node:
        op, arg = item
        own = strings_of([item])
        if own is not None and len(run) * len(own) <= MAX_STRINGS:
            run = {a + b for a in run for b in own}
            continue
        close()
        if own is not None:
            run = own
        elif op is sre.SUBPATTERN:
            parts.append(query_of(arg[3]))
        elif op is sre.BRANCH:
            parts.append(either([query_of(x) for x in arg[1]]))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:
            parts.append(query_of(arg[2]))
    close()
    return both(parts)


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query of an expression, over lower-cased text."""
    return query_of(list(sre_parse.parse(pattern)))


def rarity(trigram: str) -> int:
    """How rare a trigram should be: letters by their order of frequency, all else above them."""
    return sum(LETTERS.index(c) if c in LETTERS else len(LETTERS) for c in trigram)


def selective(query: Query, most: int = MOST_LISTS) -> Query:
    """A weaker query that reads fewer lists: of the trigrams that must all occur, the rarest."""
    if query is True or isinstance(query, str):
        return query
    parts = [selective(p, most) for p in query[1]]
    if query[0] == "or":
        return either(parts)
    plain = sorted((p for p in parts if isinstance(p, str)), key=lambda t: (-rarity(t), t))[:most]
    return both(plain or [p for p in parts if not isinstance(p, str)])


def trigrams_in(query: Query) -> list[str]:
    if query is True:
        return []
    return [query] if isinstance(query, str) else [t for p in query[1] for t in trigrams_in(p)]


def postings(texts: DataFrame, trigrams: list[str], text_col: str = "text") -> DataFrame:
    """``trigram, document``: where each trigram occurs, in lower case; a document is named by its text's hash."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    lowered = texts.select(F.xxhash64(text).alias("document"), F.lower(text).alias("low"))  # a column, so that it is made once
    found = F.concat_ws("\0", *[F.when(F.contains(F.col("low"), F.lit(t)), F.lit(t)) for t in trigrams] or [F.lit(None).cast("string")])
    held = lowered.select("document", found.alias("found")).filter("found <> ''")
    return held.select("document", F.explode(F.split("found", "\0")).alias("trigram")).select("trigram", "document").distinct()


def holds(query: Query, occurs: dict[str, Column]) -> Column:
    """A query over which trigrams occur."""
    if query is True:
        return F.lit(True)
    if isinstance(query, str):
        return occurs[query]
    out = None
    for p in query[1]:
        own = holds(p, occurs)
        out = own if out is None else (out & own if query[0] == "and" else out | own)
    return out


def candidates(index: DataFrame, queries: list[Query]) -> DataFrame:
    """``document, rule``: the documents that each rule's query finds in the posting lists.

    The lists of all trigrams meet by document, of which each has one entry a
    trigram, so no group is larger than the rules make it.
    """
    trigrams = list(dict.fromkeys(t for q in queries for t in trigrams_in(q)))
    place = F.array_position(F.array(*map(F.lit, trigrams or [""])), F.col("trigram")) - 1
    index = index.withColumn("place", place)
    words = [F.bit_or(F.when(F.floor(F.col("place") / WORD_BITS) == k, F.expr(f"shiftleft(1L, CAST(place % {WORD_BITS} AS INT))")).otherwise(F.lit(0).cast("long"))).alias(f"w{k}") for k in range(-(-len(trigrams) // WORD_BITS))]
    met = index.groupBy("document").agg(*(words or [F.count("*").alias("w0")]))
    occurs = {t: F.col(f"w{i // WORD_BITS}").bitwiseAND(F.lit(1 << i % WORD_BITS).cast("long")) != 0 for i, t in enumerate(trigrams)}
    rules = F.array_compact(F.array(*[F.when(holds(q, occurs), F.lit(i)) for i, q in enumerate(queries) if q is not True] or [F.lit(None).cast("int")]))
    return met.select("document", F.explode(rules).alias("rule"))


def _spot(document: Column, rule: Column) -> Column:
    """The key of a document and a rule in the filter of candidates."""
    return F.xxhash64(document, rule.cast("int"))


def found_spans(text: Column, rule: Rule, index: int) -> Column:
    """All matches, left to right, as ``(start, kind index, kind, end)`` in code points.

    The gaps between matches come from ``split``, so a start is the length of
    all that lies before it.
    """
    rx = F.lit(rule.pattern)
    kind = "array<struct<start:int,nth:int,kind:string,end:int>>"

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["g"])
        stop = begin + F.length(x["m"])
        span = F.struct(begin.alias("start"), F.lit(index).alias("nth"), F.lit(rule.kind).alias("kind"), stop.alias("end"))
        add = F.when(F.length(x["p"]) >= rule.least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct(stop.alias("at"), add.alias("spans"))

    def spans(whole: Column) -> Column:
        part = F.regexp_extract_all(text, rx, F.lit(rule.group)) if rule.least else whole
        pieces = F.arrays_zip(whole.alias("m"), part.alias("p"), F.split(text, rule.pattern, -1).alias("g"))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("spans"))
        return F.aggregate(F.slice(pieces, 1, F.size(whole)), start, step, lambda acc: acc["spans"])

    return let(F.regexp_extract_all(text, rx, F.lit(0)), lambda whole: F.when(F.size(whole) > 0, spans(whole)).otherwise(F.array().cast(kind)))


def joined(spans: Column) -> Column:
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(spans), one), ",")


def scan_secrets(docs: DataFrame, more: tuple[Rule, ...] = MORE_RULES, text_col: str = "text", name: str = "secrets") -> DataFrame:
    """Add the array column ``name`` of all spans ``(start, nth, kind, end)`` in each whole text.

    Spans are half-open and count code points.  A null or empty text has none;
    repeated rows are scanned alike; an empty table gives an empty one.  An
    existing column of that name is replaced, all others stay as they are.
    """
    rules = (*BASE_RULES, *more)
    queries = [selective(trigram_query(r.pattern)) for r in rules]
    trigrams = list(dict.fromkeys(t for q in queries for t in trigrams_in(q)))
    kind = "array<struct<start:int,nth:int,kind:string,end:int>>"
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    index = saved(postings(docs.select(F.col(f"`{text_col}`")), trigrams, text_col))
    found = saved(candidates(index, queries).select(_spot(F.col("document"), F.col("rule")).alias("key")))
    bits = saved(key_filter(found, found.count())).scalar()
    document, asked = F.xxhash64(text), fresh(docs, "asked")
    flags = [F.lit(True) if q is True else may_hold(bits, _spot(document, F.lit(i))) for i, q in enumerate(queries)]
    spans = [F.when(F.col(asked)[i], found_spans(text, r, i)).otherwise(F.array().cast(kind)) for i, r in enumerate(rules)]
    return docs.withColumn(asked, F.array(*flags)).withColumn(name, F.array_sort(F.concat(*spans))).drop(asked)


def redact_secrets(docs: DataFrame, more: tuple[Rule, ...] = MORE_RULES, text_col: str = "text") -> DataFrame:
    """Replace every secret in each whole text by ``<secret:kind>``, overlapping ones by the first.

    A null text stays null; texts without secrets and all other columns stay as
    they are, whatever their names.
    """
    name = fresh(docs, "secrets")
    text = F.col(f"`{text_col}`")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        longer = F.struct(s["end"].alias("at"), F.concat(acc["parts"], F.array(gap, F.concat(F.lit("<secret:"), s["kind"], F.lit(">")))).alias("parts"))
        return F.when(s["start"] >= acc["at"], longer).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["parts"].alias("parts")))

    end = lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.length(text)))
    clean = F.when(F.size(F.col(name)) > 0, F.aggregate(F.col(name), start, step, end)).otherwise(text)
    return scan_secrets(docs, more, text_col, name).withColumn(text_col, clean).drop(name)


def secret_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts by base kind, the digest of the base spans, and all spans as text."""
    found = scan_secrets(docs.select(id_col, text_col), text_col=text_col)
    spans = F.col("secrets")
    base = F.filter(spans, lambda s: s["nth"] < len(BASE_RULES))
    count = lambda i: F.size(F.filter(spans, lambda s: s["nth"] == i)).cast("long")
    return found.select(
        id_col,
        *[count(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE_RULES)],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
    )


def python_pattern(rule: Rule) -> re.Pattern:
    """The same rule for tests by brute force."""
    return re.compile(rule.pattern, re.ASCII)


def oracle_sql(rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> str:
    """DuckDB SQL for ``secret_columns`` over ``documents``."""

    def one(i: int, r: Rule) -> str:
        rx = r.pattern.replace("'", "''")
        return (
            f"SELECT doc_id, {i} AS nth, '{r.kind}' AS kind, {r.least} AS least, regexp_extract_all(text, '{rx}', 0) AS m, "
            f"regexp_extract_all(text, '{rx}', {r.group}) AS p, string_split_regex(text, '{rx}') AS g FROM d WHERE regexp_matches(text, '{rx}')"
        )

    every = "\n  UNION ALL ".join(one(i, r) for i, r in enumerate(rules))
    base = len(BASE_RULES)
    counts = ", ".join(f"CAST(count(CASE WHEN nth = {i} THEN 1 END) AS BIGINT) AS n_{r.kind}" for i, r in enumerate(BASE_RULES))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS ({every}),
each_ AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM found),
spans AS (
  SELECT doc_id, nth, kind, i, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS b,
         length(m[i]) AS n FROM each_ WHERE length(p[i]) >= least),
named AS (SELECT doc_id, nth, b, concat(kind, ':', CAST(b AS VARCHAR), ':', CAST(b + n AS VARCHAR)) AS s FROM spans),
joined AS (
  SELECT doc_id, {counts}, coalesce(string_agg(CASE WHEN nth < {base} THEN s END, ',' ORDER BY b, nth), '') AS base, string_agg(s, ',' ORDER BY b, nth) AS spans
  FROM named GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE_RULES)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN joined j ON d.doc_id = j.doc_id
"""
