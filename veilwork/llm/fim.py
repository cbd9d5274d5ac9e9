"""Fill-in-the-middle: cut a text into prefix, middle and suffix at token bounds and reorder them.

An Arrow-batched pandas UDF collects the end offsets of a text's units in a
compact array; where to cut and which form to use follow from a digest of the
seed and the id, so reruns and retried tasks agree.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is a unit: a word with the white space before it, or the white space at the end.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
MARKS = ("<P>", "<S>", "<M>")
RESULT = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string, restored_sha256 string"


@dataclass(frozen=True)
class Shares:
    """The seed, and of 100 texts how many are cut, and of 100 of those how many have the suffix first."""

    seed: str = "42"
    cut: int = 50
    suffix_first: int = 80


def ends(text: str) -> array:
    """Where each unit ends, in code points, after a 0."""
    import regex

    return array("Q", [0, *(m.end() for m in regex.finditer(UNIT, text))])


def seeds(seed: str, doc_id: object) -> list[int]:
    """The first four groups of eight digits of the digest of seed and id; a null id is an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def transform(text: str, doc_id: object, shares: Shares = Shares()) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, code points of prefix and middle, and what becomes of the text."""
    at = ends(text)
    n = len(at) - 1
    h1, h2, h3, h4 = seeds(shares.seed, doc_id)
    if not text or h3 % 100 >= shares.cut or any(m in text for m in MARKS):
        return n, "plain", None, None, text
    one, two = at[min(h1 % (n + 1), h2 % (n + 1))], at[max(h1 % (n + 1), h2 % (n + 1))]
    prefix, middle, suffix = text[:one], text[one:two], text[two:]
    p, s, m = MARKS
    if h4 % 100 < shares.suffix_first:
        return n, "spm", len(prefix), len(middle), f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", len(prefix), len(middle), f"{p}{prefix}{s}{suffix}{m}{middle}"


def restore(output: str, form: str) -> str:
    """The text that an output was made of.

    Texts with marks are never cut and a mark's ends occur nowhere else in it,
    so the first mark found after the one before is the one that was put in.
    """
    if form == "plain":
        return output
    p, s, m = MARKS
    first, second = (s, p) if form == "spm" else (p, s)
    a, rest = output[len(first) :].split(second, 1)
    b, middle = rest.split(m, 1)
    return b + middle + a if form == "spm" else a + middle + b


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def fim_column(doc_id: Column, text: Column, shares: Shares = Shares()) -> Column:
    """The struct ``RESULT`` of an id and a text."""

    @F.pandas_udf(RESULT)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RESULT.split(", ")]
        for ids, texts in batches:
            rows = []
            for i, t in zip(ids, texts, strict=True):
                n, form, before, between, output = transform(t or "", i, shares)
                rows.append((n, form, before, between, output, digest(output), digest(restore(output, form))))
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    return run(doc_id.cast("string"), text)


def fill_in_middle(docs: DataFrame, shares: Shares = Shares(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document with what becomes of its text, in one pass without a shuffle.

    Adds one column for each of ``RESULT`` to the id: ``output`` is the text in
    its new order, the digests are of it and of the text rebuilt from it.  A null
    text is an empty one; a null id has the seed of an empty id; repeated rows
    each get a row and the same values; an empty table gives an empty one; other
    columns are not read.  Spark cuts Arrow batches by rows and by bytes
    (``spark.sql.execution.arrow.maxBytesPerBatch``), so long texts do not add up.
    """
    r = fim_column(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), shares)
    done = docs.select(F.col(f"`{id_col}`").alias("id"), r.alias("r"))
    return done.select(F.col("id").alias(id_col), "r.*")


ORACLE_SQL = rf"""
  WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256(concat('42:', CAST(doc_id AS VARCHAR))) AS h FROM documents),
  u AS (SELECT *, regexp_extract_all(t, '{UNIT}') AS m, {", ".join(f"CAST(concat('0x', substr(h, {8 * i + 1}, 8)) AS BIGINT) AS h{i + 1}" for i in range(4))} FROM d),
  c AS (
    SELECT *, len(m) AS n, least(h1 % (len(m) + 1), h2 % (len(m) + 1)) AS a, greatest(h1 % (len(m) + 1), h2 % (len(m) + 1)) AS b,
      CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
  p AS (SELECT *, array_to_string(m[1:a], '') AS pre, array_to_string(m[a + 1:b], '') AS mid, array_to_string(m[b + 1:n], '') AS suf FROM c)
  SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', pre, '<S>', suf, '<M>', mid) ELSE concat('<S>', suf, '<P>', pre, '<M>', mid) END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""
