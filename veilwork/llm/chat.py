"""Preference formatting: one prompt, two masked completions.

The longest common turn prefix of a chosen and a rejected conversation is
rendered once as the prompt; what follows in each is its completion, with the
character spans that a loss should see: what assistants say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import saved

#: Groups a shuffle partition over which conversations of one first turn are spread.
SALTS_PER_PARTITION = 4
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
SPANS = "array<struct<start:int,end:int>>"
TURNS = "array<struct<role:string,text:string>>"


def harmless(c: Column) -> Column:
    """Text in which nothing can pass for a marker of the template."""
    return F.replace(F.coalesce(c, F.lit("")), F.lit("<|"), F.lit("<\u200b|"))


def rendered(turns: Column) -> Column:
    one = lambda t: F.concat(F.lit(OPEN), harmless(t["role"]), F.lit("\n"), harmless(t["text"]), F.lit(CLOSE))
    return F.array_join(F.transform(turns, one), "")


def loss_spans(turns: Column) -> Column:
    """Half-open code-point spans of what assistants say, with the closing marker, in ``rendered(turns)``."""

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + len(OPEN) + F.length(harmless(t["role"])) + 1
        stop = begin + F.length(harmless(t["text"])) + len(CLOSE)
        own = F.array(F.struct(begin.cast("int").alias("start"), (stop - 1).cast("int").alias("end")))
        add = F.when(t["role"] == "assistant", F.concat(acc["spans"], own)).otherwise(acc["spans"])
        return F.struct(stop.cast("int").alias("at"), add.alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans"))
    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def common_turns(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two arrays of turns."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    differ = F.array_position(same, False)
    return F.when(differ > 0, differ - 1).otherwise(F.greatest(F.size(a), F.size(b))).cast("int")


def format_preferences(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Add ``n_common, prompt, chosen_text, chosen_loss, rejected_text, rejected_loss``.

    ``chosen`` and ``rejected`` are arrays of ``(role, text)``.  A null array
    counts as one without turns; a null role or text as an empty one; two equal
    conversations are all prompt, with two empty completions.  All other columns
    stay, those of the new names are replaced; an empty table gives an empty one.
    """
    a, b = (F.coalesce(F.col(c), F.array().cast(TURNS)) for c in (chosen, rejected))
    rest = lambda c: F.slice(c, F.col("n_common") + 1, F.greatest(F.size(c) - F.col("n_common"), F.lit(0)))
    return (
        pairs.withColumn("n_common", common_turns(a, b))
        .withColumn("prompt", rendered(F.slice(a, 1, F.col("n_common"))))
        .withColumns({"chosen_text": rendered(rest(a)), "chosen_loss": loss_spans(rest(a))})
        .withColumns({"rejected_text": rendered(rest(b)), "rejected_loss": loss_spans(rest(b))})
    )


def preference_pairs(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` to ``conv_id, chosen_id, chosen, rejected_id, rejected``.

    Conversations with the same first turn answer the same request.  The one of
    the least id is chosen and each other is rejected against it, a star instead
    of all pairs.  The least itself is chosen over its own stale answer: its last
    assistant turn is replaced by the assistant turn before it, or left out if
    there is none; ``rejected_id`` is then null.  So each conversation has one
    row.  Repeated turns count once; equal turn numbers are ordered by role and
    text; a turn without an id is a conversation of its own, after those with
    ids, and of such ones alike there is one; an empty table gives an empty one.

    Members of a hot first turn are spread over salts, with a copy of the chosen
    conversation for each salt that has any.
    """
    turn = F.struct("turn", "role", "text")
    alone = F.when(F.col("conv_id").isNull(), F.sha2(F.to_json(turn).cast("binary"), 256))
    ordered = F.array_sort(F.array_distinct(F.collect_list(turn)))
    plain = F.transform(ordered, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    talks = turns.groupBy("conv_id", alone.alias("alone")).agg(plain.alias("turns"))
    key = F.struct(F.col("conv_id").isNull().alias("last"), "conv_id", "alone")
    salts = SALTS_PER_PARTITION * int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    talks = talks.select("conv_id", "alone", "turns", F.sha2(F.to_json(F.col("turns")[0], {"ignoreNullFields": "false"}).cast("binary"), 256).alias("first"))
    talks = saved(talks.withColumn("salt", F.pmod(F.xxhash64("conv_id", "alone"), F.lit(salts)).cast("int")))
    least = talks.groupBy("first").agg(F.min(key).alias("best")).select(F.col("best.conv_id").alias("chosen_id"), F.col("best.alone").alias("chosen_alone"))
    is_least = F.col("conv_id").eqNullSafe(F.col("chosen_id")) & F.col("alone").eqNullSafe(F.col("chosen_alone"))
    chosen = talks.join(least, is_least).select("first", "chosen_id", "chosen_alone", F.col("turns").alias("best_turns"))
    used = talks.select("first", "salt").distinct()
    copies = used.join(chosen, "first")
    paired = talks.join(copies, ["first", "salt"])

    own = F.col("turns")
    said = F.filter(F.transform(own, lambda t, i: F.when(t["role"] == "assistant", i)), lambda i: i.isNotNull())
    last, stale = F.try_element_at(said, F.lit(-1)), F.try_element_at(said, F.lit(-2))
    head = F.slice(own, 1, F.coalesce(last, F.size(own)))
    tail = F.when(stale.isNotNull(), F.slice(own, stale + 1, F.lit(1))).otherwise(F.array().cast(TURNS))
    is_best = F.col("conv_id").eqNullSafe(F.col("chosen_id")) & F.col("alone").eqNullSafe(F.col("chosen_alone"))
    return paired.select(
        "conv_id",
        "chosen_id",
        F.col("best_turns").alias("chosen"),
        F.when(~is_best, F.col("conv_id")).alias("rejected_id"),
        F.when(is_best, F.concat(head, tail)).otherwise(own).alias("rejected"),
    )


def preference_rows(turns: DataFrame) -> DataFrame:
    """The formatted pairs of a table of turns, with their loss spans as text."""
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    made = format_preferences(preference_pairs(turns)).drop("chosen", "rejected")
    return made.withColumns({c: text(c) for c in ("chosen_loss", "rejected_loss")})


def _sql_parts(turns: str) -> tuple[str, str]:
    """SQL for the rendering of a list of turns, and for its loss spans."""
    safe = lambda c: f"replace(coalesce({c}, ''), '<|', concat('<', chr(8203), '|'))"
    one = lambda t: f"concat('{OPEN}', {safe(t + '.role')}, chr(10), {safe(t + '.text')}, '<|im_end|>', chr(10))"
    text = f"coalesce(array_to_string(list_transform({turns}, lambda t: {one('t')}), ''), '')"
    before = f"coalesce(list_sum(list_transform({turns}[1:i - 1], lambda t: length({one('t')}))), 0)"
    begin = f"({before} + {len(OPEN) + 1} + length({safe(f'{turns}[i].role')}))"
    end = f"({begin} + length({safe(f'{turns}[i].text')}) + {len(CLOSE) - 1})"
    said = f"list_filter(range(1, len({turns}) + 1), lambda i: {turns}[i].role = 'assistant')"
    return text, f"coalesce(array_to_string(list_transform({said}, lambda i: concat(CAST({begin} AS BIGINT), ':', CAST({end} AS BIGINT))), ','), '')"


_PROMPT = _sql_parts("common")[0]
_CHOSEN, _CHOSEN_LOSS = _sql_parts("rest_a")
_REJECTED, _REJECTED_LOSS = _sql_parts("rest_b")
ORACLE_SQL = f"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
talks AS (
  SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turns FROM t GROUP BY conv_id),
firsts AS (
  SELECT conv_id, turns, min(conv_id) OVER (PARTITION BY turns[1].role, turns[1].text) AS best,
         list_filter(range(1, len(turns) + 1), lambda i: turns[i].role = 'assistant') AS said FROM talks),
paired AS (
  SELECT f.conv_id, f.best AS chosen_id, CASE WHEN f.conv_id <> f.best THEN f.conv_id END AS rejected_id, b.turns AS a,
         CASE WHEN f.conv_id <> f.best THEN f.turns
              ELSE list_concat(f.turns[1:coalesce(f.said[-1] - 1, len(f.turns))], CASE WHEN len(f.said) > 1 THEN [f.turns[f.said[-2]]] ELSE [] END) END AS b
  FROM firsts f JOIN talks b ON b.conv_id = f.best),
counted AS (
  SELECT *, CAST(coalesce(list_min(list_filter(range(1, greatest(len(a), len(b)) + 1), lambda i: a[i] IS DISTINCT FROM b[i])) - 1, len(a)) AS INTEGER) AS n_common FROM paired),
parted AS (SELECT *, a[1:n_common] AS common, a[n_common + 1:] AS rest_a, b[n_common + 1:] AS rest_b FROM counted)
SELECT conv_id, chosen_id, rejected_id, n_common, {_PROMPT} AS prompt, {_CHOSEN} AS chosen_text, {_CHOSEN_LOSS} AS chosen_loss,
       {_REJECTED} AS rejected_text, {_REJECTED_LOSS} AS rejected_loss FROM parted
"""
