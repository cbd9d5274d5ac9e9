"""From detections to masked text: policy, resolution, numbering, rebuilding, gating."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.lets import is_blank, let
from ..functions.spans import cut, no_spans, overlap
from .person import complete
from .recognizers import SPAN, Recognizer, detect

# Types that are never masked, and the placeholder of each type.
EXCLUDED = ("LOCATION", "NRP")
PLACEHOLDERS = {
    "PERSON": "<PERSON>",
    "PHONE_NUMBER": "<PHONE>",
    "EMAIL_ADDRESS": "<EMAIL>",
    "INN": "<INN>",
    "SNILS": "<SNILS>",
    "PASSPORT": "<PASSPORT>",
    "DATE_OF_BIRTH": "<DATE_OF_BIRTH>",
    "CREDIT_CARD": "<CREDIT_CARD>",
    "ADDRESS": "<ADDRESS>",
}
OTHER = "<PII>"
ENTITY = "struct<entity_type:string,start:int,end:int,score:double,value:string>"


def policy(recognizers: Iterable[Recognizer] | None = None) -> list[str]:
    """The types that may be masked."""
    return sorted({r.entity for r in (complete() if recognizers is None else recognizers)} - set(EXCLUDED))


def narrowed(disable: Column, types: list[str]) -> Column:
    """Of the requested types, those that the policy has, in upper case."""
    return F.array_intersect(F.transform(disable, lambda x: F.upper(F.trim(x))), F.array(*map(F.lit, types)))


def ignored(disable: Column, types: list[str]) -> Column:
    """Of the requested types, those that the policy lacks."""
    return F.array_except(F.transform(disable, lambda x: F.upper(F.trim(x))), F.array(*map(F.lit, types)))


def parse_disable(form: Column) -> Column:
    """A comma-separated list; null if nothing is in it."""
    parts = F.filter(F.transform(F.split(form, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts)


def allowed(spans: Column, disable: Column | None = None) -> Column:
    """Without excluded and disabled types.  This comes before resolution, so a weaker detection can take over."""
    kept = F.filter(spans, lambda s: ~s["entity_type"].isin(*EXCLUDED))
    if disable is None:
        return kept
    off = F.transform(F.coalesce(disable, F.array().cast("array<string>")), lambda x: F.upper(F.trim(x)))
    return F.filter(kept, lambda s: ~F.array_contains(off, s["entity_type"]))


def resolve(spans: Column) -> Column:
    """Disjoint spans: by falling score, then falling length, each that overlaps none before it.

    Ties go to the earlier start, then to the earlier recognizer.
    """
    key = lambda s: F.struct((-s["score"]).alias("a"), (s["start"] - s["end"]).alias("b"), s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["entity_type"].alias("entity_type"), s["score"].alias("score"))
    plain = lambda s: F.struct(*[s[c].alias(c) for c in ("entity_type", "start", "end", "score", "rank")])
    ordered = F.transform(F.array_sort(F.transform(spans, key)), plain)
    keep = lambda acc, s: F.when(F.exists(acc, lambda k: overlap(k, s)), acc).otherwise(F.concat(acc, F.array(s)))
    return F.aggregate(ordered, no_spans(SPAN), keep)


def placeholder(entity: Column, operators: dict[str, str] | None = None) -> Column:
    """What stands for a type; ``operators`` replaces or adds to the fixed placeholders."""
    names = F.create_map(*[F.lit(x) for kv in (PLACEHOLDERS | (operators or {})).items() for x in kv])
    return F.coalesce(F.try_element_at(names, entity), F.lit(OTHER))


def numbered(resolved: Column, text: Column, operators: dict[str, str] | None = None) -> Column:
    """Spans by start, with the value and the placeholder numbered by its occurrence in the text."""
    by_start = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["entity_type"].alias("entity_type"), F.round(s["score"], 2).alias("score"), placeholder(s["entity_type"], operators).alias("base"), cut(text, s).alias("value"))

    def number(spans: Column) -> Column:
        def one(s: Column, i: Column) -> Column:
            nth = F.size(F.filter(F.slice(spans, F.lit(1), i + 1), lambda y: y["base"] == s["base"]))
            name = F.when(nth == 1, s["base"]).otherwise(F.concat(F.rtrim(s["base"], F.lit(">")), F.lit("_"), nth.cast("string"), F.lit(">")))
            return F.struct(*[s[c].alias(c) for c in ("entity_type", "start", "end", "score", "value")], name.alias("placeholder"))

        return F.transform(spans, one)

    return let(F.array_sort(F.transform(resolved, by_start)), number)


def rebuilt(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its placeholder, in one pass."""

    def piece(s: Column, i: Column) -> Column:
        from_ = F.when(i == 0, 0).otherwise(F.get(spans, i - 1)["end"])
        return F.concat(F.substring(text, from_ + 1, s["start"] - from_), s["placeholder"])

    last = F.coalesce(F.try_element_at(spans, F.lit(-1))["end"], F.lit(0))
    return F.concat(F.array_join(F.transform(spans, piece), ""), F.substring(text, last + 1, F.length(text)))


def masked(text: Column, detections: Column, disable: Column | None = None, operators: dict[str, str] | None = None) -> Column:
    """``original, anonymized, entities_found, mapping`` of a text, given its detections."""

    def result(spans: Column) -> Column:
        entity = lambda s: F.struct(*[s[c].alias(c) for c in ("entity_type", "start", "end", "score", "value")])
        pair = lambda s: F.struct(s["placeholder"].alias("key"), s["value"].alias("value"))
        return F.struct(
            text.alias("original"),
            rebuilt(text, spans).alias("anonymized"),
            F.transform(spans, entity).cast(f"array<{ENTITY}>").alias("entities_found"),
            F.map_from_entries(F.transform(spans, pair)).alias("mapping"),
        )

    kept = F.when(is_blank(text), no_spans(SPAN)).otherwise(allowed(detections, disable))
    return F.when(text.isNotNull(), let(numbered(let(kept, resolve), text, operators), result))


def anonymize(
    text: Column,
    disable: Column | list[str] | None = None,
    recognizers: tuple[Recognizer, ...] | None = None,
    operators: dict[str, str] | None = None,
    found: Column | None = None,
) -> Column:
    """Mask a text reversibly; null stays null, blank text stays as it is.

    Without ``recognizers``, the whole registry and the rules for names work.
    ``operators`` maps types to placeholders of the form ``<NAME>``; ``found``
    are further detections, like those of a model for names.
    A list of disabled types that is known when the plan is built also removes
    their recognizers from it.
    """
    chosen = complete() if recognizers is None else recognizers
    if isinstance(disable, list):
        off = {t.strip().upper() for t in disable}
        chosen, disable = tuple(r for r in chosen if r.entity not in off), None
    every = lambda t: detect(t, chosen) if found is None else F.concat(detect(t, chosen), found)
    return let(text, lambda t: masked(t, every(t), disable, operators))


def gated(result: Column, show_mapping: Column | bool = False, drop_original: bool = False) -> Column:
    """Without permission, an empty mapping and entities without values."""
    show = F.lit(show_mapping) if isinstance(show_mapping, bool) else show_mapping
    hidden = F.transform(result["entities_found"], lambda e: e.withField("value", F.lit("")))
    nothing = F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>"))
    return F.struct(
        *([] if drop_original else [result["original"].alias("original")]),
        result["anonymized"].alias("anonymized"),
        F.when(show, result["entities_found"]).otherwise(hidden).alias("entities_found"),
        F.when(show, result["mapping"]).otherwise(nothing).alias("mapping"),
    )


def deanonymize(text: Column, mapping: Column) -> Column:
    """``text`` with placeholders replaced, and ``replaced``, how many were.

    Placeholders go by falling length, ties in the map's order; a later one also
    acts on what an earlier one put in.
    """
    indexed = F.transform(F.map_entries(F.coalesce(mapping, F.create_map().cast("map<string,string>"))), lambda e, i: F.struct((-F.length(e["key"])).alias("n"), i.alias("i"), e["key"].alias("k"), e["value"].alias("v")))

    def step(acc: Column, e: Column) -> Column:
        gone = F.length(acc["text"]) - F.length(F.replace(acc["text"], e["k"], F.lit("")))
        count = F.when(F.length(e["k"]) > 0, (gone / F.length(e["k"])).cast("int")).otherwise(0)
        return F.struct(F.replace(acc["text"], e["k"], e["v"]).alias("text"), (acc["replaced"] + count).cast("int").alias("replaced"))

    return F.aggregate(F.array_sort(indexed), F.struct(text.alias("text"), F.lit(0).alias("replaced")), step)
