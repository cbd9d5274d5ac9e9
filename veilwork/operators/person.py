"""Names of persons: rules that need no model, and any model as a pandas UDF.

The rules take runs of capitalised words that hold a patronymic or a known given
name.  They are no substitute for a trained model and claim no such recall.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checks import clean_person
from ..functions.spans import cut, find_all, no_spans
from .recognizers import SPAN, Recognizer, registry

SCORE = 0.9
# Stems of common given names.
GIVEN = (
    "александр", "алексе", "анатол", "андре", "анн", "антон", "арте", "борис", "вадим", "валент", "валери", "васил",
    "вер", "виктор", "владимир", "галин", "дарь", "денис", "дмитри", "евген", "екатерин", "елен", "иван", "игор", "ирин",
    "кирилл", "ксени", "ларис", "людмил", "максим", "мари", "михаил", "надежд", "натал", "никит", "никола", "оксан", "олег",
    "ольг", "павел", "петр", "пётр", "роман", "светлан", "серге", "софь", "степан", "татьян", "фёдор", "юли", "юри",
)
RUN = r"(?U)\b[А-ЯЁ][а-яё]+(?:-[А-ЯЁ][а-яё]+)?(?:\s+[А-ЯЁ][а-яё]+(?:-[А-ЯЁ][а-яё]+)?){0,2}"
PATRONYMIC = r"(?U)\b[А-ЯЁ][а-яё]+(?:ович|евич|ьич|овн|евн|иничн|ичн)(?:а|у|ем|ом|е|ы|ой|ою)?\b"


def scored(text: Column, spans: Column, rank: int) -> Column:
    """Raw spans to cleaned PERSON detections."""
    clean = F.filter(F.transform(spans, lambda s: clean_person(text, s)), lambda s: s.isNotNull())
    full = lambda s: F.struct(F.lit("PERSON").alias("entity_type"), s["start"].alias("start"), s["end"].alias("end"), F.lit(SCORE).alias("score"), F.lit(rank).alias("rank"))
    return F.transform(clean, full).cast(f"array<{SPAN}>")


@dataclass(frozen=True)
class PersonRules(Recognizer):
    name: str = "person_rules"
    entity: str = "PERSON"
    patterns: tuple = ()

    def spans(self, text: Column, rank: int) -> Column:
        given = r"(?iU)(?:^|\s)(?:" + "|".join(GIVEN) + r")[а-яё]{0,3}(?=\s|$|-)"
        likely = lambda v: F.regexp_like(v, F.lit(PATRONYMIC)) | F.regexp_like(v, F.lit(given))
        runs = F.filter(find_all(text, RUN), lambda s: likely(cut(text, s)))
        return F.when(F.regexp_like(text, F.lit("[А-ЯЁ][а-яё]")), scored(text, runs, rank)).otherwise(no_spans(SPAN))


@dataclass(frozen=True)
class PersonModel(Recognizer):
    """A model: ``load()`` gives a function from a text to (start, end) pairs; it is loaded once a worker."""

    name: str = "person_model"
    entity: str = "PERSON"
    patterns: tuple = ()
    load: Callable[[], Callable[[str], Iterable[tuple[int, int]]]] | None = None

    def column(self, text: Column) -> Column:
        """Raw spans by the model; to be put into a column of its own before ``spans`` of it are used."""
        load, cache = self.load, {}

        @F.pandas_udf("array<struct<start:int,end:int>>")
        def run(texts: pd.Series) -> pd.Series:
            if "model" not in cache:
                cache["model"] = load()
            return pd.Series([[{"start": a, "end": b} for a, b in cache["model"](t)] if t else [] for t in texts])

        return run(text)


def complete(*more: Recognizer, without: tuple[str, ...] = ()) -> tuple[Recognizer, ...]:
    """What masks when nothing else is chosen: the registry and the rules for names, so that no name goes unnoticed for want of a model."""
    return registry(*more, *([] if "person_rules" in without else [PersonRules()]), without=without)


def require_person(recognizers: tuple[Recognizer, ...], allow_no_person: bool = False) -> tuple[Recognizer, ...]:
    """Refuse to work without a source of names unless that is allowed."""
    if not allow_no_person and not any(r.entity == "PERSON" for r in recognizers):
        raise ValueError("no recognizer finds names; pass one or allow_no_person=True")
    return recognizers


def model_spans(df: DataFrame, text: str, model: PersonModel, name: str = "person_spans") -> DataFrame:
    """Add the model's detections of a text column; null texts have none."""
    raw = df.withColumn(name, model.column(F.col(text)))
    return raw.withColumn(name, F.when(F.col(text).isNotNull(), scored(F.col(text), F.col(name), -1)).otherwise(no_spans(SPAN)))
