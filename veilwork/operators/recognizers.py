"""The recognizers, declared: entity, patterns, score, validator, context."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import checks
from ..functions.spans import cut, find_all, no_spans
from .context import boosted

SPAN = "struct<entity_type:string,start:int,end:int,score:double,rank:int>"

# Shared pieces of the patterns.
GAP = r"(?:[^\w.!?\n]+\w+){0,2}?[\s:№.\-–—]{0,6}"
AT = r"(?:@|\(\s*at\s*\)|\[\s*at\s*\]|\bat\b|собак[аеу]|\(\s*собак[аеу]\s*\))"
DOT = r"(?:\.|\(\s*dot\s*\)|\[\s*dot\s*\]|\bdot\b|точк[аеу]|\(\s*точк[аеу]\s*\)|\[\s*точк[аеу]\s*\])"
LOCAL = r"[\w.+\-]+(?:\s+[\w.+\-]+){0,2}"
INN_NUMBER = r"\d[\d\s.\-–—]{6,40}\d"
SNILS_NUMBER = r"\d[\d\s.\-–—]{6,30}\d"
PASSPORT_NUMBER = r"(?:\d{2}[\s\-/]?\d{2}[\s\-/№.]{0,4}\d{3}[\s\-/]?\d{3}|\d{10})"
# a digest or key has phone-like digits now and then: with ten hexadecimal digits before or after them they are no phone
OPEN, CLOSED = r"(?<!\d)(?<![0-9a-f]{10})", r"(?!\d)(?![0-9a-f]{10})"
STREET = (
    r"(?:ул\.|улиц[аеыу]|просп\.|проспект[ае]?|пр-?т|пер\.|переул(?:ок|ка|ке)|б-р|бульвар[ае]?|ш\.|шоссе|наб\.|"
    r"набережн(?:ая|ой)|пл\.|площад[ьи]|кв-?л|квартал[ае]?|проезд[ае]?|тупик)"
)
HOUSE = r"(?:д\.|дом|влд\.|владени[ея]|стр\.|строени[ея]|корп\.|корпус[ае]?|к\.)"
FLAT = r"(?:кв\.|квартир[аеыу]|офис[ае]?|оф\.|помещени[ея]|комн\.|комнат[аеыу])"
STREET_NAME = r"[А-ЯЁ][А-Яа-яёЁ\-]+(?:\s+[А-ЯЁ][А-Яа-яёЁ\-]+)*"
CITY = (
    r"(?:Российская\s+Федерация|ДНР|ЛНР|(?:г\.о\.|г\.|город|обл\.|область|край|респ\.|республик\w*|р-н|район|пгт|пос\.|"
    r"посёлок|поселок|село)\s*[А-ЯЁ][А-Яа-яёЁ\-\.]+|[А-ЯЁ][А-Яа-яёЁ]+(?:-[А-ЯЁ]?[А-Яа-яёЁ]+)+|[А-ЯЁ][А-Яа-яёЁ]+\s+(?:область|край))"
)
ADDRESS = (
    rf"(?:\b\d{{6}}\b\s*,?\s*)?(?:{CITY}\s*,\s*)*(?:{STREET}\s*[«\"]?{STREET_NAME}|{STREET_NAME}\s+{STREET})"
    rf"(?:\s*,?\s*(?:кв-?л\.?|{HOUSE})\s*№?\s*\d+[а-яё]?(?:[/\-]\d+[а-яё]?)*)*(?:\s*,?\s*{FLAT}\s*№?\s*\d+)?"
)

# Words near a span that raise its score, as stems of their lemmas.
PASSPORT_CONTEXT = ("паспорт", "сери", "документ", "загранпаспорт", "удостоверен")
BIRTH_CONTEXT = ("родил", "рожд", "рождён", "д.р", "г.р", "др", "гр", "дат")
CARD_CONTEXT = ("карт", "банковск", "мир", "виз")
ADDRESS_CONTEXT = ("адрес", "прожива", "прописан", "зарегистрирован", "доставк")


@dataclass(frozen=True)
class Recognizer:
    """What finds one kind of entity in a text.

    ``patterns`` are (expression, score).  ``needs`` is a cheap expression
    without which none can match.  ``valid`` makes the score 1 or drops the
    match; ``digits`` are the allowed digit counts; ``group`` 1 masks the group.
    ``numeric`` tells that each match holds a digit: such recognizers are passed
    over together in a text without one.
    """

    name: str
    entity: str
    patterns: tuple[tuple[str, float], ...]
    needs: str = r"[0-9]"
    flags: str = "(?iUsm)"
    group: int = 0
    digits: tuple[int, ...] = ()
    valid: Callable[[Column], Column] | None = None
    context: tuple[str, ...] = ()
    numeric: bool = False

    def spans(self, text: Column, rank: int) -> Column:
        """All detections, as an array of scored spans."""
        found = F.concat(*[self._of(text, p, s, rank) for p, s in self.patterns])
        return F.when(F.regexp_like(text, F.lit(self.needs)), found).otherwise(no_spans(SPAN))

    def _of(self, text: Column, pattern: str, score: float, rank: int) -> Column:
        found = find_all(text, self.flags + pattern, self.group)
        if self.digits:
            found = F.filter(found, lambda s: checks.digit_count(cut(text, s)).isin(*self.digits))
        if self.valid:
            found = F.filter(found, lambda s: self.valid(cut(text, s)))
        base = F.lit(1.0 if self.valid else score)
        grade = (lambda s: boosted(text, s, base, self.context)) if self.context else lambda s: base
        full = lambda s: F.struct(F.lit(self.entity).alias("entity_type"), s["start"].alias("start"), s["end"].alias("end"), grade(s).alias("score"), F.lit(rank).alias("rank"))
        return F.transform(found, full).cast(f"array<{SPAN}>")


def anchored(name: str, entity: str, patterns: tuple[str, ...], digits: tuple[int, ...], score: float, needs: str = "[0-9]") -> Recognizer:
    """A number beside a keyword; only the number is masked, no checksum is asked."""
    return Recognizer(name, entity, tuple((p, score) for p in patterns), needs, "(?iU)", 1, digits, numeric=True)


# Patterns and scores.
RECOGNIZERS: tuple[Recognizer, ...] = (
    Recognizer("address", "ADDRESS", ((ADDRESS, 0.95),), needs=rf"(?iU)(?=[убпшнкт]){STREET}", context=ADDRESS_CONTEXT),
    Recognizer(
        "phone",
        "PHONE_NUMBER",
        (
            (r"(?<!\d)\+7[\s\-]?\(?\d{3}\)?[\s\-]?\d{3}[\s\-]?\d{2}[\s\-]?\d{2}(?!\d)", 0.9),
            (rf"{OPEN}8[\s\-]?\(?\d{{3}}\)?[\s\-]?\d{{3}}[\s\-]?\d{{2}}[\s\-]?\d{{2}}{CLOSED}", 0.85),
            (rf"{OPEN}[78][\s\-]?9(?:[\s\-]?\d){{9}}{CLOSED}", 0.6),
            (rf"{OPEN}9\d{{9}}{CLOSED}", 0.5),
        ),
        r"(?U)\d(?:[\s\-()]{0,2}\d){9}",
        numeric=True,
    ),
    Recognizer("inn", "INN", ((r"\b\d{12}\b", 0.5), (r"\b\d{10}\b", 0.4)), r"[0-9]{10}", valid=checks.inn_valid, numeric=True),
    anchored("inn_anchored", "INN", (rf"ИНН{GAP}({INN_NUMBER})", rf"идентификационн\w*\s+номер\w*{GAP}({INN_NUMBER})"), (10, 12), 0.9, "(?iU)инн|идентификационн"),
    Recognizer("snils", "SNILS", ((r"\b\d{3}-\d{3}-\d{3}\s?\d{2}\b", 0.85), (r"\b\d{3}\s\d{3}\s\d{3}\s?\d{2}\b", 0.8)), r"(?U)\d{3}[\s\-]\d{3}[\s\-]\d{3}", valid=checks.snils_valid, numeric=True),
    anchored("snils_anchored", "SNILS", (rf"СНИЛС{GAP}({SNILS_NUMBER})", rf"страхов\w*\s+свидетельств\w*{GAP}({SNILS_NUMBER})"), (11,), 0.9, "(?iU)снилс|страхов"),
    Recognizer("passport", "PASSPORT", ((r"\b\d{4}\s*(?:номер|н[оo]мер|№)\s*\d{6}\b", 0.7),), "(?iU)н[оo]мер|№", context=PASSPORT_CONTEXT, numeric=True),
    anchored(
        "passport_anchored",
        "PASSPORT",
        (
            rf"паспорт[а-яё]*(?:\s*рф)?{GAP}(?:сери[яию]\W{{0,4}})?№?\s*({PASSPORT_NUMBER})",
            r"(сери[яию]\W{0,4}№?\s*\d{2}\s?\d{2}\W{0,14}(?:номер|№)\W{0,4}№?\s*\d{3}\s?\d{3})",
            r"((?:номер|№)\W{0,4}№?\s*\d{3}\s?\d{3}\W{0,14}сери[яию]\W{0,4}№?\s*\d{2}\s?\d{2})",
        ),
        (10,),
        0.85,
        "(?iU)паспорт|сери[яию]",
    ),
    Recognizer("email", "EMAIL_ADDRESS", ((r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", 0.9),), "@"),
    Recognizer("email_spoken", "EMAIL_ADDRESS", ((rf"{LOCAL}\s*{AT}\s*[\w\-]+\s*{DOT}\s*[A-Za-z]{{2,6}}", 0.85),), rf"(?iU){AT}\s*[\w\-]+\s*{DOT}\s*[A-Za-z]"),
    Recognizer("birth", "DATE_OF_BIRTH", ((r"\b\d{2}\.\d{2}\.\d{4}\b", 0.4), (r"\b\d{2}/\d{2}/\d{4}\b", 0.4)), r"(?U)\d{2}[./]\d{2}[./]\d{4}", context=BIRTH_CONTEXT, numeric=True),
    anchored("birth_anchored", "DATE_OF_BIRTH", (r"дата\s+рожд\w*(?:\W+\w+){0,3}?\W{0,5}(\d{2}[.\-/]?\d{2}[.\-/]?\d{4}|\d{8})",), (8,), 0.7, "(?iU)рожд"),
    Recognizer("card", "CREDIT_CARD", ((r"\b\d{4}[\s\-.]?\d{4}[\s\-.]?\d{4}[\s\-.]?\d{4}\b", 0.7), (r"\b\d{2}(?:[\s\-_.]?\d{2}){7}\b", 0.55)), r"(?U)\d(?:[\s\-_.]?\d){15}", context=CARD_CONTEXT, numeric=True),
    anchored(
        "card_anchored",
        "CREDIT_CARD",
        (rf"(?:карт[а-яё]*|maestro|amex|american\s+express|mastercard|виз[аы]|visa|unionpay){GAP}(\d[\d\s\-.]{{10,25}}\d)",),
        (12, 13, 14, 15, 16, 17, 18, 19),
        0.8,
        "(?iU)карт|maestro|amex|express|mastercard|виз|visa|unionpay",
    ),
)

# What a general framework finds in any language; it is masked as <PII>.
GENERAL: tuple[Recognizer, ...] = (
    Recognizer("date", "DATE_TIME", ((r"\b(?:\d{1,2}[./-]\d{1,2}[./-](?:\d{4}|\d{2})|\d{4}-\d{2}-\d{2})\b", 0.6),), r"(?U)\d[./-]\d", numeric=True),
    Recognizer("url", "URL", ((r"\bhttps?://[^\s<>\"']+", 0.6),), "://"),
    Recognizer("ip", "IP_ADDRESS", ((r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b", 0.6),), r"[0-9]\.[0-9]{1,3}\.[0-9]", numeric=True),
    Recognizer("ipv6", "IP_ADDRESS", ((r"(?<![\w:])(?=[0-9A-F:]*[0-9])(?:(?:[0-9A-F]{1,4}:){7}[0-9A-F]{1,4}|(?:[0-9A-F]{1,4}:){1,7}:|(?:[0-9A-F]{1,4}:){1,6}(?::[0-9A-F]{1,4}){1,6}|::(?:[0-9A-F]{1,4}:){0,6}[0-9A-F]{1,4})(?![\w:])", 0.6),), r"(?i)[0-9A-F:]:[0-9A-F:]", numeric=True),
    Recognizer("wallet", "CRYPTO", ((r"\b(?-i:[13][a-km-zA-HJ-NP-Z1-9]{25,33})\b", 0.5),), r"[13][A-Za-z0-9]{25}", valid=checks.base58_valid, numeric=True),
    Recognizer("segwit", "CRYPTO", ((r"\bbc1[02-9ac-hj-np-z]{11,71}\b", 0.5),), "(?i)bc1", valid=checks.bech32_valid, numeric=True),
    Recognizer("iban", "IBAN_CODE", ((r"\b[A-Z]{2}\d{2}(?:[ -]?[A-Z0-9]{4}){2,7}(?:[ -]?[A-Z0-9]{1,3})?\b", 0.5),), r"[A-Za-z]{2}[0-9]{2}", valid=checks.iban_valid, numeric=True),
)


def describe(recognizers: tuple[Recognizer, ...] | None = None, excluded: tuple[str, ...] = ("LOCATION", "NRP")) -> dict:
    """``status, person_ready, supported``: whether names can be found, and the sorted types that may be masked."""
    known = {r.entity for r in (registry() if recognizers is None else recognizers)}
    return {"status": "ok" if "PERSON" in known else "degraded", "person_ready": "PERSON" in known, "supported": sorted(known.difference(excluded))}


def registry(*more: Recognizer, without: tuple[str, ...] = ()) -> tuple[Recognizer, ...]:
    """The ordered recognizers: the Russian ones, the general ones, then ``more``, but for those named in ``without``."""
    return tuple(r for r in (*RECOGNIZERS, *GENERAL, *more) if r.name not in without)


def detect(text: Column, recognizers: tuple[Recognizer, ...] | None = None) -> Column:
    """All detections of all recognizers in one array, unresolved."""
    chosen = list(enumerate(registry() if recognizers is None else recognizers))
    parts = []
    for numeric, group in groupby(chosen, lambda x: x[1].numeric):
        own = [r.spans(text, i) for i, r in group]
        if numeric and len(own) > 1:
            own = [F.when(F.regexp_like(text, F.lit(r"(?U)\d")), F.concat(*own)).otherwise(no_spans(SPAN))]
        parts += own
    return F.concat(*parts) if parts else no_spans(SPAN)
