"""Checks of what a pattern has matched: control digits, digit counts, span cleaning."""

from __future__ import annotations

from functools import reduce
from operator import xor

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lets import let
from .spans import SPAN

# Weights of the control digits.
INN10 = (2, 4, 10, 3, 5, 9, 4, 6, 8)
INN12_FIRST = (7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
INN12_SECOND = (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
SNILS = (9, 8, 7, 6, 5, 4, 3, 2, 1)

# Words that are labels of personal data and never names.
PERSON_STOPWORDS = (
    "паспорт", "снилс", "инн", "огрн", "кпп", "бик", "телефон", "тел",
    "адрес", "почта", "email", "карта", "дата", "серия", "номер", "счёт",
    "счет", "договор", "заказ", "банковская", "мобильный", "электронная",
)


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]", "")


def digit_count(value: Column) -> Column:
    """Digits of any script."""
    return F.length(F.regexp_replace(value, r"(?U)\D", ""))


def weighted(digits: Column, weights: tuple[int, ...]) -> Column:
    return sum((F.substring(digits, i + 1, 1).try_cast("int") * w for i, w in enumerate(weights)), F.lit(0))


def inn_valid(value: Column) -> Column:
    """Control digits of a tax number of 10 or 12 digits."""

    def check(d: Column) -> Column:
        control = lambda weights: weighted(d, weights) % 11 % 10 == F.substring(d, len(weights) + 1, 1).try_cast("int")
        return F.when(F.length(d) == 10, control(INN10)).when(F.length(d) == 12, control(INN12_FIRST) & control(INN12_SECOND)).otherwise(False)

    return let(digits_of(value), check)


def snils_valid(value: Column) -> Column:
    """Control number of a social-insurance number of 11 digits."""

    def check(d: Column) -> Column:
        rest = weighted(d, SNILS) % 101
        return F.when(F.length(d) == 11, F.when(rest == 100, 0).otherwise(rest) == F.substring(d, 10, 2).try_cast("int")).otherwise(False)

    return let(digits_of(value), check)


def iban_valid(value: Column) -> Column:
    """ISO 7064 mod 97 of an account number."""
    plain = F.upper(F.regexp_replace(value, r"[\s-]", ""))

    def check(v: Column) -> Column:
        moved = F.concat(F.substring(v, 5, 40), F.substring(v, 1, 4))
        number = lambda c: F.when(F.ascii(c) >= 65, F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
        step = lambda acc, c: (acc * F.when(F.ascii(c) >= 65, 100).otherwise(10) + number(c)) % 97
        return F.aggregate(F.split(moved, "(?!^)(?!$)"), F.lit(0), step) == 1

    return let(plain, check)


# Alphabets and generator of public address formats.
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
BECH32_GENERATOR = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)


def base58_valid(value: Column) -> Column:
    """A Base58Check address: 25 bytes, the last four being the begin of the double SHA-256 of the others.

    Five characters at a time go into seven limbs of 32 bits, whose products fit a long.
    """
    powers = F.array(*[F.lit(58**i).cast("long") for i in range(6)])
    number = lambda part: F.aggregate(F.split(part, "(?!^)(?!$)"), F.lit(0).cast("long"), lambda n, c: n * 58 + F.instr(F.lit(BASE58), c) - 1)
    parts = F.transform(F.regexp_extract_all(value, F.lit("(?s).{1,5}"), F.lit(0)), lambda part: F.struct(number(part).alias("add"), F.get(powers, F.length(part)).alias("times")))

    def put(limbs: Column, part: Column) -> Column:
        def step(acc: Column, limb: Column) -> Column:
            of = lambda n: F.struct(F.shiftright(n, 32).alias("carry"), F.concat(acc["out"], F.array(n.bitwiseAND(0xFFFFFFFF))).alias("out"))
            return let(limb * part["times"] + acc["carry"], of)

        begin = F.struct(part["add"].alias("carry"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(limbs, begin, step, lambda acc: acc["out"])

    def check(limbs: Column) -> Column:
        whole = F.array_join(F.transform(F.reverse(limbs), lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")
        return let(F.substring(whole, 7, 50), lambda digits: F.substring(sha_twice(F.substring(digits, 1, 42)), 1, 8) == F.substring(digits, 43, 8))

    sha_twice = lambda digits: F.sha2(F.unhex(F.sha2(F.unhex(digits), 256)), 256)
    return let(F.aggregate(parts, F.array_repeat(F.lit(0).cast("long"), 7), put), check)


def bech32_valid(value: Column) -> Column:
    """The checksum of a ``bc1`` address, of either version."""
    prefix = [ord(c) >> 5 for c in "bc"] + [0] + [ord(c) & 31 for c in "bc"]
    own = F.transform(F.split(F.substring(F.lower(value), 4, 90), "(?!^)(?!$)"), lambda c: F.instr(F.lit(BECH32), c) - 1)

    feedback = F.array(*[F.lit(reduce(xor, (g for i, g in enumerate(BECH32_GENERATOR) if top >> i & 1), 0)) for top in range(32)])
    step = lambda acc, v: F.shiftleft(acc.bitwiseAND(0x1FFFFFF), 5).bitwiseXOR(v).bitwiseXOR(F.get(feedback, F.shiftright(acc, 25)))
    total = F.aggregate(F.concat(F.array(*map(F.lit, prefix)), own), F.lit(1), step)
    return total.isin(1, 0x2BC830A3)


def clean_person(text: Column, span: Column) -> Column:
    """A name's span without ragged ends, or null.

    Edges that are no letters go.  Then a span is dropped if it has under two
    characters, ends inside a word, begins inside one and is shorter than four,
    or is a stop-word; a longer one that begins inside a word grows to the
    word's start.
    """
    inner = F.substring(text, span["start"] + 1, span["end"] - span["start"])
    lead = F.length(F.regexp_extract(inner, r"^[^\p{L}]*", 0))
    trail = F.length(F.regexp_extract(inner, r"[^\p{L}]*$", 0))

    def judge(s: Column) -> Column:
        size = s["end"] - s["start"]
        before = F.length(F.regexp_extract(F.substring(text, F.lit(1), s["start"]), r"\p{L}*$", 0))
        after = F.regexp_like(F.substring(text, s["end"] + 1, F.lit(1)), F.lit(r"^\p{L}"))
        grown = F.struct((s["start"] - before).cast("int").alias("start"), s["end"].cast("int").alias("end"))
        label = F.lower(F.substring(text, grown["start"] + 1, grown["end"] - grown["start"])).isin(*PERSON_STOPWORDS)
        return F.when((size >= 2) & ~after & ((before == 0) | (size >= 4)) & ~label, grown)

    trimmed = F.struct((span["start"] + lead).cast("int").alias("start"), (span["end"] - trail).cast("int").alias("end"))
    return let(trimmed, judge).cast(SPAN)
