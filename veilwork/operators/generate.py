"""Synthetic labelled texts: values with control digits, filled templates, tags, splits."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.checks import INN10, INN12_FIRST, INN12_SECOND, SNILS, weighted
from ..functions.lets import let


def digits(number: Column, width: int) -> Column:
    return F.lpad((number % 10**width).cast("string"), width, "0")


def make_inn10(number: Column) -> Column:
    """A valid tax number of ten digits, from any non-negative number."""
    return let(digits(number, 9), lambda d: F.concat(d, (weighted(d, INN10) % 11 % 10).cast("string")))


def make_inn12(number: Column) -> Column:
    first = lambda d: F.concat(d, (weighted(d, INN12_FIRST) % 11 % 10).cast("string"))
    second = lambda d: F.concat(d, (weighted(d, INN12_SECOND) % 11 % 10).cast("string"))
    return let(let(digits(number, 10), first), second)


def make_snils(number: Column) -> Column:
    """A valid social-insurance number in the form ``ddd-ddd-ddd dd``."""

    def build(d: Column) -> Column:
        rest = weighted(d, SNILS) % 101
        control = F.lpad(F.when(rest == 100, 0).otherwise(rest).cast("string"), 2, "0")
        return F.concat(F.substring(d, 1, 3), F.lit("-"), F.substring(d, 4, 3), F.lit("-"), F.substring(d, 7, 3), F.lit(" "), control)

    return let(digits(number, 9), build)


def make_phone(number: Column) -> Column:
    return let(digits(number, 9), lambda d: F.concat(F.lit("+7 (9"), F.substring(d, 1, 2), F.lit(") "), F.substring(d, 3, 3), F.lit("-"), F.substring(d, 6, 2), F.lit("-"), F.substring(d, 8, 2)))


def make_card(number: Column) -> Column:
    return let(digits(number, 15), lambda d: F.concat(F.lit("4"), F.substring(d, 1, 3), *[x for i in range(4, 16, 4) for x in (F.lit(" "), F.substring(d, i, 4))]))


# Names whose forms follow from their endings by one rule each.
MALE = ("Иван", "Антон", "Роман", "Максим", "Степан", "Виктор", "Павлин", "Фёдор")
FEMALE = ("Анна", "Елена", "Ирина", "Светлана", "Марина", "Тамара", "Дина", "Алина")
FATHERS = ("Иванов", "Антонов", "Романов", "Максимов", "Степанов", "Викторов", "Петров", "Фёдоров")
SURNAMES = ("Смирнов", "Орлов", "Белов", "Лебедев", "Ильин", "Фомин", "Зайцев", "Крылов", "Голубев", "Пушкин")
CASES = ("nomn", "gent", "datv", "accs", "ablt", "loct")
#: Endings by case: of male names and patronymics in a consonant, of male surnames, of female names in ``-а`` and of female surnames.
ENDINGS = {
    "male": ("", "а", "у", "а", "ом", "е"),
    "father_m": ("ич", "ича", "ичу", "ича", "ичем", "иче"),
    "surname_m": ("", "а", "у", "а", "ым", "е"),
    "female": ("а", "ы", "е", "у", "ой", "е"),
    "father_f": ("на", "ны", "не", "ну", "ной", "не"),
    "surname_f": ("а", "ой", "ой", "у", "ой", "ой"),
}
FORMATS = ("fps", "sfp", "fs", "sf", "fp", "ips")


def draw(number: Column, salt: int) -> Column:
    """A number below a million that looks random, from a number and a salt."""
    return F.pmod(F.pmod(number, F.lit(999_983)) * (7919 + 2 * salt) + 104_729 * salt, F.lit(999_979))


def choose(values: tuple[str, ...], number: Column, salt: int) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(draw(number, salt) / 7) % len(values) + 1).cast("int"))


def person(number: Column) -> Column:
    """``text, gender, case, format`` of a name: six cases, six orders of its parts, one in five in small letters."""
    male = draw(number, 1) % 2 == 0
    case = (F.floor(draw(number, 2) / 7) % len(CASES) + 1).cast("int")
    end = lambda kind: F.element_at(F.array(*map(F.lit, ENDINGS[kind])), case)
    first = F.when(male, F.concat(choose(MALE, number, 3), end("male"))).otherwise(F.concat(F.rtrim(choose(FEMALE, number, 3), F.lit("а")), end("female")))
    father = F.concat(choose(FATHERS, number, 4), F.when(male, end("father_m")).otherwise(end("father_f")))
    surname = F.concat(choose(SURNAMES, number, 5), F.when(male, end("surname_m")).otherwise(end("surname_f")))
    form = choose(FORMATS, number, 6)
    initials = F.concat(F.substring(first, 1, 1), F.lit("."), F.substring(father, 1, 1), F.lit("."))
    orders = {"fps": (first, father, surname), "sfp": (surname, first, father), "fs": (first, surname), "sf": (surname, first), "fp": (first, father), "ips": (initials, surname)}
    text = F.coalesce(*[F.when(form == k, F.concat_ws(" ", *v)) for k, v in orders.items()])
    low = F.floor(draw(number, 7) / 7) % 5 == 0
    return F.struct(F.when(low, F.lower(text)).otherwise(text).alias("text"), F.when(male, "masc").otherwise("femn").alias("gender"), F.element_at(F.array(*map(F.lit, CASES)), case).alias("case"), form.alias("format"))


def make_email(number: Column) -> Column:
    return F.concat(choose(("ivan", "anna", "sales", "info", "client"), number, 11), F.lit("."), (draw(number, 12) % 1000).cast("string"), F.lit("@"), choose(("mail.ru", "yandex.ru", "example.com", "test.org"), number, 13))


def make_passport(number: Column) -> Column:
    """Series and number in the form ``dd dd dddddd``."""
    two = lambda salt: (draw(number, salt) % 90 + 10).cast("string")
    return F.concat(two(21), F.lit(" "), two(22), F.lit(" "), (draw(number, 23) % 900_000 + 100_000).cast("string"))


def make_birth(number: Column) -> Column:
    """A date from 1955 to 2005, with dots or strokes."""
    two = lambda salt, n: F.lpad((draw(number, salt) % n + 1).cast("string"), 2, "0")
    sep = choose((".", "/"), number, 34)
    return F.concat(two(31, 28), sep, two(32, 12), sep, (draw(number, 33) % 51 + 1955).cast("string"))


# Sentences whose capitalised words are no names, and sentences with a name.
TOWNS = ("Тверь", "Казань", "Самара", "Пермь", "Рязань", "Томск", "Калуга", "Псков")
THINGS = ("Счёт", "Договор", "Пропуск", "Отчёт", "Чек", "Талон", "Акт", "Бланк")
STREETS = ("Лесная", "Садовая", "Полевая", "Речная", "Заводская", "Луговая")
FIRMS = ("Заря", "Маяк", "Восход", "Родник", "Спектр", "Импульс")
NEGATIVES = {
    "town": (TOWNS, ("Поезд в город {x} уже ушёл.", "Склад в городе {x} открыт до шести.", "Город {x} ждёт поставку.")),
    "thing": (THINGS, ("{x} готов, его можно забрать.", "Пришлите {x} до пятницы.", "{x} ещё не подписан.")),
    "street": (STREETS, ("Остановка «{x} улица» перенесена.", "Улица {x}, дом 4, вход со двора.", "Пункт на улице {x} закрыт.")),
    "firm": (FIRMS, ("Фирма {x} прислала счёт.", "С ООО {x} заключён договор.", "Поставка от ООО {x} задержана.")),
}
WITH_TOWN = ("{p} пишет из города {x}.", "Заявку принёс {p}, город {x}.", "В городе {x} отвечает {p}.")
CHATS = ("Добрый день, меня зовут {p}.", "Это {p}, где мой заказ?", "Передайте, что звонил {p}.", "{p} ждёт ответа.", "Возврат оформлен на {p}.")
GLUE = ("спасибо", "привет", "алло")


def _sentence(templates: tuple[str, ...], values: dict[str, Column], number: Column, salt: int) -> Column:
    """One of the templates, filled, with the span of a person."""
    filled = [fill(t, values, {"p": "PERSON"}) for t in templates]
    return F.element_at(F.array(*filled), (F.floor(draw(number, salt) / 7) % len(templates) + 1).cast("int"))


def negative(kind: str, number: Column) -> Column:
    """A sentence of ``NEGATIVES`` without spans."""
    words, templates = NEGATIVES[kind]
    return _sentence(templates, {"x": choose(words, number, 41)}, number, 42)


#: Of 35 negative sentences, how many are of each kind, the last ones with a name beside a town.
NEGATIVE_SHARES = {"town": 8, "thing": 8, "street": 7, "firm": 5, "person_town": 7}


def negatives(df: DataFrame, key: str) -> DataFrame:
    """``key, kind, text, spans``: for each row a sentence without names, or with a name beside a town, by its key."""
    number, begin, kind = F.col(key), 0, None
    spot = draw(number, 44) % sum(NEGATIVE_SHARES.values())
    for name, share in NEGATIVE_SHARES.items():
        begin += share
        kind = F.when(spot < begin, name) if kind is None else kind.when(spot < begin, name)
    word = F.coalesce(*[F.when(F.col("kind") == k, choose(words, number, 41)) for k, (words, _) in NEGATIVES.items()], choose(TOWNS, number, 41))
    # in steps, so that an expression that others use is computed once
    drawn = df.select(key, kind.alias("kind")).select(key, "kind", word.alias("x"), F.when(F.col("kind") == "person_town", let(number, lambda n: person(n)["text"])).alias("p"))
    values = {"x": F.col("x"), "p": F.col("p")}
    templates = {k: v for k, (_, v) in NEGATIVES.items()} | {"person_town": WITH_TOWN}
    one = lambda k: F.when(F.col("kind") == k, let(number, lambda n: _sentence(templates[k], values, n, 42)))
    sentence = F.coalesce(*map(one, templates))
    return drawn.select(key, "kind", sentence.alias("s")).select(key, "kind", "s.text", "s.spans")


def silver(number: Column) -> Column:
    """An unlabelled sentence: 55 % with a name, of which 12 % stick to the word before, else one without."""
    name = person(number)["text"]
    stuck = F.concat(choose(GLUE, number, 51), F.upper(F.substring(name, 1, 1)), F.substring(name, F.lit(2), F.length(name)), F.lit(" на связи."))
    chat = F.when(draw(number, 52) % 100 < 12, stuck).otherwise(_sentence(CHATS, {"p": name}, number, 53)["text"])
    kind = draw(number, 54) % 100
    other = F.when(kind < 30, negative("town", number)["text"]).when(kind < 55, negative("street", number)["text"]).when(kind < 78, negative("thing", number)["text"]).otherwise(negative("firm", number)["text"])
    return F.when(draw(number, 55) % 100 < 55, chat).otherwise(other)


def silver_corpus(spark: SparkSession, n: int = 8000) -> DataFrame:
    """``id, text``; ``write_corpus`` writes it a sentence a line."""
    return spark.range(n).select("id", silver(F.col("id")).alias("text"))


def fill(template: str, values: dict[str, Column], types: dict[str, str]) -> Column:
    """``text`` and exact ``spans (start, stop, type)`` of a template with ``{slots}``."""
    parts = re.split(r"(\{\w+\})", template)
    text, spans, at = [], [], F.lit(0)
    for part in parts:
        slot = part[1:-1] if re.fullmatch(r"\{\w+\}", part) else None
        piece = values[slot] if slot else F.lit(part)
        stop = at + F.length(piece)
        if slot in types:
            spans.append(F.struct(at.cast("int").alias("start"), stop.cast("int").alias("stop"), F.lit(types[slot]).alias("type")))
        text.append(piece)
        at = stop
    kind = "array<struct<start:int,stop:int,type:string>>"
    return F.struct(F.concat(*text).alias("text"), (F.array(*spans) if spans else F.array()).cast(kind).alias("spans"))


def tokens(text: Column) -> Column:
    """Words and single punctuation marks with their offsets."""
    from ..functions.spans import cut, find_all

    return F.transform(find_all(text, r"(?U)\w+|[^\w\s]"), lambda s: F.struct(cut(text, s).alias("token"), s["start"].alias("start"), s["end"].alias("stop")))


def bio(token_array: Column, spans: Column) -> Column:
    """Tags of tokens: inside the first span that holds a token, ``B-`` at its start."""

    def tag(t: Column) -> Column:
        holds = F.filter(spans, lambda s: (t["start"] >= s["start"]) & (t["stop"] <= s["stop"]))
        first = F.get(holds, F.lit(0))
        name = F.concat(F.when(t["start"] == first["start"], F.lit("B-")).otherwise(F.lit("I-")), first["type"])
        return F.struct(t["token"].alias("token"), F.coalesce(name, F.lit("O")).alias("tag"))

    return F.transform(token_array, tag)


def split_exact(df: DataFrame, shares: dict[str, float], key: str, seed: int = 42) -> DataFrame:
    """Add ``split`` with exact sizes: rows in the order of a seeded hash, cut at the shares.

    Positions come from counts of hash buckets, so no task sorts all rows; the
    last split takes what rounding leaves.
    """
    hashed = df.withColumn("_h", F.xxhash64(F.lit(seed), F.col(key))).withColumn("_b", F.pmod(F.shiftright("_h", 40), F.lit(4096)).cast("int"))
    counts = hashed.groupBy("_b").count()
    before = counts.select("_b", (F.sum("count").over(Window.orderBy("_b")) - F.col("count")).alias("_before"))  # 4096 rows
    total = counts.agg(F.sum("count").alias("_n"))  # one row
    place = F.row_number().over(Window.partitionBy("_b").orderBy("_h", key)) - 1
    placed = hashed.withColumn("_r", place).join(before, "_b").join(total).withColumn("_r", F.col("_r") + F.col("_before"))
    split, done = None, 0.0
    names = list(shares)
    for name in names[:-1]:
        done += shares[name]
        here = F.col("_r") < F.floor(F.round(F.col("_n") * done, 6))
        split = F.when(here, name) if split is None else split.when(here, name)
    last = F.lit(names[-1])
    return placed.withColumn("split", last if split is None else split.otherwise(last)).drop("_h", "_b", "_before", "_n", "_r")
