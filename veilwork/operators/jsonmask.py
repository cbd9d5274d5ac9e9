"""Mask JSON: typed columns by walking the schema, free JSON by its string literals."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lets import let
from ..functions.spans import no_spans
from .mask import ENTITY, anonymize

#: A string literal of JSON with the colon that makes it a key; the quantifiers are possessive, so long values cost no stack.
LITERAL = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"(?:\s*+:)?+'

Masker = Callable[[Column], Column]


def mask_typed(value: Column, kind: T.DataType, mask: Masker = anonymize) -> Column:
    """The value with every string in it masked; names and map keys stay."""
    if isinstance(kind, T.StringType):
        return mask(value)["anonymized"]
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: mask_typed(x, kind.elementType, mask))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, v: mask_typed(v, kind.valueType, mask))
    if isinstance(kind, T.StructType):
        parts = [mask_typed(value[f.name], f.dataType, mask).alias(f.name) for f in kind]
        return F.when(value.isNotNull(), F.struct(*parts))
    return value


def plain(literal: Column) -> Column:
    """The string that a literal stands for."""
    return F.from_json(F.concat(F.lit("["), literal, F.lit("]")), "array<string>")[0]


def mask_json(json: Column, mask: Masker = anonymize) -> Column:
    """``anonymized`` and ``entities_found`` of a JSON text of any shape.

    Only string values are masked, each by itself, so numbering restarts; keys,
    numbers, booleans and null stay.  Entities come in the order of the text.
    Null stays null.  The text is read twice, for its literals and for what lies
    between, so time grows with its length.
    """

    def literal(x: Column) -> Column:
        def masked(r: Column) -> Column:
            coded = F.to_json(F.array(r["anonymized"]))
            hit = F.size(r["entities_found"]) > 0
            return F.struct(F.when(hit, F.substring(coded, F.lit(2), F.length(coded) - 2)).otherwise(x).alias("text"), F.when(hit, r["entities_found"]).otherwise(no_spans(ENTITY)).alias("found"))

        return F.when(x.endswith(":"), F.struct(x.alias("text"), no_spans(ENTITY).alias("found"))).otherwise(let(mask(plain(x)), masked))

    def build(text: Column) -> Callable[[Column], Column]:
        def result(done: Column) -> Column:
            after = F.concat(F.array(F.lit("")), F.transform(done, lambda d: d["text"]))
            whole = F.array_join(F.zip_with(F.split(text, LITERAL, -1), after, lambda gap, d: F.concat(d, gap)), "")
            return F.struct(whole.alias("anonymized"), F.flatten(F.transform(done, lambda d: d["found"])).alias("entities_found"))

        return result

    return F.when(json.isNotNull(), let(json, lambda t: let(F.transform(F.regexp_extract_all(t, F.lit(LITERAL), F.lit(0)), literal), build(t))))


def json_leaves(df: DataFrame, key: str, json: str, depth: int = 100) -> DataFrame:
    """``key, path, value``: the string values of a JSON column with their paths, by a recursive query.

    Steps are ``.name`` and ``[index]`` (from 0) after ``$``.  Each level of
    nesting explodes the containers of the one before; rows nested deeper than
    ``depth`` end the query.  Text that is no JSON, or null, has no leaves.
    """
    spark = df.sparkSession
    name = f"leaves_{uuid.uuid4().hex}"
    df.select(F.col(key).alias("key"), F.try_parse_json(F.col(json)).alias("v")).filter("v is not null").createOrReplaceTempView(name)
    found = spark.sql(f"""
      WITH RECURSIVE walk (key, path, v) MAX RECURSION LEVEL {depth} AS (
        SELECT key, '$', v FROM {name}
        UNION ALL
        SELECT w.key, concat(w.path, CASE WHEN e.key IS NULL THEN concat('[', CAST(e.pos AS STRING), ']') ELSE concat('.', e.key) END), e.value
        FROM walk w, LATERAL variant_explode(w.v) e)
      SELECT key, path, CAST(v AS STRING) AS value FROM walk WHERE schema_of_variant(v) = 'STRING' LIMIT ALL""")
    return found.withColumnRenamed("key", key)


def mask_columns(df: DataFrame, columns: list[str], mask: Masker = anonymize) -> DataFrame:
    """Replace typed columns by their masked form."""
    return df.withColumns({c: mask_typed(F.col(c), df.schema[c].dataType, mask) for c in columns})
