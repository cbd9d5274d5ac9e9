"""The ``opN_<name>`` queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import spread
from . import chat, fim, mixing, phrases, secrets, topk, urls
from .bpe import count_tokens
from .chat import preference_rows
from .cotrain import decisions
from .fim import fill_in_middle
from .media import store_texts
from .mixing import mix_sources
from .near_dup import near_duplicates
from .packing import pack_documents
from .phrases import collocations
from .quality_rules import quality_rules
from .secrets import secret_columns
from .shared import table
from .topk import top_k
from .urls import filter_urls, rule_table

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents for work in Python; one small file is dealt out to all cores first."""
    return spread(table(spark, sf_dir, "documents"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions(documents(spark, sf_dir), table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), vocabulary())


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir), vocabulary())


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), percent=80, shingle=4)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_columns(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), rule_table(spark))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_texts(documents(spark, sf_dir))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))


def op10_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference_rows(table(spark, sf_dir, "conversations"))


def op11_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spread(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle(documents(spark, sf_dir)).drop("output")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


QUERIES = (op1_quality_classifier, op2_packing, op3_token_counts, op4_near_duplicates, op5_mixing, op6_secrets, op7_url_filter, op8_media, op9_quality_rules, op10_preferences, op11_top_k, op12_fill_in_middle, op13_collocations)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op5_mixing": mixing.ORACLE_SQL, "op6_secrets": secrets.oracle_sql(), "op7_url_filter": urls.ORACLE_SQL, "op10_preferences": chat.ORACLE_SQL, "op11_top_k": topk.ORACLE_SQL, "op12_fill_in_middle": fim.ORACLE_SQL, "op13_collocations": phrases.ORACLE_SQL}
