"""Settings as Spark configuration under ``spark.veilwork.``, with defaults."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

from .tables import MAX_FILE_BYTES, MAX_PAGES

PREFIX = "spark.veilwork."


@dataclass(frozen=True)
class Settings:
    """What a deployment sets; an empty text turns a check off."""

    database_url: str = ""
    api_key: str = ""
    webhook_secret: str = ""
    webhook_enabled: bool = False
    person_model_dir: str = ""
    allow_no_person: bool = False
    document_enabled: bool = False
    document_max_bytes: int = MAX_FILE_BYTES
    document_max_pages: int = MAX_PAGES
    document_dpi: int = 150


def settings(spark: SparkSession) -> Settings:
    """The settings of a session; those it does not name keep their defaults."""
    kinds = {"bool": lambda v: v.strip().lower() in ("1", "true", "yes", "on"), "int": int, "str": str}
    given = {f.name: spark.conf.get(PREFIX + f.name, None) for f in fields(Settings)}
    found = Settings(**{f.name: kinds[f.type](given[f.name]) for f in fields(Settings) if given[f.name] is not None})
    if found.webhook_enabled and not found.database_url:
        raise ValueError(f"set {PREFIX}database_url, or turn {PREFIX}webhook_enabled off")
    return found
