"""Assemble and mask conversations from contacts, conversations and messages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import no_spans
from ..sources.tables import dealt
from .jsonmask import mask_json
from .mask import ENTITY, anonymize


def _field(c: str) -> Column:
    """A masked text field; null and empty give null."""
    return anonymize(F.nullif(F.col(c), F.lit("")))


def _json(c: str) -> Column:
    return mask_json(F.nullif(F.col(c), F.lit("")))


def _each(columns: tuple[str, ...], mask: Callable[[Column], Column]) -> Column:
    """The results of several fields in one array, so that the plan holds the expression once."""
    return F.transform(F.array(*[F.nullif(F.col(c), F.lit("")) for c in columns]), lambda c: mask(c))


def _entities(*results: str) -> Column:
    return F.concat(*[F.coalesce(F.col(f"{r}.entities_found"), no_spans(ENTITY)) for r in results])


TEXTS, JSONS = ("name", "email", "phone"), ("additional_attributes", "custom_attributes")


def mask_contacts(contacts: DataFrame) -> DataFrame:
    """``contact_id, contact``: masked fields and the entities of name, e-mail, phone and both JSON columns, in that order."""
    done = contacts.select(F.col("id").alias("contact_id"), _each(TEXTS, anonymize).alias("r_text"), _each(JSONS, mask_json).alias("r_json"))
    done = done.select("contact_id", *[F.col(r)[i].alias(f"r_{c}") for r, names in (("r_text", TEXTS), ("r_json", JSONS)) for i, c in enumerate(names)])
    names = (*TEXTS, *JSONS)
    fields = [F.col(f"r_{c}.anonymized").alias(c) for c in names]
    return done.select("contact_id", F.struct(F.col("contact_id").alias("id"), *fields, _entities(*[f"r_{c}" for c in names]).alias("entities_found")).alias("contact"))


def mask_messages(messages: DataFrame) -> DataFrame:
    """One row a message: ``conversation_id, created_at, id, message``."""
    done = messages.select("conversation_id", "created_at", "id", "message_type", "sender_type", _field("content").alias("r_content"), _json("content_attributes").alias("r_attributes"))
    message = F.struct(
        "id",
        "message_type",
        "sender_type",
        F.col("r_content.anonymized").alias("content"),
        F.col("r_attributes.anonymized").alias("content_attributes"),
        _entities("r_content", "r_attributes").alias("entities_found"),
        "created_at",
    )
    return done.select("conversation_id", "created_at", "id", message.alias("message"))


def ordered_messages(messages: DataFrame) -> DataFrame:
    """``conversation_id, messages, n_entities``: by creation, nulls first, then by id."""
    key = F.struct(F.col("created_at").isNotNull().alias("known"), F.col("created_at").alias("at"), "id", "message")
    sorted_ = F.array_sort(F.collect_list(key))
    return messages.groupBy("conversation_id").agg(
        F.transform(sorted_, lambda m: m["message"]).alias("messages"), F.sum(F.size("message.entities_found")).alias("n_entities")
    )


def assemble(conversations: DataFrame, contacts: DataFrame, messages: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Masked conversations with their contact and messages, and ``total_entities_found``.

    ``ids`` (column ``id``) picks conversations; missing and repeated ids are
    passed over, and only their contacts are masked, dealt out anew, since the
    join before leaves them in few tasks.  Messages are masked before they are grouped, where their
    number does not matter to any task.
    """
    if ids is not None:
        conversations = conversations.join(ids.select("id").distinct(), "id", "left_semi")
        messages = messages.join(ids.select(F.col("id").alias("conversation_id")).distinct(), "conversation_id", "left_semi")
        contacts = contacts.join(conversations.select(F.col("contact_id").alias("id")).distinct(), "id", "left_semi")
    own = conversations.select("id", "contact_id", "uuid", "display_id", _field("identifier").alias("r_identifier"), _each(JSONS, mask_json).alias("r_json"))
    own = own.select("*", *[F.col("r_json")[i].alias(f"r_{c}") for i, c in enumerate(JSONS)]).drop("r_json")
    joined = own.join(mask_contacts(dealt(contacts)), "contact_id", "left").join(ordered_messages(mask_messages(messages)), F.col("id") == F.col("conversation_id"), "left")
    total = F.size(_entities("r_identifier", "r_additional_attributes", "r_custom_attributes")) + F.coalesce(F.size("contact.entities_found"), F.lit(0)) + F.coalesce(F.col("n_entities"), F.lit(0))
    return joined.select(
        "id",
        "uuid",
        "display_id",
        F.col("r_identifier.anonymized").alias("identifier"),
        F.col("r_additional_attributes.anonymized").alias("additional_attributes"),
        F.col("r_custom_attributes.anonymized").alias("custom_attributes"),
        "contact",
        F.coalesce("messages", F.array().cast(joined.schema["messages"].dataType)).alias("messages"),
        total.cast("long").alias("total_entities_found"),
    )


def batch_totals(ids: DataFrame, assembled: DataFrame) -> DataFrame:
    """``total`` ids as requested, repeats counted, ``processed`` conversations found and their entities."""
    asked = ids.agg(F.count("*").alias("total"))
    done = assembled.agg(F.count("*").alias("processed"), F.coalesce(F.sum("total_entities_found"), F.lit(0)).alias("total_entities"))
    return asked.join(done)  # one row each
