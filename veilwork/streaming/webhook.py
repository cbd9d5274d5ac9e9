"""Webhook events: signature gate, permissive parsing, masking; stateless, for batch and stream alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.spans import no_spans
from ..operators.jsonmask import mask_json
from ..operators.mask import ENTITY, anonymize

FIELDS = ("event", "id", "content", "content_type", "message_type", "conversation", "sender", "account", "inbox")
BLOCK = 64


def hmac_sha256(secret: str, body: Column) -> Column:
    """HMAC-SHA256 of a binary column, as lower-case hexadecimal digits."""
    import hashlib

    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > BLOCK else key).ljust(BLOCK, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, body), 256))), 256)


def signed(events: DataFrame, secret: str | None, body: str = "value", signature: str = "signature") -> DataFrame:
    """Only events whose signature fits the raw body; all of them without a secret.

    Digests of both sides are compared, so time tells nothing of the signature.
    """
    if not secret:
        return events
    want = F.sha2(hmac_sha256(secret, F.col(body).cast("binary")).cast("binary"), 256)
    return events.filter(want == F.sha2(F.coalesce(F.lower(signature), F.lit("")).cast("binary"), 256))


def mask_events(events: DataFrame, body: str = "value") -> DataFrame:
    """Parse the JSON ``body`` and mask ``content`` and ``sender``; anything missing or malformed is null."""
    text = F.col(body).cast("string")
    parsed = events.withColumn("_v", F.try_parse_json(text))
    take = lambda name, kind="string": F.try_variant_get("_v", f"$.{name}", kind)
    sender = F.try_variant_get("_v", "$.sender", "variant")
    is_object = F.schema_of_variant(sender).startswith("OBJECT")
    conversation_id = F.try_variant_get("_v", "$.conversation.id", "int")
    done = parsed.select(
        *[c for c in events.columns if c != body],
        take("event").alias("event"),
        take("id", "long").alias("message_id"),
        conversation_id.alias("conversation_id"),
        anonymize(F.nullif(take("content"), F.lit(""))).alias("_c"),
        mask_json(F.when(is_object, F.to_json(sender))).alias("_s"),
    )
    entities = F.concat(*[F.coalesce(F.col(f"{c}.entities_found"), no_spans(ENTITY)) for c in ("_c", "_s")])
    return done.select(
        *[c for c in done.columns if not c.startswith("_")],
        F.col("_c.anonymized").alias("content"),
        F.col("_s.anonymized").alias("sender"),
        entities.alias("entities_found"),
        F.size(entities).alias("total_entities"),
    )


def event_key(body: Column) -> Column:
    """A digest of an event's raw body, never null: events that differ in anything differ in it."""
    return F.sha2(F.coalesce(body.cast("binary"), F.lit(b"")), 256)


def respond(events: DataFrame, handle: Callable[[DataFrame], None], checkpoint: str, ledger: str, secret: str | None = None) -> StreamingQuery:
    """Gate and mask a stream, write a response for each event to ``ledger`` and give each batch of them to ``handle``.

    No event is taken for another, equal ones included.  A batch that Spark
    tries again writes over its own folder ``batch=N``, so the ledger has each
    response once; ``handle`` gets a batch again only if the driver failed
    between its end and the mark that it is done.
    """
    masked = mask_events(signed(events, secret).withColumn("event_key", event_key(F.col("value"))))

    def answer(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        mark = spark._jvm.org.apache.hadoop.fs.Path(f"{ledger}/done/{n}")
        files = mark.getFileSystem(spark._jsc.hadoopConfiguration())
        if files.exists(mark):
            return
        batch.write.mode("overwrite").parquet(f"{ledger}/responses/batch={n}")
        handle(spark.read.schema(batch.schema).parquet(f"{ledger}/responses/batch={n}"))
        files.create(mark, True).close()

    return masked.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).outputMode("append").start()


def responses(spark: SparkSession, ledger: str) -> DataFrame:
    """All responses of a ledger, each event's once, with its ``batch``."""
    return spark.read.parquet(f"{ledger}/responses")


def stream(events: DataFrame, path: str, checkpoint: str, secret: str | None = None) -> StreamingQuery:
    """Gate, mask and append a stream of events as Parquet."""
    return mask_events(signed(events, secret)).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
