"""Readers and writers with fixed schemas, and the checks of what comes in."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Limits of requests and files.
MAX_TEXT, MAX_IDS, MAX_FILE_BYTES, MAX_PAGES = 50_000, 100, 20 * 1024 * 1024, 100
LABELLED = "text string, spans array<struct<start:int,stop:int,type:string>>"
ENTITY_CSV = "text string, entity_type string, entity_value string, start int, `end` int"
CONTACTS = "id int, account_id int, name string, email string, phone string, identifier string, additional_attributes string, custom_attributes string, last_activity_at timestamp_ntz, created_at timestamp_ntz, updated_at timestamp_ntz"
MESSAGES = "id int, conversation_id int, message_type int, content string, content_attributes string, sender_type string, created_at timestamp_ntz"
CONVERSATIONS = "id int, contact_id int, uuid string, display_id int, identifier string, additional_attributes string, custom_attributes string, created_at timestamp_ntz"


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """Labelled JSON lines; blank lines are passed over."""
    return spark.read.schema(LABELLED).json(path)


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ENTITY_CSV).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_jdbc(spark: SparkSession, url: str, dbtable: str, ids: list[int] | None = None, column: str = "id", **options: str) -> DataFrame:
    """A database table; a list of ids becomes a filter that the database evaluates."""
    if ids is not None and not 1 <= len(ids) <= MAX_IDS:
        raise ValueError(f"1 to {MAX_IDS} ids are allowed")
    df = spark.read.format("jdbc").options(url=url, dbtable=dbtable, **options).load()
    return df if ids is None else df.filter(F.col(column).isin(ids))


def check_text(text: Column) -> Column:
    """Why a request is rejected, or null."""
    return F.when(text.isNull() | (F.length(text) < 1), "empty").when(F.length(text) > MAX_TEXT, "too long")


def read_files(spark: SparkSession, path: str, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """``path, kind, length, content, rejected``: office documents, with the reason for each that is not taken."""
    files = spark.read.format("binaryFile").load(path)
    name = F.lower("path")
    kind = F.when(name.endswith(".docx"), "docx").when(name.endswith(".pdf"), "pdf")
    why = F.when(F.col("length") == 0, "empty").when(F.col("length") > max_bytes, "too large").when(F.col("kind").isNull(), "unsupported format")
    return files.select("path", kind.alias("kind"), "length", "content").withColumn("rejected", why)


def union_weighted(*parts: tuple[DataFrame, float]) -> DataFrame:
    """Datasets of equal columns in one, each row with the ``weight`` of its dataset."""
    weighed = [df.drop("weight").withColumn("weight", F.lit(float(w))) for df, w in parts]
    out = weighed[0]
    for df in weighed[1:]:
        out = out.unionByName(df)
    return out


def spread(df: DataFrame) -> DataFrame:
    """Deal out a table that has fewer partitions than the cluster has cores, as one file of one row group has.

    Worth its shuffle before costly expressions on a small table; large tables
    have more partitions and stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def even_tasks(df: DataFrame) -> int:
    """A number of tasks for costly work on narrow rows; given to ``repartition``, it is not lowered by the bytes of the shuffle."""
    spark = df.sparkSession
    return max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())


def dealt(df: DataFrame) -> DataFrame:
    """Deal rows out evenly, for narrow rows (keys) before costly expressions.

    A file is split by bytes but read by row groups, so one task may hold all
    rows of a table however many splits it has; their number tells nothing.
    """
    return df.repartition(even_tasks(df))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the folder of ``spark.checkpoint.dir``; only a local session may leave it unset and gets one of its own."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="veilwork-checkpoint-"))
    return df.checkpoint()


def write_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_labelled(df: DataFrame, path: str) -> None:
    df.select("text", "spans").write.json(path)


def write_corpus(df: DataFrame, path: str, text: str = "text") -> None:
    """One sentence a line."""
    df.select(F.regexp_replace(text, r"[\r\n]+", " ").alias("value")).write.text(path)


def audit(results: DataFrame, result: str = "result") -> DataFrame:
    """Counts and types only, never values: ``entity_type, n_entities, n_texts``."""
    numbered = results.select(F.monotonically_increasing_id().alias("row"), F.col(f"{result}.entities_found").alias("found"))
    each = numbered.select("row", F.explode_outer("found").alias("e")).filter(F.col("e").isNotNull())  # an inner explode would mask twice, once to filter
    return each.groupBy("e.entity_type").agg(F.count("*").alias("n_entities"), F.countDistinct("row").alias("n_texts"))


def audit_metrics(types: list[str], result: str = "result") -> list[Column]:
    """Metrics for ``observe``, counts and types only: texts, entities, and entities and texts of each type."""
    found = F.coalesce(F.col(f"{result}.entities_found"), F.array())
    of = lambda t: F.size(F.filter(found, lambda e: e["entity_type"] == t))
    each = [c for t in types for c in (F.sum(of(t)).alias(f"n_entities.{t}"), F.sum((of(t) > 0).cast("int")).alias(f"n_texts.{t}"))]
    return [F.count("*").alias("texts"), F.sum(F.size(found)).alias("entities"), *each]


def audited(results: DataFrame, types: list[str], result: str = "result") -> tuple[DataFrame, Observation]:
    """The same rows, and an observation that holds ``audit_metrics`` once an action has run over them: no second pass."""
    seen = Observation()
    return results.observe(seen, *audit_metrics(types, result)), seen
