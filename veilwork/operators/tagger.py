"""A token classifier for names: hashed features, weighted multinomial regression, Viterbi over B/I/O.

Features are column expressions over a token and its neighbours, the regression
is ``pyspark.ml`` with a weight for each row (silver texts count less), and the
decoder is one fold over a sentence's scores.  A trained model is a folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lets import let
from ..functions.spans import no_spans
from .generate import tokens

TAGS = ("O", "B", "I")
#: The score of a step that no sequence may take: inside after outside.
NEVER = -1e9


def shape(token: Column) -> Column:
    """Letters by case and digits, runs shortened: ``Xx``, ``X.``, ``d``."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(token, r"\p{Lu}", "X"), r"\p{Ll}", "x"), r"\p{Nd}", "d")
    return F.regexp_replace(plain, r"(.)\1+", "$1")


def token_features(found: Column) -> Column:
    """For each token of an array of ``(token, start, stop)``, an array of features of it and its neighbours."""

    def one(t: Column, i: Column) -> Column:
        near = lambda k, name: F.when(F.get(found, i + k).isNull(), F.lit(f"{name}=")).otherwise(F.concat(F.lit(f"{name}="), F.lower(F.get(found, i + k)["token"])))
        near_shape = lambda k, name: F.concat(F.lit(f"{name}="), F.coalesce(shape(F.get(found, i + k)["token"]), F.lit("")))
        low = F.lower(t["token"])
        ends = [F.concat(F.lit(f"s{n}="), F.substring(low, F.greatest(F.length(low) - n + 1, F.lit(1)), F.lit(n))) for n in (1, 2, 3, 4)]
        starts = [F.concat(F.lit(f"p{n}="), F.substring(low, F.lit(1), F.lit(n))) for n in (2, 3)]
        near_ends = [F.concat(F.lit(f"{name}2="), F.coalesce(F.substring(F.lower(F.get(found, i + k)["token"]), -2, 2), F.lit(""))) for k, name in ((-1, "l"), (1, "r"))]
        return F.array(F.concat(F.lit("w="), low), *ends, *starts, F.concat(F.lit("x="), shape(t["token"])), near(-1, "l"), near(1, "r"), near_shape(-1, "lx"), near_shape(1, "rx"), *near_ends)

    return F.transform(found, one)


def token_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, pos, start, stop, token, features`` of each token of each text."""
    found = df.select(F.col(key).alias("key"), tokens(F.col(text)).alias("t"))
    each = found.select("key", F.posexplode(F.arrays_zip("t", token_features(F.col("t")).alias("features"))).alias("pos", "x"))
    return each.select("key", "pos", "x.t.start", "x.t.stop", "x.t.token", "x.features")


def train(rows: DataFrame, features: int = 1 << 15, rounds: int = 60, penalty: float = 1e-4) -> PipelineModel:
    """Fit on rows with ``features`` (array), ``tag`` (``O``, ``B``, ``I``, any ``-TYPE`` behind it) and ``weight``."""
    label = F.array_position(F.array(*map(F.lit, TAGS)), F.substring("tag", 1, 1)) - 1
    given = rows.select("features", F.when(label < 0, 0).otherwise(label).cast("double").alias("label"), F.col("weight").cast("double").alias("weight"))
    hashed = HashingTF(inputCol="features", outputCol="hashed", numFeatures=features, binary=True)
    fit = LogisticRegression(featuresCol="hashed", labelCol="label", weightCol="weight", family="multinomial", maxIter=rounds, regParam=penalty)
    return Pipeline(stages=[hashed, fit]).fit(given)


def save(model: PipelineModel, folder: str) -> None:
    model.write().overwrite().save(folder)


def load(folder: str) -> PipelineModel:
    """A trained model by its folder, like ``spark.veilwork.person_model_dir``."""
    return PipelineModel.load(folder)


def viterbi(scores: Column, steps: Sequence[Sequence[float]] | None = None) -> Column:
    """The best tag numbers for an array of score arrays, one for each tag of ``TAGS``.

    ``steps[a][b]`` is added where tag ``b`` follows ``a``; without them, an
    inside tag only cannot begin a sentence or follow an outside one.  One fold
    keeps each tag's best score and where it came from, another reads the way
    back.  Ties go to the earlier tag; an empty array has no tags.
    """
    n = len(TAGS)
    step = steps or [[NEVER if (a, b) == (0, 2) else 0.0 for b in range(n)] for a in range(n)]
    state = "struct<best:array<double>,back:array<array<int>>>"

    def begin(row: Column) -> Column:
        return F.array(*[row[b].cast("double") + (NEVER if b == 2 else 0.0) for b in range(n)])

    def forward(acc: Column, row: Column) -> Column:
        def move(b: int) -> Column:
            options = F.array(*[acc["best"][a] + step[a][b] for a in range(n)])
            return let(options, lambda o: F.struct((F.array_max(o) + row[b].cast("double")).alias("v"), (F.array_position(o, F.array_max(o)) - 1).cast("int").alias("from")))

        def build(moves: Column) -> Column:
            return F.struct(F.transform(moves, lambda m: m["v"]).alias("best"), F.concat(acc["back"], F.array(F.transform(moves, lambda m: m["from"]))).alias("back")).cast(state)

        first = F.struct(begin(row).alias("best"), F.array().cast("array<array<int>>").alias("back")).cast(state)
        return F.when(F.size(acc["best"]) == 0, first).otherwise(let(F.array(*[move(b) for b in range(n)]), build))

    def way(acc: Column) -> Column:
        last = (F.array_position(acc["best"], F.array_max(acc["best"])) - 1).cast("int")
        path = F.aggregate(F.reverse(acc["back"]), F.array(last), lambda p, back: F.concat(F.array(back[p[0]]), p))
        return F.when(F.size(acc["best"]) == 0, F.array().cast("array<int>")).otherwise(path)

    empty = F.struct(F.array().cast("array<double>").alias("best"), F.array().cast("array<array<int>>").alias("back")).cast(state)
    return F.aggregate(scores, empty, forward, way)


def tag_rows(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """``key, tokens``: tokens in order with ``pos, start, stop, token, tag``, decoded by sentence."""
    score = F.transform(vector_to_array("probability"), lambda p: F.log(F.greatest(p, F.lit(1e-12))))
    scored = model.transform(rows).select("key", "pos", "start", "stop", "token", score.alias("score"))
    ordered = scored.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "start", "stop", "token", "score"))).alias("t"))
    best = viterbi(F.transform("t", lambda x: x["score"]))
    name = lambda i: F.element_at(F.array(*map(F.lit, TAGS)), i + 1)
    tagged = F.zip_with("t", "best", lambda t, b: F.struct(t["pos"].alias("pos"), t["start"].alias("start"), t["stop"].alias("stop"), t["token"].alias("token"), name(b).alias("tag")))
    return ordered.withColumn("best", best).select("key", tagged.alias("tokens"))


def name_spans(tagged: Column) -> Column:
    """``(start, end)`` of each run ``B I*`` of decoded tokens."""

    def step(acc: Column, t: Column) -> Column:
        new = F.struct(t["start"].alias("start"), t["stop"].alias("end"))
        last = F.element_at(acc, -1)
        longer = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), t["stop"].alias("end"))))
        return F.when(t["tag"] == "B", F.concat(acc, F.array(new))).when((t["tag"] == "I") & (F.size(acc) > 0), longer).otherwise(acc)

    return F.aggregate(tagged, no_spans(), step)


def find_names(model: PipelineModel, df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, spans`` of the names in each text, keys being unique; texts without tokens have none and do not come."""
    return tag_rows(model, token_rows(df, key, text)).select(F.col("key").alias(key), name_spans(F.col("tokens")).alias("spans"))
