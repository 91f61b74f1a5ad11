"""Chat payloads and batch enrichment with a user-supplied function."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qaspark.operators.evaluate import add_outcomes
from qaspark.operators.lookups import null_safe_join
from qaspark.session import exists, materialize, release

DEFAULT_MODEL = "default"


def payloads(turns: DataFrame) -> DataFrame:
    """``conv_id, messages``: all turns of a conversation as ordered ``{role, content}`` messages.

    A payload is what one call of the user's function gets, so it is one cell however long the conversation;
    ``messages`` gives the same in long form. Every role is passed on.
    """
    gathered = turns.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m")
    )
    bare = F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return gathered.select("conv_id", bare.alias("messages"))


def messages(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, content``: one row per message, for conversations too long for one cell."""
    return turns.select("conv_id", "turn", "role", F.col("text").alias("content"))


def enrich(
    chats: DataFrame, function: Callable[[list[dict], str], str], model: str = DEFAULT_MODEL
) -> DataFrame:
    """Add ``reply`` and ``error`` by a function of messages and model name.

    A ``model`` column overrides the default per row. A failing row keeps its error text. The
    function is made available once per task and runs on Arrow batches.
    """
    return add_outcomes(_named(chats, model), _call(function), "reply string", ["messages", "model"])


def _named(chats: DataFrame, model: str) -> DataFrame:
    return chats.withColumn("model", F.coalesce("model", F.lit(model)) if "model" in chats.columns else F.lit(model))


def _call(function: Callable[[list[dict], str], str]) -> Callable[[dict], str]:
    return lambda row: function(row["messages"], row["model"])


def enrich_landed(
    chats: DataFrame, function: Callable[[list[dict], str], str], path: str, model: str = DEFAULT_MODEL, parts: int = 8
) -> DataFrame:
    """As ``enrich``, with replies kept in ``path``: only payloads without a good reply there are asked.

    A payload is told by the hash of its messages and model, so equal ones are asked once, and a later run over the
    same or more conversations retries failures only. Payloads are asked in ``parts``, each landed as a folder of its
    own when it is done: what a broken run has landed is not asked again.
    """
    spark = chats.sparkSession
    keyed = _named(chats, model).withColumn("payload", F.sha2(F.to_json(F.struct("messages", "model")), 256))
    asked = keyed.select("payload", "messages", "model").dropDuplicates(["payload"])
    before = _landed(spark, path)
    good = before.filter("error is null").select("payload").distinct()
    open_ = materialize(null_safe_join(asked, good, ["payload"], "left_anti"), "payloads")
    number = (before.agg(F.max("landing")).first()[0] or 0) + 1
    for part in range(parts):
        own = open_.filter(F.pmod(F.xxhash64("payload"), F.lit(parts)) == part)
        tried = add_outcomes(own, _call(function), "reply string", ["messages", "model"]).select("payload", "reply", "error")
        tried.write.mode("overwrite").parquet(f"{path}/landing={number + part}")
    release(open_)
    landed = _landed(spark, path).groupBy("payload").agg(
        F.max(F.when(F.col("error").isNull(), F.struct(F.lit(1).alias("good"), "reply"))).alias("g"),
        F.max(F.when(F.col("error").isNotNull(), F.struct("landing", "error"))).alias("b"))
    told = landed.select("payload", F.col("g.reply").alias("reply"), F.when(F.col("g").isNull(), F.col("b.error")).alias("error"))
    return null_safe_join(keyed, told, ["payload"], "left").drop("payload")


def _landed(spark: SparkSession, path: str) -> DataFrame:
    shape = "payload string, reply string, error string, landing bigint"
    return spark.read.schema(shape).parquet(path) if exists(spark, path) else spark.createDataFrame([], shape)
