"""The version of each object, kept up by a stream of events: late and repeated events are refused with a reason.

Each micro-batch is judged on Spark, in blocks of arrival, against one stored row an object. Rows and state are written
under the number of their batch, so a batch that is repeated after a failure writes the same over again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from docloom.io import exists, remove, scratch
from docloom.operators.events import judge_events

_OUT = "object string, version string, seq string, op string, reason string"
_STATE = "object string, top string, seen boolean"


def _judge(at: str):
    def judge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        # a null object is an object of its own
        log = batch.withColumn("object", F.coalesce(F.concat(F.lit("="), "object"), F.lit("~")))
        state = spark.read.schema(_STATE).parquet(f"{at}/state/{number - 1}") if number else spark.createDataFrame([], _STATE)
        with scratch(spark):
            met = state.join(log.select("object").distinct(), "object", "left_semi")
            judged = judge_events(log, met).select("object", "version", "seq", "op", "reason")
            judged.write.mode("overwrite").parquet(f"{at}/judged/batch={number}")
        rows = spark.read.schema(_OUT).parquet(f"{at}/judged/batch={number}")
        top = F.max(F.when(F.col("reason") != "delete_without_object", F.col("seq")))
        new = rows.groupBy("object").agg(top.alias("top"), F.bool_or(F.col("op") == "UPSERT").alias("seen"))
        state.unionByName(new).groupBy("object").agg(F.max("top").alias("top"), F.bool_or("seen").alias("seen")).write.mode("overwrite").parquet(f"{at}/state/{number}")
        remove(spark, f"{at}/state/{number - 2}")

    return judge


def judged_stream(log: DataFrame, at: str) -> DataStreamWriter:
    """The query that judges a streaming log (object, arrival, version, seq, op) and keeps rows, state and checkpoint in folder at.

    One small row an object, never expired: to forget an object would let old versions in again. Events are judged in
    order of arrival within a micro-batch, and after all those of earlier ones.
    """
    return log.writeStream.foreachBatch(_judge(at)).option("checkpointLocation", f"{at}/checkpoint")


def judged_rows(spark: SparkSession, at: str) -> DataFrame:
    """(object, version, seq, op, reason): all that the stream in folder at has judged."""
    if not exists(spark, f"{at}/judged"):
        return spark.createDataFrame([], _OUT)
    rows = spark.read.schema(_OUT).parquet(f"{at}/judged")
    object_ = F.when(F.startswith("object", F.lit("=")), F.substr("object", F.lit(2)))
    return rows.select(object_.alias("object"), "version", "seq", "op", "reason")
