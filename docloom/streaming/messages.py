"""Messages delivered at least once: exactly one delivery of each stays.

A streaming query keeps the identifiers it has seen in Spark's keyed state store (RocksDB, off the heap) and lets one
delivery of each through, into a ledger. Store, offsets and ledger are committed together: a query that is started again
with the same ledger and checkpoint goes on where it stopped. An identifier is forgotten when the watermark has passed it by
the retention. Deliveries that are not in the ledger (repeated, or behind the watermark) are looked up in it by message:
one aggregate over ledger and absent deliveries tells which copy is the earliest.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.identity import sequencer_value, uri_of_version_pk
from docloom.io import blank_to_null, materialize, new_path, rocksdb_state, stream_source

_LAST = 9_223_372_036_854_775_807
_ROW = "delivery_id long, message string, received_us long, event_time timestamp"
_LEDGER = "message string, received_us long, delivery_id long"
#: How long an identifier is kept behind the watermark.
RETENTION = "60 days"


def message_rows(jobs: DataFrame) -> DataFrame:
    """Deliveries as (delivery_id, message, received_us, event_time).

    message stands for version_pk, operation, sequencer by value and trace_id; a null or blank trace_id stands for the
    address of the version. Nulls equal nulls. A delivery without received_at counts as received after all others.
    Rows without a delivery_id cannot be named and are left out.
    """
    mark = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("~"))
    parts = (
        F.col("version_pk"),
        F.upper(blank_to_null(F.col("operation"))),
        sequencer_value(F.col("sequencer")),
        F.coalesce(blank_to_null(F.col("trace_id")), uri_of_version_pk(F.col("version_pk"))),
    )
    return jobs.select(
        "delivery_id",
        F.sha1(F.concat_ws("\x01", *[mark(p) for p in parts])).alias("message"),
        F.coalesce(F.unix_micros(F.col("received_at").cast("timestamp")), F.lit(_LAST)).alias("received_us"),
        F.coalesce(F.col("received_at").cast("timestamp"), F.timestamp_seconds(F.lit(0))).alias("event_time"),
    ).where("delivery_id is not null")


def _first_of_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The earliest row of each message in a batch: a hot message costs the shuffle a row a batch."""
    for pdf in batches:
        yield pdf.sort_values(["received_us", "delivery_id"], kind="stable").drop_duplicates("message")


def ledger_of_stream(spark: SparkSession, path: str, retention: str = RETENTION, files_per_batch: int = 64, ledger: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Run the stateful query over all that is new at path and return its ledger, (message, received_us, delivery_id).

    ledger, checkpoint: folders of an earlier call to go on from; without them both are new. files_per_batch: files of
    a micro-batch.
    """
    folder, options = stream_source(spark, path)
    source = spark.readStream.schema(spark.read.parquet(path).schema).options(**options).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    rows = message_rows(source).mapInPandas(_first_of_batch, _ROW)
    seen = rows.withWatermark("event_time", retention).dropDuplicatesWithinWatermark(["message"]).select("message", "received_us", "delivery_id")
    out = ledger or new_path(spark, "ledger")
    with rocksdb_state(spark):
        query = (
            seen.writeStream.format("parquet").outputMode("append")
            .option("path", out).option("checkpointLocation", checkpoint or new_path(spark, "ledger-checkpoint"))
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
    return spark.read.schema(_LEDGER).parquet(out)


def settle_late(jobs: DataFrame, ledger: DataFrame) -> DataFrame:
    """Deliveries to drop, (delivery_id): those that are absent from the ledger, but for the earliest of their message.

    Ledger rows that an absent delivery precedes, or that came through again after their message was forgotten, are
    dropped in turn. Identifiers alone are compared to find what is absent; the aggregate takes partial minima, so a
    message with a third of all deliveries sends one row a task.
    """
    first = ledger.select("message", "received_us", "delivery_id", F.lit(True).alias("through"))
    missing = message_rows(jobs.join(ledger.select("delivery_id"), "delivery_id", "left_anti")).select("message", "received_us", "delivery_id", F.lit(False).alias("through"))
    absent = materialize(missing, "absent-deliveries")
    best = F.min(F.struct("received_us", "delivery_id", "through"))
    # as many ledger rows a message as it was forgotten times, and one
    let = F.collect_list(F.when(F.col("through"), F.col("delivery_id")))
    settled = first.unionByName(absent).groupBy("message").agg(best.alias("best"), let.alias("let"))
    kept = settled.where("not best.through").select("best.delivery_id")
    beaten = settled.select("best", F.explode("let").alias("delivery_id")).where("delivery_id <> best.delivery_id").select("delivery_id")
    return absent.select("delivery_id").join(kept, "delivery_id", "left_anti").unionByName(beaten).distinct()


def repeated_deliveries(spark: SparkSession, path: str, **options) -> DataFrame:
    """The deliveries of the table at path that repeat an earlier one. Empty tables give no rows. options: of ledger_of_stream."""
    return settle_late(spark.read.parquet(path), ledger_of_stream(spark, path, **options))
