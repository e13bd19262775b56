"""Profiles of new users, from a stream of their events.

A profile is a fold that does not depend on the order of events and that repeats change nothing: the
first event makes it, the last one dates it.  So batch, stream and replay give the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Fixed value: the role of a new user, which only a service may change.
ROLE = "USER"


def fold(events: DataFrame) -> DataFrame:
    """(user_id, first, last) of events (user_id, ts, event_id, event_type): the first event and the time of the last."""
    event = F.struct(F.col("ts").alias("at"), "event_id", "event_type")
    return events.where("user_id is not null").groupBy("user_id").agg(F.min(event).alias("first"), F.max("ts").alias("last"))


def profiles(folds: DataFrame) -> DataFrame:
    """(user_id, role, created_at, first_event, updated_at) from any number of folds of each user."""
    one = folds.groupBy("user_id").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return one.select("user_id", F.lit(ROLE).alias("role"), F.col("first.at").alias("created_at"), F.col("first.event_type").alias("first_event"), F.col("last").alias("updated_at"))


def start(events: DataFrame, root: str, **trigger) -> StreamingQuery:
    """Folds a stream of events into state by user and appends what a batch changed to the folder
    `root`; a batch that is written twice changes nothing."""

    def store(changed: DataFrame, batch_id: int) -> None:
        changed.write.mode("append").parquet(f"{root}/folds")

    out = fold(events).writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", f"{root}/checkpoint")
    return out.trigger(**(trigger or {"processingTime": "10 seconds"})).start()


def stored(spark: SparkSession, root: str) -> DataFrame:
    """The profiles that the stream has made so far."""
    return profiles(spark.read.parquet(f"{root}/folds"))
