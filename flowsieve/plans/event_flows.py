"""The flow table that the catalogue's queries run on, derived from `events`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.records import flow_view
from ..sources.flows import trim_headers

FEATURES = ("value", "k")


def event_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events under the header names of flow logs, blanks included.

    A user is a source address, the event type a destination, and the number
    in `props` gives port and bytes; errors are the attacks.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return trim_headers(
        events.select(
            F.col("event_id").alias("seq"),
            F.col("ts").cast("timestamp").alias("ts"),
            F.col("user_id").cast("string").alias("Source IP"),
            F.col("event_type").alias(" Destination IP"),
            (k % 10).alias("Total Length of Fwd Packets"),
            k.alias(" Destination Port"),
            F.floor(F.col("value") * 100).cast("bigint").alias(" Total Backward Packets"),
            F.when(F.col("event_type") == "error", 1).otherwise(0).alias("label"),
            F.col("value"),
            k.alias("k"),
        )
    )


def event_view(spark: SparkSession, sf_dir: str, keep=()) -> DataFrame:
    """seq, tenant, log_type and fp of the event flows."""
    return flow_view(event_flows(spark, sf_dir), keep=keep)
