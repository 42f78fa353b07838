"""Signature rules and their fusion with an anomaly verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .records import BWD_PACKETS, DST_PORT, column_name, quoted

# Fixed values of the rule set.
BAD_PORTS = (21, 22, 23, 3389, 4444)
PACKET_LIMIT = 10000


def signature_rule(df: DataFrame) -> Column:
    """1 for a listed destination port or a backward packet count over the limit.

    A rule whose column the frame lacks is skipped; null and NaN never match
    (Spark orders NaN above every number, hence the guard).
    """
    hit = F.lit(False)
    port = column_name(df, DST_PORT)
    if port is not None:
        hit = hit | F.coalesce(quoted(port).isin(*BAD_PORTS), F.lit(False))
    packets = column_name(df, BWD_PACKETS)
    if packets is not None:
        count = quoted(packets).cast("double")
        hit = hit | F.coalesce((count > PACKET_LIMIT) & ~F.isnan(count), F.lit(False))
    return F.when(hit, 1).otherwise(0)


def fuse(signature: Column, anomaly: Column) -> Column:
    """A signature match decides; otherwise the anomaly verdict stands."""
    return F.when(signature == 1, F.lit(1)).otherwise(anomaly)
