"""Matching records of two tables by nearest time for the same entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardloom.functions.keys import id_key, name_key
from wardloom.operators.ordered import micros


def match_nearest(
    left: DataFrame,
    right: DataFrame,
    left_keys: list[Column],
    right_keys: list[Column],
    left_id: str,
    left_ts: str,
    right_id: str,
    right_ts: str,
    tolerance_s: float = 120,
    shard_s: float = 1800,
) -> DataFrame:
    """The nearest right record in time for each left record of the same entity, within tolerance.

    Returns ``left_id, right_id, lag_s`` (right time less left time), one row for each left row
    that has a match. At equal distance the earlier right record is taken, at the same instant
    the smaller id. A distance of exactly the tolerance matches.

    Rows with a null in a key, time or id have no match and are none. Repeated left rows each
    come out; repeated right rows change nothing. Empty tables give no rows. Only the named
    columns are read, so extra columns with the same names on both sides don't matter.

    Both tables are united and sorted by entity and time; the last right record before each left
    row is carried forward, the next one backward, and the nearer is kept. Entities are sharded
    by time (``shard_s``), right rows within the tolerance of a shard's border going to both
    shards, so a hot entity's work is spread over its time shards; one exchange, no join.
    """
    tol = round(tolerance_s * 1_000_000)
    # A right row goes to one neighbouring shard at most, so shards are wider than both borders' zones.
    width = max(round(shard_s * 1_000_000), 2 * tol + 1)
    keys = [f"k{i}" for i in range(len(left_keys))]
    known = " and ".join(f"{k} is not null" for k in (*keys, "t", "id"))
    a = left.select(*(c.alias(k) for c, k in zip(left_keys, keys)), micros(left_ts).alias("t"), F.col(left_id).cast("bigint").alias("id")).where(known)
    b = right.select(*(c.alias(k) for c, k in zip(right_keys, keys)), micros(right_ts).alias("t"), F.col(right_id).cast("bigint").alias("id")).where(known)
    shard = F.floor((F.col("t")) / F.lit(width)).cast("bigint")
    into = F.pmod(F.col("t"), F.lit(width))
    a = a.select(*keys, "t", "id", shard.alias("shard"), F.lit(1).alias("side"))
    b = b.select(
        *keys,
        "t",
        "id",
        F.explode(
            F.when(into <= tol, F.array(shard, shard - 1)).when(into >= width - tol, F.array(shard, shard + 1)).otherwise(F.array(shard))
        ).alias("shard"),
        F.lit(0).alias("side"),
    )
    by = Window.partitionBy(*keys, "shard")
    seen = F.when(F.col("side") == 0, F.struct("t", "id"))
    # Right rows come before left ones of the same instant, larger ids first, so that the last
    # one carried is the smallest id of the latest instant; likewise backward in time.
    forward = by.orderBy(F.col("t").asc(), F.col("side").asc(), F.col("id").desc()).rowsBetween(Window.unboundedPreceding, 0)
    backward = by.orderBy(F.col("t").desc(), F.col("side").asc(), F.col("id").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rows = a.unionByName(b).withColumn("last", F.last(seen, ignorenulls=True).over(forward))
    rows = rows.withColumn("next", F.last(seen, ignorenulls=True).over(backward)).where("side = 1")
    back, ahead = F.col("t") - F.col("last.t"), F.col("next.t") - F.col("t")
    pick = F.when(F.col("last").isNotNull() & (F.col("next").isNull() | (back <= ahead)), F.col("last")).otherwise(F.col("next"))
    return (
        rows.withColumn("hit", pick)
        .where(F.abs(F.col("hit.t") - F.col("t")) <= tol)
        .select(F.col("id").alias("left_id"), F.col("hit.id").alias("right_id"), ((F.col("hit.t") - F.col("t")) / 1_000_000).alias("lag_s"))
    )


def place_keys(subject: str = "subject", location: str = "location") -> list[Column]:
    """Entity of an event: its subject and its place."""
    return [id_key(subject), name_key(location)]
