"""Neighbour access and running counts over ordered entities without one task for each entity.

An entity's rows are sharded by blocks of its order column (hours of time, thousands of sequence
numbers): one exchange by (entity, block). Windows run inside a block; what crosses a block's
border comes from a table with one row for each block, made from the same exchange (it is reused,
so the input is read once) and joined on the exchange's own keys. A hot entity is thus worked on
by as many tasks as it has blocks, and only its block table, bounded by its span and not by its
rows, meets in one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_B = "_block"


def _keys(entity: list[str]) -> list[str]:
    return [f"_k{i}" for i in range(len(entity))]


def time_block(us: str | Column, seconds: float = 3600) -> Column:
    """Block number of a column of microseconds."""
    return F.floor((F.col(us) if isinstance(us, str) else us) / F.lit(round(seconds * 1_000_000))).cast("bigint")


def number_block(c: str, width: int = 100_000) -> Column:
    """Block number of a whole-number column."""
    return F.floor(F.col(c) / F.lit(width)).cast("bigint")


def shard(df: DataFrame, entity: list[str], block: Column) -> DataFrame:
    """``df`` distributed by (entity, block), with both as internal columns. Null entities group together."""
    made = {k: F.coalesce(F.col(e).cast("string"), F.lit("\0")) for k, e in zip(_keys(entity), entity)}
    return df.withColumns({**made, _B: block}).repartition(*_keys(entity), _B)


def unshard(df: DataFrame, entity: list[str]) -> DataFrame:
    return df.drop(*_keys(entity), _B)


def with_neighbour(x: DataFrame, entity: list[str], order: list[str], take: dict[str, str], back: bool = True) -> DataFrame:
    """A sharded frame with columns of the row before (``back``) or after; ``take`` maps new to old names. Null where there is none."""
    keys = [*_keys(entity), _B]
    w = Window.partitionBy(*keys).orderBy(*order)
    # Whole rows are packed, so that both branches want the same columns of the exchange.
    row = F.struct(*x.columns)
    edges = x.groupBy(*keys).agg((F.max_by if back else F.min_by)(row, F.struct(*order)).alias("_edge"))
    by_block = Window.partitionBy(*keys[:-1]).orderBy(_B)
    edges = edges.select(*keys, (F.lag if back else F.lead)("_edge").over(by_block).alias("_edge"))
    inner = (F.lag if back else F.lead)(F.struct(F.lit(1).alias("_some"), *(F.col(o).alias(n) for n, o in take.items()))).over(w)
    out = x.withColumn("_inner", inner).join(edges, keys, "left")
    return out.select(*x.columns, *(F.when(F.col("_inner").isNotNull(), F.col(f"_inner.{n}")).otherwise(F.col(f"_edge.{o}")).alias(n) for n, o in take.items()))


def with_running_count(x: DataFrame, entity: list[str], order: list[str], flag: Column, name: str) -> DataFrame:
    """A sharded frame with the running count of rows for which ``flag`` holds, from the entity's first row on."""
    keys, cols = [*_keys(entity), _B], x.columns
    x = x.withColumn("_one", F.when(flag, 1).otherwise(0).cast("bigint"))
    totals = x.groupBy(*keys).agg(F.sum("_one").alias("_total"))
    before = Window.partitionBy(*keys[:-1]).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return x.withColumn("_local", F.sum("_one").over(w)).join(totals, keys).select(*cols, (F.col("_local") + F.col("_base")).alias(name))


def neighbour(df: DataFrame, entity: list[str], order: list[str], block: Column, take: dict[str, str], back: bool = True) -> DataFrame:
    """``df`` with columns of the row before or after in the entity's order; ``block`` must not decrease along ``order``."""
    return unshard(with_neighbour(shard(df, entity, block), entity, order, take, back), entity)


def running_count(df: DataFrame, entity: list[str], order: list[str], block: Column, flag: Column, name: str) -> DataFrame:
    """``df`` with the running count of rows for which ``flag`` holds."""
    return unshard(with_running_count(shard(df, entity, block), entity, order, flag, name), entity)
