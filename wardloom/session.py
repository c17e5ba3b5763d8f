"""Session helpers: reading tables, cutting lineage, checking a broadcast side."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the directory ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Only where
    nothing is set, as in tests on one machine, a temporary folder is used.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share, set where it isn't yet.

    Refuses a cluster that names none, as a folder of this machine would be another one on each
    executor; only a local master gets a temporary folder.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir isn't set: name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="wardloom-checkpoint-"))
    return sc.getCheckpointDir()


def bounded_rows(df: DataFrame, limit: int, what: str) -> list:
    """Rows of a reference table on the driver; refuses one of more than ``limit`` rows.

    For lists that are fixed by nature (a canonical list, a roster of mix targets). At most
    ``limit + 1`` rows travel before the refusal.
    """
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what} has more than {limit} rows; raise the limit or process it in blocks")
    return rows


def small_side(df: DataFrame, limit_bytes: int = 8 << 20) -> DataFrame:
    """``df`` marked for broadcast if the optimiser's own size estimate is within ``limit_bytes``.

    Beyond it the plain DataFrame comes back and the join shuffles; adaptive execution may
    still broadcast it by its measured size.
    """
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return F.broadcast(df) if int(str(size)) <= limit_bytes else df


def local_table(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A small table made on the driver, with its true size known to the optimiser."""
    schema = StructType.fromDDL(ddl)
    arrow = to_arrow_schema(schema)
    columns = list(zip(*rows)) if rows else [[]] * len(schema)
    return spark.createDataFrame(pa.table([pa.array(list(c), f.type) for c, f in zip(columns, arrow)], schema=arrow), schema)


def fits(df: DataFrame, limit_bytes: int) -> bool:
    """Whether the optimiser's size estimate of ``df`` is within ``limit_bytes``."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= limit_bytes


Query = Callable[[SparkSession, str], DataFrame]
