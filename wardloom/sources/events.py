"""Event sources: CSV with a fixed schema, XES documents, corpus files, session usage logs."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardloom.functions.keys import kind_key

CSV_SCHEMA = "timestamp string, subject_kind string, subject string, activity string, location string, source string, confidence string"
#: Kinds of subject.
KINDS = ("clinician", "patient")
#: Weights of token kinds in billable units, and the kinds' names in a usage record.
BILLABLE = {"input_tokens": 1.0, "cache_creation_input_tokens": 1.25, "cache_read_input_tokens": 0.1, "output_tokens": 5.0}


class CorpusSafety(ValueError):
    """A path under a protected directory."""


def read_events_csv(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Events of CSV files with a header, in file order: ``seq`` and the typed fields.

    An empty or missing confidence is 1.0. With ``strict`` a kind other than clinician or patient,
    or a timestamp that isn't one, stops the query with the value; else it becomes null. ``seq``
    increases along each file; files are numbered in the order Spark lists them.
    """
    raw = spark.read.schema(CSV_SCHEMA).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    kind = kind_key("subject_kind")
    ts = F.try_to_timestamp(F.regexp_replace("timestamp", "T", " ")).cast("timestamp_ntz")
    if strict:
        kind = F.when(kind.isin(*KINDS), kind).otherwise(F.raise_error(F.concat(F.lit("unknown subject kind: "), F.coalesce("subject_kind", F.lit("null")))))
        ts = F.when(ts.isNotNull(), ts).otherwise(F.raise_error(F.concat(F.lit("not a timestamp: "), F.coalesce("timestamp", F.lit("null")))).cast("timestamp_ntz"))
    else:
        kind = F.when(kind.isin(*KINDS), kind)
    confidence = F.coalesce(F.expr("try_cast(confidence as double)"), F.lit(1.0))
    return raw.select(
        F.monotonically_increasing_id().alias("seq"), ts.alias("event_ts"), kind.alias("subject_kind"), "subject", "activity", "location", "source", confidence.alias("confidence")
    )


def write_events_csv(events: DataFrame, path: str) -> None:
    """The same columns back as CSV with a header."""
    out = events.select(
        F.date_format("event_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), "subject_kind", "subject", "activity", "location", "source", F.col("confidence").cast("string").alias("confidence")
    )
    out.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_xes(spark: SparkSession, path: str) -> DataFrame:
    """Events of XES documents: ``case_id, seq, activity, event_ts, resource``; one row tag for each trace."""
    attr = "array<struct<_key:string,_value:string>>"
    schema = f"string {attr}, event array<struct<string:{attr},date:{attr}>>"
    x = spark.read.format("xml").option("rowTag", "trace").schema(schema).load(path)

    def named(c: F.Column, key: str) -> F.Column:
        return F.get(F.filter(c, lambda s: s["_key"] == key), F.lit(0))["_value"]

    e = x.select(named(F.col("string"), "concept:name").alias("case_id"), F.posexplode("event").alias("seq", "e"))
    stamp = F.to_timestamp(named(F.col("e.date"), "time:timestamp")).cast("timestamp_ntz")
    return e.select("case_id", "seq", named(F.col("e.string"), "concept:name").alias("activity"), stamp.alias("event_ts"), named(F.col("e.string"), "org:resource").alias("resource"))


def guard_path(path: str, protected: tuple[str, ...]) -> str:
    """``path`` if no part of it is a protected name."""
    bad = set(PurePosixPath(path).parts) & set(protected)
    if bad:
        raise CorpusSafety(f"{path} lies under a protected directory: {sorted(bad)}")
    return path


def read_corpus(spark: SparkSession, root: str, glob: str = "*", protected: tuple[str, ...] = ("data",)) -> DataFrame:
    """Whole text files below ``root``: ``path, text``; files under a protected directory are refused or left out."""
    guard_path(root, protected)
    df = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    df = df.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return df.where(~F.exists(F.split("path", "/"), lambda p: p.isin(*protected)))


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    """Token sums for each model of session logs (one JSON object a line; torn lines are skipped), with billable units."""
    fields = ",".join(f"{c}:bigint" for c in BILLABLE)
    x = spark.read.schema(f"message struct<model:string,usage:struct<{fields}>>").option("mode", "DROPMALFORMED").json(path)
    x = x.where("message.model is not null and message.usage is not null")
    sums = x.groupBy(F.col("message.model").alias("model")).agg(*(F.sum(F.coalesce(f"message.usage.{c}", F.lit(0))).alias(c) for c in BILLABLE))
    total = sum((F.col(c) * w for c, w in list(BILLABLE.items())[1:]), F.col("input_tokens") * 1.0)
    return sums.withColumn("billable", total)
