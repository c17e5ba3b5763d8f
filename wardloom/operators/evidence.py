"""From evidence records to the specialties that a patient requires, under five strategies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardloom.functions.keys import BLANKS, id_key
from wardloom.session import small_side

#: The three sources; their number is the fixed denominator of confidence.
SOURCES = ("referral", "consult_note", "problem_list")
STRATEGIES = ("referral", "consult_note", "problem_list", "union", "intersection")
THRESHOLD, TOLERANCE = 1 / 3, 1e-12


def specialty_text_key(c: str | Column) -> Column:
    """Trimmed lower-case text with runs of blanks, ``_`` and ``-`` as one blank."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.lower(F.regexp_replace(c, f"^[{BLANKS}]+|[{BLANKS}]+$", "")), f"[{BLANKS}_-]+", " ")


def recognise(evidence: DataFrame, reference: DataFrame, fuzzy: float = 0.85) -> DataFrame:
    """``evidence`` with ``specialty`` and ``recognition``: 1.0 for a name of the list, ``fuzzy`` for an alias, else null and 0.

    ``reference`` has ``specialty`` and ``also_known``. A name wins over an alias; of two entries
    with the same text the first by name.
    """
    if not 0.8 <= fuzzy <= 1:
        raise ValueError("the recognition of an alias must lie between 0.8 and 1")
    names = reference.select(specialty_text_key("specialty").alias("_text"), "specialty").groupBy("_text").agg(F.min("specialty").alias("_exact"))
    aliases = reference.select(F.explode("also_known").alias("a"), "specialty").select(specialty_text_key("a").alias("_text"), "specialty")
    aliases = aliases.groupBy("_text").agg(F.min("specialty").alias("_alias"))
    out = evidence.withColumn("_text", specialty_text_key("specialty_text")).join(small_side(names), "_text", "left").join(small_side(aliases), "_text", "left")
    found = F.coalesce("_exact", "_alias")
    sure = F.when(F.col("_exact").isNotNull(), 1.0).when(F.col("_alias").isNotNull(), fuzzy).otherwise(0.0)
    return out.select(*evidence.columns, found.alias("specialty"), sure.alias("recognition"))


def evidence_index(recognised: DataFrame, least: float = 0.8) -> DataFrame:
    """Best recognition for each patient, specialty and source; unrecognised rows and rows without patient are left out."""
    return (
        recognised.withColumn("patient", id_key("patient"))
        .where((F.col("recognition") >= least) & F.col("patient").isNotNull())
        .groupBy("patient", "specialty", "evidence_source")
        .agg(F.max("recognition").alias("recognition"))
    )


def quarantine_counts(recognised: DataFrame, least: float = 0.8) -> DataFrame:
    """Rows and unrecognised rows of each source."""
    return recognised.groupBy("evidence_source").agg(F.count("*").alias("n_records"), F.count_if(F.col("recognition") < least).alias("n_unrecognised"))


def bounds_degenerate(recognised: DataFrame) -> DataFrame:
    """One row: how many of the three sources have any record, and whether union and intersection are thereby degenerate."""
    n = F.count_distinct(F.when(F.col("evidence_source").isin(*SOURCES), F.col("evidence_source")))
    return recognised.agg(n.alias("n_sources")).withColumn("bounds_degenerate", F.col("n_sources") < len(SOURCES))


def claims(index: DataFrame) -> DataFrame:
    """Every strategy's claims: ``patient, specialty, strategy, confidence``.

    A single-source strategy claims what that source holds, union what any, intersection what all
    three hold. Confidence is the sum of recognition over all three sources by three, whichever
    strategy claims it.
    """
    by = index.groupBy("patient", "specialty").agg(*(F.max(F.when(F.col("evidence_source") == s, F.col("recognition"))).alias(s) for s in SOURCES))
    total = sum((F.coalesce(F.col(s), F.lit(0.0)) for s in SOURCES[1:]), F.coalesce(F.col(SOURCES[0]), F.lit(0.0)))
    there = [F.col(s).isNotNull() for s in SOURCES]
    holds = [*there, there[0] | there[1] | there[2], there[0] & there[1] & there[2]]
    which = F.filter(F.array(*(F.when(h, F.lit(s)) for h, s in zip(holds, STRATEGIES))), lambda s: s.isNotNull())
    return by.select("patient", "specialty", F.explode(which).alias("strategy"), (total / float(len(SOURCES))).alias("confidence"))


def patient_grid(index: DataFrame, claimed: DataFrame) -> DataFrame:
    """All five strategies for every patient with any recognised record: number of claims, 0 where there are none."""
    patients = index.select("patient").distinct().select("patient", F.explode(F.array(*(F.lit(s) for s in STRATEGIES))).alias("strategy"))
    n = claimed.groupBy("patient", "strategy").agg(F.count("*").alias("n_claims"))
    return patients.join(n, ["patient", "strategy"], "left").withColumn("n_claims", F.coalesce("n_claims", F.lit(0)))


def selection(claimed: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Claims with ``included``: confidence at or above the threshold, up to a tolerance for thirds."""
    return claimed.withColumn("included", F.col("confidence") >= threshold - TOLERANCE)


def required_map(claimed: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``strategy, patient, required`` (sorted array of the included specialties)."""
    return (
        selection(claimed, threshold)
        .where("included")
        .groupBy("strategy", "patient")
        .agg(F.array_sort(F.collect_set("specialty")).alias("required"))
    )
