"""The floor below which figures about people aren't reported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_PATIENTS, MIN_CLINICIANS = 5, 2


class SuppressionFloor(ValueError):
    """The cohort is too small, or can't be counted."""


def cohort(eps: DataFrame) -> DataFrame:
    """One row: distinct patients and clinicians, and episodes without patient."""
    return eps.agg(F.count_distinct("patient").alias("n_patients"), F.count_distinct("clinician").alias("n_clinicians"), F.count_if(F.col("patient").isNull()).alias("n_unjoined"))


def above_floor(patients: Column, clinicians: Column, min_patients: int = MIN_PATIENTS, min_clinicians: int = MIN_CLINICIANS) -> Column:
    return (patients >= min_patients) & (clinicians >= min_clinicians)


def enforce_floor(eps: DataFrame) -> tuple[int, int]:
    """Counts of the cohort; refuses one below the floor or with episodes that aren't joined to a patient."""
    r = cohort(eps).first()
    if r["n_unjoined"]:
        raise SuppressionFloor(f"{r['n_unjoined']} episodes have no patient; the cohort can't be verified")
    if r["n_patients"] < MIN_PATIENTS or r["n_clinicians"] < MIN_CLINICIANS:
        raise SuppressionFloor("fewer patients or clinicians than the floor")
    return r["n_patients"], r["n_clinicians"]
