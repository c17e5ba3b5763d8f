"""Coverage of patients who need several specialties, by ward-day, with intervals and suppression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardloom.functions.draws import draw
from wardloom.operators.evidence import STRATEGIES
from wardloom.operators.geometry import ward_of
from wardloom.operators.moments import mdt_moments
from wardloom.operators.suppression import MIN_CLINICIANS, MIN_PATIENTS, above_floor
from wardloom.session import small_side

Z = 1.959963984540054
#: Counters kept apart for the patients of one drawn ward-day; none has as many.
STRIDE = 1_000_000
#: As many ward-days are broadcast to the draws; a row of some 60 bytes for each of their strategies.
BROADCAST_UNITS = 50_000


class InsufficientCoverage(ValueError):
    """Nobody to cover, too few ward-days or too few usable replicates."""


def wilson(k: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """Wilson interval of k of n, within 0 and 1; null where n is 0."""
    k, n = k.cast("double"), F.when(n > 0, n.cast("double"))
    p, z2 = k / n, z * z
    mid = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return F.greatest(F.lit(0.0), mid - half), F.least(F.lit(1.0), mid + half)


def coverage_units(eps: DataFrame, required: DataFrame, window_s: float = 300) -> DataFrame:
    """Counts of each ward-day and strategy: ``day, ward, strategy, n_patients, n_covered, n_observed, n_clinicians``.

    ``required`` has ``strategy, patient, required``. n_patients counts observed patients who need
    at least two specialties, n_covered those with a co-presence moment inside the ward-day;
    clinicians count also for episodes without patient. Every ward-day has a row for each strategy.
    """
    x = eps.withColumns({"day": F.to_date("start"), "ward": ward_of("bed")})
    cells = x.groupBy("day", "ward").agg(F.count_distinct("patient").alias("n_observed"), F.count_distinct("clinician").alias("n_clinicians"))
    multi = required.where(F.size("required") >= 2).select("strategy", "patient")
    seen = x.where("patient is not null").select("day", "ward", "patient").distinct().join(small_side(multi), "patient")
    hit = mdt_moments(x, required, window_s, ("day", "ward")).select("day", "ward", "strategy", "patient").distinct().withColumn("hit", F.lit(1))
    n = seen.join(hit, ["day", "ward", "strategy", "patient"], "left").groupBy("day", "ward", "strategy").agg(F.count("*").alias("n_patients"), F.count("hit").alias("n_covered"))
    grid = cells.withColumn("strategy", F.explode(F.array(*(F.lit(s) for s in STRATEGIES))))
    return grid.join(n, ["day", "ward", "strategy"], "left").fillna(0, ["n_patients", "n_covered"])


def coverage_cells(units: DataFrame, min_patients: int = MIN_PATIENTS, min_clinicians: int = MIN_CLINICIANS) -> DataFrame:
    """Ward-days with coverage and interval; those below the floor have no numbers, only ``suppressed``."""
    shown = above_floor(F.col("n_patients"), F.col("n_clinicians"), min_patients, min_clinicians)
    low, high = wilson(F.col("n_covered"), F.col("n_patients"))
    only = lambda c: F.when(shown, c)
    return units.select(
        "day", "ward", "strategy", (~shown).alias("suppressed"), only(F.col("n_patients")).alias("n_patients"), only(F.col("n_covered")).alias("n_covered"),
        only(F.col("n_covered") / F.col("n_patients")).alias("coverage"), only(low).alias("ci_low"), only(high).alias("ci_high"),
    )


def coverage_bootstrap(units: DataFrame, n_replicates: int = 1000, seed: int = 7) -> DataFrame:
    """``strategy, replicate, coverage``: ward-days, then patients within each, drawn with replacement.

    A patient drawn from a ward-day is covered if the draw falls below its number of covered ones.
    Units without patients can be drawn and add none; a replicate without patients has null coverage.

    Plan: each task draws whole replicates against the counted ward-days, broadcast, and adds them up, so
    that only sums travel; beyond ``BROADCAST_UNITS`` ward-days a merge join. The side of the draws must
    not be broadcast, though its size estimate, which knows nothing of the exploded rows, would allow it.
    """
    spark = units.sparkSession
    ids = units.select("day", "ward").distinct().withColumn("unit", F.row_number().over(Window.orderBy("day", "ward")) - 1)
    n = ids.count()
    if n < 2:
        raise InsufficientCoverage(f"{n} ward-days; at least two are needed")
    numbered = units.join(ids, ["day", "ward"]).select("strategy", "unit", "n_patients", "n_covered")
    numbered = F.broadcast(numbered) if n <= BROADCAST_UNITS else numbered.hint("merge")
    draws = spark.range(n_replicates).select(F.col("id").alias("replicate"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(n).cast("bigint"))).alias("k"))
    draws = draws.withColumn("unit", (draw(seed, F.col("replicate"), F.col("k")) % n).cast("int")).join(numbered, "unit")
    # Where all or none are covered the draws can't change it: one row stands for the patients.
    open_ = (F.col("n_covered") > 0) & (F.col("n_covered") < F.col("n_patients"))
    draws = draws.select("*", F.explode(F.sequence(F.lit(1), F.when(open_, F.col("n_patients").cast("int")).otherwise(1))).alias("p"))
    hit = draw(seed + 1, F.col("replicate"), F.col("k") * STRIDE + F.col("p")) % F.col("n_patients") < F.col("n_covered")
    draws = draws.select(
        "strategy", "replicate",
        F.when(open_, hit.cast("bigint")).when(F.col("n_covered") == 0, 0).otherwise(F.col("n_patients")).alias("hits"),
        F.when(open_, 1).otherwise(F.col("n_patients")).alias("patients"),
    )
    return draws.groupBy("strategy", "replicate").agg((F.sum("hits") / F.when(F.sum("patients") > 0, F.sum("patients"))).alias("coverage"))


def coverage_by_strategy(units: DataFrame, n_replicates: int = 1000, seed: int = 7) -> DataFrame:
    """One row a strategy: pooled coverage, and an interval that spans Wilson's and the bootstrap's.

    Suppressed ward-days still count in the pool. A strategy under which nobody needs two
    specialties, or with fewer than two usable replicates, has null figures and a reason.
    """
    pool = units.groupBy("strategy").agg(F.sum("n_patients").alias("n"), F.sum("n_covered").alias("k"), F.count("*").alias("n_ward_days"))
    boot = coverage_bootstrap(units, n_replicates, seed).where("coverage is not null").groupBy("strategy").agg(
        F.percentile("coverage", F.array(F.lit(0.025), F.lit(0.975))).alias("p"), F.count("*").alias("usable")
    )
    low, high = wilson(F.col("k"), F.col("n"))
    ok = (F.col("n") > 0) & (F.col("usable") >= 2)
    out = pool.join(boot, "strategy", "left")
    return out.select(
        "strategy", "n", "k", "n_ward_days", F.when(ok, F.col("k") / F.col("n")).alias("coverage"),
        F.when(ok, F.least(low, F.col("p")[0])).alias("ci_low"), F.when(ok, F.greatest(high, F.col("p")[1])).alias("ci_high"),
        F.when(F.col("n") == 0, "nobody needs two specialties").when(~ok, "too few replicates").alias("refused"),
    )
