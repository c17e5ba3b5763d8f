"""Walked metres of rounds against what any walk over the same beds needs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardloom.functions.bounds import BOUND_LIMIT, BoundUnavailable, necessary
from wardloom.functions.draws import draw
from wardloom.operators.geometry import Layout, ward_of, with_cost
from wardloom.operators.suppression import enforce_floor
from wardloom.session import cut


class InsufficientEvidence(ValueError):
    """Too few ward-days, or a resampling distribution without spread."""


class LowerBoundViolation(ValueError):
    """A bound above what was walked."""


REPORT = "observed_m double, necessary_m double, attributable_m double, ci_low double, ci_high double, n_ward_days bigint, n_patients bigint, n_clinicians bigint, n_replicates int"


@dataclass(frozen=True)
class MotionParams:
    base_dwell_s: float = 120
    dwell_values: tuple[float, ...] = (60, 120, 180, 300)
    n_replicates: int = 500
    seed: int = 2026
    model_confidence: bool = True


def stops(eps: DataFrame) -> DataFrame:
    """Episodes as stops of a clinician's day: ``clinician, day, start, bed, dwell_s, confidence``."""
    return eps.select("clinician", F.to_date("start").alias("day"), "start", "bed", "dwell_s", "confidence", *[c for c in ("patient",) if c in eps.columns])


def modal_ward(eps: DataFrame) -> DataFrame:
    """Ward of the longest total dwell of each round; of equal ones the larger name."""
    by = stops(eps).groupBy("clinician", "day", ward_of("bed").alias("ward")).agg(F.sum("dwell_s").alias("dwell"))
    return by.groupBy("clinician", "day").agg(F.max_by("ward", F.struct(F.round("dwell", 6), "ward")).alias("ward"))


def observed(kept: DataFrame, cost: DataFrame, keys: list[str]) -> DataFrame:
    """Metres between consecutive beds of each round; a repeated bed costs nothing."""
    w = Window.partitionBy(*keys).orderBy("start", "bed")
    legs = with_cost(kept.withColumn("_next", F.lead("bed").over(w)), cost, "bed", "_next")
    return legs.groupBy(*keys).agg(F.coalesce(F.sum("metres"), F.lit(0.0)).alias("observed_m"))


def bed_sets(kept: DataFrame, keys: list[str]) -> DataFrame:
    return kept.groupBy(*keys).agg(F.array_sort(F.collect_set("bed")).alias("beds"))


def necessary_of_sets(sets: DataFrame, layout: Layout) -> DataFrame:
    """``beds, necessary_m, method`` of distinct bed sets; method ``none`` of sets that no bound covers is null metres."""
    names = layout.bed_names()
    at = {b: i for i, b in enumerate(names)}
    trees = [layout.quickest(b) for b in names]
    matrix = np.array([[t[b][1] for b in names] for t in trees])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for beds in pdf["beds"]:
                i = [at[b] for b in beds if b in at]
                rows.append((list(beds), *necessary(matrix[np.ix_(i, i)])) if len(i) <= BOUND_LIMIT else (list(beds), None, "unavailable"))
            yield pd.DataFrame(rows, columns=["beds", "necessary_m", "method"])

    return sets.select("beds").distinct().mapInPandas(run, "beds array<string>, necessary_m double, method string")


def round_motion(eps: DataFrame, layout: Layout, cost: DataFrame, min_dwell_s: float) -> DataFrame:
    """``clinician, day, ward, observed_m, necessary_m, method`` of rounds over stops of at least ``min_dwell_s``.

    A round without such stops has 0 of both. Equal bed sets are bounded once.
    """
    keys = ["clinician", "day"]
    kept = stops(eps).where(F.col("dwell_s") >= min_dwell_s)
    sets = bed_sets(kept, keys)
    need = sets.join(necessary_of_sets(sets, layout), "beds").select(*keys, "necessary_m", "method")
    out = modal_ward(eps).join(observed(kept, cost, keys), keys, "left").join(need, keys, "left")
    return out.select(*keys, "ward", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("observed_m",)), F.when(F.col("method").isNull(), 0.0).otherwise(F.col("necessary_m")).alias("necessary_m"), F.coalesce("method", F.lit("none")).alias("method"))


def unit_motion(eps: DataFrame, layout: Layout, cost: DataFrame, dwell_values: tuple[float, ...]) -> DataFrame:
    """Totals of every ward-day at every dwell threshold: ``day, ward, dwell_no, observed_m, necessary_m``."""
    out = None
    for i, v in enumerate(dwell_values):
        part = round_motion(eps, layout, cost, v).groupBy("day", "ward").agg(F.sum("observed_m").alias("observed_m"), F.sum("necessary_m").alias("necessary_m"))
        part = part.withColumn("dwell_no", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out


def _drawn(units: DataFrame, params: MotionParams) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Numbered ward-days ``day, ward, unit``, replicates with their dwell threshold, and the units drawn for each.

    Units are numbered by (day, ward). The table of draws, replicates times units, is made on the
    executors, so nothing is gathered. Draws are counter-based.
    """
    spark = units.sparkSession
    w = Window.orderBy("day", "ward")  # one row for each ward-day
    ids = units.select("day", "ward").distinct().withColumn("unit", F.row_number().over(w) - 1)
    n = ids.count()
    if n < 2:
        raise InsufficientEvidence(f"{n} ward-days; at least two are needed")
    reps = spark.range(params.n_replicates).select(F.col("id").alias("replicate"), (draw(params.seed, F.col("id")) % len(params.dwell_values)).cast("int").alias("dwell_no"))
    draws = reps.select("replicate", "dwell_no", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("k"))
    draws = draws.withColumn("unit", (draw(params.seed + 1, F.col("replicate"), F.col("k")) % n).cast("int"))
    return ids, reps, draws


def motion_bootstrap(units: DataFrame, params: MotionParams) -> DataFrame:
    """``replicate, observed_m, necessary_m``: a dwell threshold and ward-days drawn with replacement.

    Resamples fixed unit totals, so every stop counts as certain; ``motion_replicates`` also draws
    which stops are kept.
    """
    ids, _, draws = _drawn(units, params)
    numbered = units.join(ids, ["day", "ward"]).select("unit", "dwell_no", "observed_m", "necessary_m")
    return draws.join(numbered, ["unit", "dwell_no"]).groupBy("replicate").agg(F.sum("observed_m").alias("observed_m"), F.sum("necessary_m").alias("necessary_m"))


def _certain(params: MotionParams, stop: tuple[Column, Column, Column], confidence: Column, replicate: Column, k: Column) -> Column:
    """Whether a stop (clinician, start, bed) is kept in the k-th ward-day drawn for a replicate."""
    h = F.xxhash64(F.lit(params.seed + 2), *stop, replicate.cast("bigint"), k.cast("bigint"))
    return F.shiftrightunsigned(h, 11) / F.lit(float(1 << 53)) < confidence


def confidence_kept(eps: DataFrame, params: MotionParams, replicate: int, k: int = 1) -> DataFrame:
    """Stops kept in the k-th draw of one replicate when places are uncertain: each with the probability of its confidence."""
    return stops(eps).where(_certain(params, (F.col("clinician"), F.col("start"), F.col("bed")), F.col("confidence"), F.lit(replicate), F.lit(k)))


def metres_of_walks(walks: DataFrame, layout: Layout) -> DataFrame:
    """``beds, observed_m, necessary_m`` of distinct bed sequences in walking order; necessary metres are null where no bound covers the beds.

    Sequences over the same beds go to one task and are bounded once there.
    """
    names = layout.bed_names()
    at = {b: i for i, b in enumerate(names)}
    trees = [layout.quickest(b) for b in names]
    matrix = np.array([[t[b][1] for b in names] for t in trees])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            known: dict[tuple[int, ...], float | None] = {}
            rows = []
            for beds in pdf["beds"]:
                legs = [(at[a], at[b]) for a, b in pairwise(beds) if a in at and b in at]
                i = tuple(sorted({at[b] for b in beds if b in at}))
                if i not in known:
                    known[i] = necessary(matrix[np.ix_(i, i)])[0] if len(i) <= BOUND_LIMIT else None
                rows.append((list(beds), float(sum(matrix[x] for x in legs)), known[i]))
            yield pd.DataFrame(rows, columns=["beds", "observed_m", "necessary_m"])

    parts = 4 * walks.sparkSession.sparkContext.defaultParallelism  # bounds of long rounds take most of the time
    spread = walks.select("beds").distinct().withColumn("_set", F.array_sort(F.array_distinct("beds"))).repartition(parts, "_set").drop("_set")
    return spread.mapInPandas(run, "beds array<string>, observed_m double, necessary_m double")


def motion_replicates(eps: DataFrame, layout: Layout, cost: DataFrame, params: MotionParams) -> DataFrame:
    """``replicate, observed_m, necessary_m`` of the joint bootstrap.

    A replicate draws a dwell threshold, ward-days with replacement and, with ``model_confidence``,
    for every time a ward-day was drawn which of its stops are kept; metres are those of the kept
    stops. Necessary metres of a replicate with beds that no bound covers are null. Sums are exact
    decimals, so they don't depend on the order of rows.
    """
    if not params.model_confidence:
        return motion_bootstrap(cut(unit_motion(eps, layout, cost, params.dwell_values)), params)
    keys = ["clinician", "day"]
    modal = modal_ward(eps)
    ids, reps, draws = _drawn(modal, params)
    walked = stops(eps).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "bed", "dwell_s", "confidence"))).alias("stops"))
    rounds = walked.join(modal, keys).join(ids, ["day", "ward"]).select("unit", "clinician", "stops")
    least = F.element_at(F.array(*(F.lit(float(v)) for v in params.dwell_values)), F.col("dwell_no") + 1)
    kept = F.filter("stops", lambda s: (s["dwell_s"] >= least) & _certain(params, (F.col("clinician"), s["start"], s["bed"]), s["confidence"], F.col("replicate"), F.col("k")))
    walks = draws.join(rounds, "unit").select("replicate", F.transform(kept, lambda s: s["bed"]).alias("beds"))
    walks = cut(walks.where(F.size("beds") > 1).groupBy("replicate", "beds").agg(F.count("*").alias("n")))
    exact = lambda c: F.sum(F.col("n").cast("decimal(10,0)") * F.col(c).cast("decimal(20,9)")).cast("double")
    sums = walks.join(metres_of_walks(walks, layout), "beds").groupBy("replicate").agg(
        exact("observed_m").alias("observed_m"), F.when(F.count("*") == F.count("necessary_m"), exact("necessary_m")).alias("necessary_m"), F.lit(True).alias("walked")
    )
    none = F.col("walked").isNull()
    return reps.join(sums, "replicate", "left").select("replicate", *(F.when(none, 0.0).otherwise(F.col(c)).alias(c) for c in ("observed_m", "necessary_m")))


def motion_report(eps: DataFrame, layout: Layout, cost: DataFrame, params: MotionParams = MotionParams()) -> DataFrame:
    """One row: observed, necessary and attributable metres with a 95 % interval.

    Refuses a cohort below the floor or with unjoined episodes, fewer than two ward-days, a bed
    set that no bound covers, a bound above what was walked, and an interval without width.
    """
    n_patients, n_clinicians = enforce_floor(eps)
    base = round_motion(eps, layout, cost, params.base_dwell_s)
    point = base.agg(F.sum("observed_m").alias("o"), F.sum("necessary_m").alias("n"), F.count_if(F.col("method") == "unavailable").alias("u"), F.count_distinct("day", "ward").alias("k")).first()
    if point["u"]:
        raise BoundUnavailable(f"{point['u']} rounds visit more beds than any bound covers")
    if (point["k"] or 0) < 2:
        raise InsufficientEvidence("fewer than two ward-days")
    if point["n"] > point["o"] + 1e-6:
        raise LowerBoundViolation("the bound lies above what was walked")
    boot = motion_replicates(eps, layout, cost, params).withColumn("a", F.col("observed_m") - F.col("necessary_m"))
    got = boot.agg(F.percentile("a", F.array(F.lit(0.025), F.lit(0.975))).alias("p"), F.count_if(F.col("a").isNull()).alias("u")).first()
    if got["u"]:
        raise BoundUnavailable(f"{got['u']} replicates have a round with more beds than any bound covers")
    ci = got["p"]
    if not ci[0] < ci[1]:
        raise InsufficientEvidence("the resampling distribution has no spread")
    row = (point["o"], point["n"], point["o"] - point["n"], float(ci[0]), float(ci[1]), point["k"], n_patients, n_clinicians, params.n_replicates)
    return eps.sparkSession.createDataFrame([row], REPORT)
