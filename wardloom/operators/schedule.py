"""Visit schedules: routes, constraints as violation rows, objectives, dominance and fronts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardloom.operators.geometry import with_cost
from wardloom.operators.ordered import from_micros
from wardloom.session import small_side

#: Objectives and whether more is better.
SENSES = {"copresence": True, "motion_m": False, "disruption": False, "continuity": True, "makespan_s": False}
SLOT_S = 300
S = ["schedule_id"]


class ConstraintViolation(ValueError):
    pass


def visits(plan: DataFrame) -> DataFrame:
    """Visits with a start of 0 or more, a duration of 1 or more, a clinician and a patient; planned twice counts once."""
    x = plan.where((F.col("start_slot") >= 0) & (F.col("duration") >= 1) & F.col("clinician").isNotNull() & F.col("patient").isNotNull())
    x = x.select("schedule_id", "clinician", "patient", "start_slot", "duration").distinct()
    return x.withColumn("end_slot", F.col("start_slot") + F.col("duration"))


def occupied(v: DataFrame) -> DataFrame:
    """One row for each slot that a visit occupies."""
    return v.withColumn("slot", F.explode(F.sequence("start_slot", F.col("end_slot") - 1)))


def route_window() -> Window:
    return Window.partitionBy("schedule_id", "clinician").orderBy("start_slot", "patient", "duration")


def routes(v: DataFrame) -> DataFrame:
    """Visits with ``stop_no`` in their clinician's route and the next visit's patient and start."""
    w = route_window()
    return v.withColumns({"stop_no": F.row_number().over(w), "next_patient": F.lead("patient").over(w), "next_start": F.lead("start_slot").over(w)})


# Constraints: each returns the visits that break it.
def outside_availability(v: DataFrame, available: DataFrame) -> DataFrame:
    """Occupied slots in which the clinician isn't available; a clinician without any row in ``available`` is unconstrained."""
    known = available.select("clinician").distinct()
    x = occupied(v).join(small_side(known), "clinician", "left_semi").join(small_side(available.select("clinician", "slot")), ["clinician", "slot"], "left_anti")
    return x.select("schedule_id", "clinician", "patient", "start_slot", "slot")


def patient_off_ward(v: DataFrame, off: DataFrame) -> DataFrame:
    return occupied(v).join(small_side(off.select("patient", "slot").distinct()), ["patient", "slot"], "left_semi").select("schedule_id", "clinician", "patient", "start_slot", "slot")


def in_protected(v: DataFrame, protected: list[int]) -> DataFrame:
    """Visits that touch a protected slot (a soft constraint: a cost, not a refusal)."""
    touches = F.exists(F.array(*map(F.lit, protected)), lambda s: (s >= F.col("start_slot")) & (s < F.col("end_slot")))
    return v.where(touches).select("schedule_id", "clinician", "patient", "start_slot")


def acuity_steps_up(v: DataFrame, acuity: DataFrame) -> DataFrame:
    """Consecutive visits of a route that go to a higher acuity; pairs with an unknown one are skipped."""
    a = acuity.select("patient", "acuity")
    r = routes(v).join(small_side(a), "patient", "left")
    r = r.join(small_side(a.select(F.col("patient").alias("next_patient"), F.col("acuity").alias("next_acuity"))), "next_patient", "left")
    return r.where(F.col("next_acuity") > F.col("acuity")).select("schedule_id", "clinician", "patient", "start_slot", "next_patient")


def isolation_not_last(v: DataFrame, isolated: DataFrame) -> DataFrame:
    """Visits to a patient who isn't isolated, after one to a patient who is."""
    x = v.join(small_side(isolated.select("patient").distinct().withColumn("iso", F.lit(1))), "patient", "left").fillna(0, ["iso"])
    x = x.withColumn("before", F.max("iso").over(route_window().rowsBetween(Window.unboundedPreceding, -1)))
    return x.where((F.col("iso") == 0) & (F.col("before") == 1)).select("schedule_id", "clinician", "patient", "start_slot")


def double_bookings(v: DataFrame) -> DataFrame:
    return routes(v).where(F.col("next_start") < F.col("end_slot")).select("schedule_id", "clinician", "patient", "start_slot", "next_patient", "next_start")


def travel_slots(seconds: Column, slot_s: int = SLOT_S) -> Column:
    """Whole slots a walk takes; an unknown way takes none."""
    return F.coalesce(F.ceil(seconds / slot_s), F.lit(0))


def travel_too_short(v: DataFrame, beds: DataFrame, cost: DataFrame) -> DataFrame:
    """Consecutive visits of a route with less time between than the walk takes."""
    r = _legs(v, beds, cost)
    late = F.col("next_start") < F.col("end_slot") + travel_slots(F.col("seconds"))
    return r.where(late).select("schedule_id", "clinician", "patient", "start_slot", "next_patient", "next_start")


def hard_violations(parts: dict[str, DataFrame]) -> DataFrame:
    """All violations as ``kind, schedule_id, clinician, patient, start_slot``."""
    out = None
    for kind, df in parts.items():
        x = df.select(F.lit(kind).alias("kind"), "schedule_id", "clinician", "patient", "start_slot")
        out = x if out is None else out.unionByName(x)
    return out


def validate(parts: dict[str, DataFrame]) -> None:
    bad = hard_violations(parts).limit(1).collect()
    if bad:
        raise ConstraintViolation(f"{bad[0]['kind']} in schedule {bad[0]['schedule_id']}")


# Objectives.
def _legs(v: DataFrame, beds: DataFrame, cost: DataFrame) -> DataFrame:
    b = beds.select("patient", "bed")
    r = routes(v).where("next_patient is not null").join(small_side(b), "patient", "left")
    r = r.join(small_side(b.select(F.col("patient").alias("next_patient"), F.col("bed").alias("next_bed"))), "next_patient", "left")
    return with_cost(r, cost, "bed", "next_bed")


def bedside_specialties(v: DataFrame, roster: DataFrame) -> DataFrame:
    """Largest set of specialties at each patient's bed at any visit's start; the first start wins ties."""
    x = v.join(small_side(roster.select("clinician", "specialties")), "clinician", "left").withColumn("specialties", F.coalesce("specialties", F.array().cast("array<string>")))
    at = v.select("schedule_id", "patient", F.col("start_slot").alias("boundary")).distinct()
    there = x.join(at, ["schedule_id", "patient"]).where((F.col("boundary") >= F.col("start_slot")) & (F.col("boundary") < F.col("end_slot")))
    sets = there.groupBy("schedule_id", "patient", "boundary").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("specialties")))).alias("present"))
    return sets.groupBy("schedule_id", "patient").agg(F.max_by("present", F.struct(F.size("present"), -F.col("boundary"))).alias("present"))


def objectives(v: DataFrame, roster: DataFrame, required: DataFrame, beds: DataFrame, cost: DataFrame, protected: list[int], previous: DataFrame, slot_s: int = SLOT_S) -> DataFrame:
    """``schedule_id`` and the five objectives.

    Co-presence: share of visited patients who need two specialties or more for whom the largest
    gathering holds two of them; 1 where there is no such patient. Continuity: share of the pairs
    of ``previous(patient, clinician)`` seen again; 0 where there is none. Motion over unknown beds
    adds nothing.
    """
    multi = required.where(F.size("required") >= 2)
    co = bedside_specialties(v, roster).join(small_side(multi), "patient").groupBy("schedule_id").agg(F.avg((F.size(F.array_intersect("present", "required")) >= 2).cast("double")).alias("copresence"))
    mo = _legs(v, beds, cost).groupBy("schedule_id").agg(F.sum("metres").alias("motion_m"))
    di = in_protected(v, protected).groupBy("schedule_id").agg(F.count("*").alias("disruption"))
    n_prev = previous.select("patient", "clinician").distinct()
    total = n_prev.count()
    ko = v.select("schedule_id", "patient", "clinician").distinct().join(small_side(n_prev), ["patient", "clinician"], "left_semi").groupBy("schedule_id").agg((F.count("*") / F.lit(max(total, 1))).alias("continuity"))
    ma = v.groupBy("schedule_id").agg((F.max("end_slot") * slot_s).alias("makespan_s"))
    out = ma
    for part in (co, mo, di, ko):
        out = out.join(part, "schedule_id", "left")
    return out.select(
        "schedule_id", F.coalesce("copresence", F.lit(1.0)).alias("copresence"), F.coalesce("motion_m", F.lit(0.0)).alias("motion_m"),
        F.coalesce("disruption", F.lit(0)).alias("disruption"), F.coalesce("continuity", F.lit(0.0)).alias("continuity"), "makespan_s",
    )


def quantise(scored: DataFrame) -> DataFrame:
    """Metres to centimetres, so that dust makes no trade-offs."""
    return scored.withColumn("motion_m", F.round("motion_m", 2))


# Fronts.
def _key(m: np.ndarray) -> np.ndarray:
    """Skyline of rows in which more is always better: which rows nothing dominates; equal rows keep each other."""
    order = np.lexsort(m.T[::-1])[::-1]
    keep: list[int] = []
    front = np.empty((0, m.shape[1]))
    for i in order:
        r = m[i]
        if not len(front) or not ((front >= r).all(1) & (front > r).any(1)).any():
            keep.append(i)
            front = np.vstack([front, r])
    return np.array(keep, dtype=np.int64)


def _skyline(id_col: str, names: list[str], senses: list[bool]):
    sign = np.where(senses, 1.0, -1.0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            held = held.iloc[_key(held[names].to_numpy(dtype=float) * sign)].reset_index(drop=True)
        if held is not None:
            yield held

    return run


def pareto_front(scored: DataFrame, id_col: str = "schedule_id", senses: dict[str, bool] = SENSES) -> DataFrame:
    """Rows that none dominates; of identical vectors the one with the smallest id.

    Two phases: each partition keeps its own skyline, which no dominated row can outlive, then the
    skylines are reduced together, as small as the fronts are. No pairs of rows are formed.
    """
    names = list(senses)
    one = scored.groupBy(*names).agg(F.min(id_col).alias(id_col)).select(id_col, *names)
    ddl = ", ".join(f"{c} {t}" for c, t in one.dtypes)
    step = _skyline(id_col, names, list(senses.values()))
    return one.mapInPandas(step, ddl).repartition(1).mapInPandas(step, ddl)


def front_ranks(scored: DataFrame, id_col: str = "schedule_id", senses: dict[str, bool] = SENSES, max_rank: int | None = None) -> DataFrame:
    """``id, rank``: 0 for the front, 1 for the front of the rest, and so on; identical vectors share a rank.

    Ranks are peeled over distinct vectors in one task; meant for candidate sets of a search.
    """
    names = list(senses)
    sign = np.where(list(senses.values()), 1.0, -1.0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches), ignore_index=True)
        m, rank, left, r = pdf[names].to_numpy(dtype=float) * sign, np.full(len(pdf), -1), np.arange(len(pdf)), 0
        while len(left) and (max_rank is None or r <= max_rank):
            top = left[_key(m[left])]
            rank[top], left, r = r, np.setdiff1d(left, top), r + 1
        yield pd.DataFrame({**{c: pdf[c] for c in names}, "rank": rank})

    one = scored.select(*names).distinct()
    ddl = ", ".join(f"{c} {t}" for c, t in one.dtypes) + ", rank int"
    ranks = one.repartition(1).mapInPandas(run, ddl)
    return scored.join(ranks, names).select(id_col, *names, "rank")


def sparsities(ranked: DataFrame, id_col: str = "schedule_id", senses: dict[str, bool] = SENSES) -> DataFrame:
    """Crowding distance within each rank: per objective the gap between neighbours by the range; ends infinite.

    An objective without range adds nothing; a rank of two members or fewer is infinite throughout.
    """
    out = ranked.withColumns({"_n": F.count("*").over(Window.partitionBy("rank"))})
    total = F.lit(0.0)
    for i, c in enumerate(senses):
        w = Window.partitionBy("rank").orderBy(c, id_col)
        allr = Window.partitionBy("rank")
        out = out.withColumns({f"_l{i}": F.lag(c).over(w), f"_h{i}": F.lead(c).over(w), f"_r{i}": F.max(c).over(allr) - F.min(c).over(allr)})
        edge = F.col(f"_l{i}").isNull() | F.col(f"_h{i}").isNull()
        total = total + F.when(F.col(f"_r{i}") == 0, 0.0).when(edge, float("inf")).otherwise((F.col(f"_h{i}") - F.col(f"_l{i}")) / F.col(f"_r{i}"))
    return out.select(id_col, "rank", F.when(F.col("_n") <= 2, float("inf")).otherwise(total).alias("sparsity"))


def dominates(a: dict, b: dict, senses: dict[str, bool] = SENSES) -> bool:
    pairs = [(a[c], b[c]) if up else (-a[c], -b[c]) for c, up in senses.items()]
    return all(x >= y for x, y in pairs) and any(x > y for x, y in pairs)


def payoff(scored: DataFrame, senses: dict[str, bool] = SENSES) -> DataFrame:
    """``objective, ideal, nadir`` of a set of schedules."""
    rows = F.array(*(F.struct(F.lit(c).alias("objective"), (F.max if up else F.min)(c).cast("double").alias("ideal"), (F.min if up else F.max)(c).cast("double").alias("nadir")) for c, up in senses.items()))
    return scored.agg(rows.alias("r")).select(F.explode("r").alias("r")).select("r.*")


def allowed_starts(clinicians: DataFrame, patients: DataFrame, available: DataFrame, off: DataFrame, n_slots: int, duration: int, as_rows: bool = True) -> DataFrame:
    """``patient, clinician, specialty, start_slot``: holders of a required specialty and starts whose whole footprint is free.

    Without ``as_rows`` the starts of each holder come as one array ``starts``.

    ``clinicians(clinician, specialties)``, ``patients(patient, required)``; slots that a clinician
    has in ``available`` and a patient hasn't in ``off``.
    """
    holders = clinicians.select("clinician", F.explode("specialties").alias("specialty")).distinct()
    need = patients.select("patient", F.explode("required").alias("specialty")).distinct()
    starts = F.sequence(F.lit(0), F.lit(n_slots - duration))
    free_c = available.groupBy("clinician").agg(F.collect_set("slot").alias("slots"))
    free_c = free_c.select("clinician", F.filter(starts, lambda s: F.forall(F.sequence(s, s + duration - 1), lambda t: F.array_contains("slots", t))).alias("cs"))
    blocked = F.array_distinct(F.flatten(F.collect_list(F.sequence(F.col("slot") - duration + 1, F.col("slot")))))
    off_p = off.groupBy("patient").agg(blocked.alias("off"))  # starts whose footprint meets an off-ward slot
    pairs = need.join(small_side(holders), "specialty").join(small_side(free_c), "clinician").join(small_side(off_p), "patient", "left")
    ok = F.when(F.col("off").isNull(), F.col("cs")).otherwise(F.array_except("cs", "off"))
    if not as_rows:
        return pairs.select("patient", "clinician", "specialty", ok.alias("starts")).where(F.size("starts") > 0)
    return pairs.select("patient", "clinician", "specialty", F.explode(ok).alias("start_slot"))


def uncoverable(clinicians: DataFrame, patients: DataFrame) -> DataFrame:
    """Required specialties that no clinician holds."""
    need = patients.select("patient", F.explode("required").alias("specialty")).distinct()
    return need.join(small_side(clinicians.select(F.explode("specialties").alias("specialty")).distinct()), "specialty", "left_anti")


def to_clock(v: DataFrame, day: str, first_hour: int = 8, slot_s: int = SLOT_S) -> DataFrame:
    """Visits with ``start`` and ``seconds`` on the wall clock of their ``day`` column."""
    start = F.unix_date(day).cast("bigint") * 86400 + first_hour * 3600 + F.col("start_slot") * slot_s
    return v.withColumns({"start": from_micros(start * 1_000_000), "seconds": F.col("duration").cast("bigint") * slot_s})


def grid_levels(table: DataFrame, steps: int = 4) -> DataFrame:
    """``objective, level, bound``: evenly spaced bounds from nadir to ideal, for an epsilon sweep over a payoff table."""
    levels = F.sequence(F.lit(0), F.lit(steps))
    x = table.select("objective", "ideal", "nadir", F.explode(levels).alias("level"))
    return x.select("objective", "level", (F.col("nadir") + (F.col("ideal") - F.col("nadir")) * F.col("level") / steps).alias("bound"))
