"""Co-presence at the bedside and near misses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardloom.operators.ordered import from_micros, micros
from wardloom.session import small_side


def gatherings(eps: DataFrame, keys: list[str], window_s: float = 300) -> DataFrame:
    """Clusters of episodes at one bed and patient: ``keys, g, start, end, present``.

    Ordered by start (then clinician), an episode begins a new cluster if it starts more than
    ``window_s`` after the end of the episode before it, whatever ended last before that.
    Episodes without patient are left out. ``keys`` (bed and patient among them) part the
    clusters. Beds hold one patient at a time, so a group is as long as that bed's history.
    """
    x = eps.where("patient is not null").withColumns({"_a": micros("start"), "_b": micros("end")})
    w = Window.partitionBy(*keys).orderBy("_a", "_b", "clinician")
    far = F.lag("_b").over(w).isNull() | (F.col("_a") - F.lag("_b").over(w) > round(window_s * 1_000_000))
    x = x.withColumn("_far", F.when(far, 1).otherwise(0)).withColumn("g", F.sum("_far").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy(*keys, "g").agg(
        from_micros(F.min("_a")).alias("start"), from_micros(F.max("_b")).alias("end"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("specialties")))).alias("present")
    )


def mdt_moments(eps: DataFrame, required: DataFrame, window_s: float = 300, extra_keys: tuple[str, ...] = ()) -> DataFrame:
    """Clusters at which at least two of the patient's required specialties are present.

    ``required`` has ``patient, required`` and, for several strategies at once, ``strategy``.
    Returns ``bed, patient, extra keys, [strategy], start, end, present, satisfied``.
    """
    keys = [*extra_keys, "bed", "patient"]
    by = [c for c in ("strategy",) if c in required.columns]
    g = gatherings(eps, keys, window_s).join(small_side(required), "patient")
    g = g.withColumn("satisfied", F.array_sort(F.array_intersect("present", "required")))
    return g.where(F.size("satisfied") >= 2).select(*keys, *by, "start", "end", "present", "satisfied")


def near_misses(
    moves: DataFrame, eps: DataFrame, required: DataFrame, passed: DataFrame, proximity_m: float = 15, window_s: float = 300
) -> DataFrame:
    """Walks of a clinician past a patient who needs them, while that bed was being visited.

    ``moves`` are transitions with origin, destination, departed_at, arrived_at and subject;
    ``passed`` lists the beds within ``proximity_m`` of each way. Left out: clinicians without
    specialties, or never at any bed; patients they saw at any time; ways that aren't routed.
    Returns ``clinician, patient, bed, specialty, at, proximity_m, gap_s, confidence``, one row for
    each needed specialty; confidence falls linearly with distance and with the gap to the
    nearest episode at that bed.
    """
    skills = eps.groupBy("clinician").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("specialties")))).alias("skills")).where(F.size("skills") > 0)
    beds = eps.where("patient is not null").select("bed", "patient").distinct()
    seen = eps.where("patient is not null").select("clinician", "patient").distinct()
    m = moves.where("subject_kind = 'clinician'").select(F.col("subject").alias("clinician"), "seq", "origin", "destination", "departed_at", "arrived_at")
    m = m.join(small_side(skills), "clinician").join(small_side(passed.where(F.col("metres") <= proximity_m)), ["origin", "destination"])
    m = m.join(small_side(beds), "bed").join(small_side(required.select("patient", "required")), "patient")
    m = m.withColumn("needed", F.array_intersect("required", "skills")).where(F.size("needed") > 0).drop("required", "skills")
    m = m.join(seen, ["clinician", "patient"], "left_anti")
    # Only episodes within the window of the walk can be near enough: an equi-join on blocks of time.
    width = round(max(window_s, 3600) * 1_000_000)
    us = round(window_s * 1_000_000)
    a, b = micros("departed_at"), micros("arrived_at")
    e = eps.where("patient is not null").select("bed", "patient", micros("start").alias("s"), micros("end").alias("z"))
    e = e.withColumn("blk", F.explode(F.sequence(F.floor((F.col("s") - us) / width), F.floor((F.col("z") + us) / width))))
    low, high = F.least(a, b), F.greatest(a, b)
    m = m.withColumns({"a": a, "b": b}).withColumn("blk", F.explode(F.sequence(F.floor(low / width), F.floor(high / width))))
    j = m.join(e, ["bed", "patient", "blk"])
    gap = F.greatest(F.lit(0).cast("bigint"), F.col("s") - F.col("b"), F.col("a") - F.col("z"))
    found = j.groupBy("clinician", "patient", "bed", "seq", "arrived_at", "metres", "needed").agg((F.min(gap) / 1_000_000).alias("gap_s")).where(F.col("gap_s") <= window_s)
    near = F.greatest(F.lit(0.0), 1 - F.col("metres") / proximity_m) if proximity_m > 0 else F.lit(1.0)
    timely = F.greatest(F.lit(0.0), 1 - F.col("gap_s") / window_s) if window_s > 0 else F.lit(1.0)
    return found.select(
        "clinician", "patient", "bed", "seq", F.explode("needed").alias("specialty"), F.col("arrived_at").alias("at"), F.col("metres").alias("proximity_m"), "gap_s",
        (near * timely).alias("confidence"),
    )
