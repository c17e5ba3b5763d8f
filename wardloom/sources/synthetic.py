"""Synthetic event logs with known truth, made on the executors from counter-based draws."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardloom.functions.draws import M, draw
from wardloom.operators.evidence import SOURCES
from wardloom.operators.geometry import Layout


@dataclass(frozen=True)
class LogConfig:
    """A log of ``n_clinicians`` rounds of ``n_visits`` on each of ``n_days`` days; noise as shares of events."""

    n_clinicians: int = 6
    n_visits: int = 6
    n_days: int = 1
    seed: int = 42
    visit_s: tuple[int, int] = (180, 900)
    walk_s: tuple[int, int] = (100, 400)
    ping_every_s: int = 60
    missed: float = 0.0
    doubled: float = 0.0
    weak: float = 0.0


def _between(seed: int, lo: int, hi: int, *n: Column) -> Column:
    return F.lit(lo) + draw(seed, *n) % (hi - lo + 1)


def visits(spark: SparkSession, layout: Layout, c: LogConfig) -> DataFrame:
    """True visits: ``clinician, visit_no, bed, day, start (seconds of day), duration_s``."""
    beds = F.array(*map(F.lit, layout.bed_names()))
    n = len(layout.bed_names())
    x = spark.range(c.n_clinicians * c.n_days * c.n_visits).select(
        (F.col("id") % c.n_visits).alias("visit_no"), (F.floor(F.col("id") / c.n_visits) % c.n_clinicians).alias("k"), F.floor(F.col("id") / (c.n_visits * c.n_clinicians)).alias("day"), "id"
    )
    x = x.withColumns({"duration_s": _between(c.seed, *c.visit_s, F.col("id")), "walk_s": _between(c.seed + 1, *c.walk_s, F.col("id"))})
    w = Window.partitionBy("day", "k").orderBy("visit_no").rowsBetween(Window.unboundedPreceding, -1)
    start = F.lit(8 * 3600) + F.coalesce(F.sum(F.col("duration_s") + F.col("walk_s")).over(w), F.lit(0))
    # Each visit is at another bed than the one before.
    step = F.sum(F.lit(1) + draw(c.seed + 2, F.col("id")) % (n - 1)).over(Window.partitionBy("day", "k").orderBy("visit_no"))
    return x.select(
        F.format_string("C%03d", "k").alias("clinician"), "visit_no", F.get(beds, (step % n).cast("int")).alias("bed"), "day", start.alias("start_s"), "duration_s", "id"
    )


def event_log(spark: SparkSession, layout: Layout, c: LogConfig) -> tuple[DataFrame, DataFrame]:
    """Events of the visits (arrive, pings, depart) with the configured noise, and the true visits."""
    truth = visits(spark, layout, c)
    offsets = F.concat(F.sequence(F.lit(0), F.col("duration_s") - 1, F.lit(c.ping_every_s)), F.array(F.col("duration_s")))
    e = truth.select("*", F.posexplode(offsets).alias("i", "off"))
    kind = F.when(F.col("off") == 0, "arrive").when(F.col("off") == F.col("duration_s"), "depart").otherwise("ping")
    key = F.col("id") * 100_000 + F.col("i")
    share = lambda s: draw(c.seed + s, key) / float(M)
    ts = F.timestamp_seconds(F.lit(1767571200) + F.col("day") * 86400 + F.col("start_s") + F.col("off")).cast("timestamp_ntz")
    e = e.where(share(10) >= c.missed).select(
        (key * 2).alias("seq"), ts.alias("event_ts"), F.lit("clinician").alias("subject_kind"), F.col("clinician").alias("subject"), kind.alias("activity"), F.col("bed").alias("location"),
        F.lit("synthetic").alias("source"), F.when(share(11) < c.weak, 0.5).otherwise(1.0).alias("confidence"), (share(12) < c.doubled).alias("again"),
    )
    twice = e.where("again").withColumn("seq", F.col("seq") + 1)
    return e.unionByName(twice).drop("again"), truth


def evidence(spark: SparkSession, n_patients: int, specialties: list[str], recall: dict[str, float], seed: int = 5) -> tuple[DataFrame, DataFrame]:
    """Evidence rows of three sources with given recalls, and the truth ``patient, specialty``."""
    names = F.array(*map(F.lit, specialties))
    n = len(specialties)
    p = spark.range(n_patients).select("id", F.format_string("P%05d", "id").alias("patient"), F.explode(F.sequence(F.lit(0), F.col("id") % 3)).alias("j"))
    truth = p.select("patient", "id", "j", F.get(names, ((draw(seed, F.col("id")) + F.col("j") * 7) % n).cast("int")).alias("specialty"))
    rows = truth.select("*", F.explode(F.array(*(F.struct(F.lit(s).alias("s"), F.lit(i).alias("i"), F.lit(float(recall.get(s, 1.0))).alias("r")) for i, s in enumerate(SOURCES)))).alias("x"))
    rows = rows.where(draw(seed + 1, F.col("id") * 10 + F.col("j"), F.col("x.i")) / float(M) < F.col("x.r"))
    out = rows.select(F.col("x.s").alias("evidence_source"), "patient", F.initcap("specialty").alias("specialty_text"), F.lit("synthetic").alias("source"))
    return out, truth.select("patient", "specialty").distinct()


#: Day types: bedside dwell in seconds, visits a clinician, clinicians a ward.
DAY_TYPES = {"quiet": (240, 3, 2), "steady": (420, 6, 3), "surge": (300, 12, 5), "ward_round": (900, 8, 6)}


def ward_days(spark: SparkSession, layout: Layout, n_days: int = 24, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Episodes of ward-days of four types with jitter, and the types: ``day, ward, day_type``."""
    types = list(DAY_TYPES)
    wards = [w for w, _ in layout.wards]
    grid = spark.createDataFrame([(w, i) for i, w in enumerate(wards)], "ward string, wi int").withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(n_days - 1))))
    unit = F.col("d") * 1000 + F.col("wi")
    grid = grid.withColumn("t", (draw(seed, unit) % len(types)).cast("int"))
    spec = F.array(*(F.struct(F.lit(k).alias("day_type"), *(F.lit(v).alias(n) for n, v in zip(("dwell", "visits", "staff"), DAY_TYPES[k]))) for k in types))
    grid = grid.withColumn("s", F.get(spec, F.col("t"))).withColumn("day", F.date_add(F.lit("2026-01-05").cast("date"), F.col("d")))
    x = grid.withColumn("c", F.explode(F.sequence(F.lit(0), F.col("s.staff") - 1))).withColumn("v", F.explode(F.sequence(F.lit(0), F.col("s.visits") - 1)))
    key = unit * 10_000 + F.col("c") * 100 + F.col("v")
    dwell = (F.col("s.dwell") * (F.lit(0.7) + 0.6 * draw(seed + 1, key) / float(M))).cast("bigint")
    start = F.lit(8 * 3600) + F.col("v") * (F.col("s.dwell") + 300) + draw(seed + 2, key) % 120
    beds = F.array(*(F.lit(b) for b, _, _ in layout.beds))
    bed = F.concat_ws("/", "ward", F.get(beds, (draw(seed + 3, key) % len(layout.beds)).cast("int")))
    base = F.unix_date("day").cast("bigint") * 86400
    eps = x.select(
        F.format_string("%s-C%d", "ward", "c").alias("clinician"), bed.alias("bed"), F.timestamp_seconds(base + start).cast("timestamp_ntz").alias("start"),
        F.timestamp_seconds(base + start + dwell).cast("timestamp_ntz").alias("end"), dwell.cast("double").alias("dwell_s"), F.lit(1.0).alias("confidence"),
        F.concat(F.lit("P-"), bed).alias("patient"), F.array(F.concat(F.lit("s"), F.col("c") % 4)).alias("specialties"),
    )
    return eps, grid.select("day", "ward", F.col("s.day_type").alias("day_type"))
