"""Ward-days as vectors: features, standardising, clusters, neighbours, agreement, cohorts, trace text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardloom.operators.geometry import Layout, nodes, ward_of, with_cost
from wardloom.operators.moments import mdt_moments
from wardloom.operators.ordered import micros
from wardloom.operators.suppression import above_floor
from wardloom.session import bounded_rows, small_side

FEATURES = (
    "n_episodes", "n_clinicians", "n_patients", "median_dwell_s", "iqr_dwell_s", "n_specialties", "motion_m", "motion_per_episode_m",
    "floor_transitions", "bed_revisits", "mdt_moments", "span_s", "median_gap_s", "protected_episodes",
)
#: Least ward-days for clustering; rise between beds that counts as a change of floor; protected hours.
MIN_WARD_DAYS, FLOOR_M = 200, 1.0
PROTECTED = ("12:00:00", "13:00:00")


class InsufficientWardDays(ValueError):
    pass


def ward_day_features(eps: DataFrame, layout: Layout, cost: DataFrame, required: DataFrame | None) -> DataFrame:
    """The 14 features of every ward-day, keyed ``day, ward``, with ``moments_known``.

    Routes are a clinician's episodes of the ward-day by start. Without ``required`` (``patient,
    required``) no moments are counted and ``moments_known`` is false. Medians and spread
    interpolate linearly; without any gap the median gap is 0.
    """
    x = eps.withColumns({"day": F.to_date("start"), "ward": ward_of("bed")})
    key = ["day", "ward"]
    clock = lambda c: F.date_format(c, "HH:mm:ss")
    base = x.groupBy(*key).agg(
        F.count("*").cast("double").alias("n_episodes"),
        F.count_distinct("clinician").cast("double").alias("n_clinicians"),
        F.count_distinct("patient").cast("double").alias("n_patients"),
        F.percentile("dwell_s", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"),
        F.size(F.array_distinct(F.flatten(F.collect_set("specialties")))).cast("double").alias("n_specialties"),
        ((F.max(micros("end")) - F.min(micros("start"))) / 1_000_000).alias("span_s"),
        F.count_if((clock("start") < PROTECTED[1]) & (clock("end") > PROTECTED[0])).cast("double").alias("protected_episodes"),
        F.array_sort(F.collect_set("patient")).alias("patients"),
        F.array_sort(F.collect_set("clinician")).alias("clinicians"),
    )
    w = Window.partitionBy(*key, "clinician").orderBy("start", "bed")
    legs = x.withColumns({"_next": F.lead("bed").over(w), "_wait": F.lead(micros("start")).over(w) - micros("end")})
    legs = legs.withColumn("_gap", F.when(F.col("_wait") > 0, F.col("_wait") / 1_000_000).when(F.col("_wait").isNotNull(), 0.0))
    height = nodes(eps.sparkSession, layout).select("id", "y")
    up = lambda c: small_side(height.select(F.col("id").alias(c), F.col("y").alias(f"_y{c}")))
    legs = with_cost(legs, cost, "bed", "_next").join(up("bed"), "bed", "left").join(up("_next"), "_next", "left")
    route = legs.groupBy(*key).agg(
        F.coalesce(F.sum("metres"), F.lit(0.0)).alias("motion_m"),
        F.count_if(F.abs(F.col("_ybed") - F.col("_y_next")) > FLOOR_M).cast("double").alias("floor_transitions"),
        F.coalesce(F.percentile("_gap", F.lit(0.5)), F.lit(0.0)).alias("median_gap_s"),
    )
    visits = x.groupBy(*key, "clinician").agg((F.count("*") - F.count_distinct("bed")).alias("_r")).groupBy(*key).agg(F.sum("_r").cast("double").alias("bed_revisits"))
    out = base.join(route, key).join(visits, key)
    if required is not None:
        m = mdt_moments(x, required, 300, ("day", "ward")).groupBy(*key).agg(F.count("*").cast("double").alias("mdt_moments"))
        out = out.join(m, key, "left")
    else:
        out = out.withColumn("mdt_moments", F.lit(0.0))
    out = out.withColumns(
        {
            "mdt_moments": F.coalesce("mdt_moments", F.lit(0.0)),
            "median_dwell_s": F.col("_q")[1],
            "iqr_dwell_s": F.col("_q")[2] - F.col("_q")[0],
            "motion_per_episode_m": F.col("motion_m") / F.col("n_episodes"),
            "moments_known": F.lit(required is not None),
        }
    )
    return out.select(*key, *FEATURES, "patients", "clinicians", "moments_known")


def vectors(features: DataFrame, names: tuple[str, ...] = FEATURES) -> DataFrame:
    """``features`` with the named columns as one array ``v``."""
    return features.withColumn("v", F.array(*(F.col(c).cast("double") for c in names)))


def standardise(features: DataFrame, names: tuple[str, ...] = FEATURES) -> DataFrame:
    """Columns less their mean by their population deviation; a column without spread is only centred."""
    stats = features.agg(*(F.avg(c).alias(f"m_{c}") for c in names), *(F.stddev_pop(c).alias(f"s_{c}") for c in names)).first()
    scaled = {c: (F.col(c) - F.lit(stats[f"m_{c}"])) / F.lit(stats[f"s_{c}"] if (stats[f"s_{c}"] or 0) > 1e-12 else 1.0) for c in names}
    return features.withColumns(scaled) if stats[f"m_{names[0]}"] is not None else features


def squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def _nearest(v: Column, centres: list[list[float]]) -> tuple[Column, Column]:
    """Index (lowest of equals) and squared distance of the nearest of a few centres, as literals."""
    all_d = F.array(*(F.round(squared(v, F.array(*map(F.lit, c))), 9) for c in centres))
    low = F.array_min(all_d)
    return (F.array_position(all_d, low) - 1).cast("int"), low


def _distances(pdf: pd.DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors of a batch, the index of each one's nearest centre (lowest of equals) and the squared distance."""
    m = np.array(pdf["v"].tolist(), dtype=float).reshape(len(pdf), centres.shape[1])
    d = np.maximum((m * m).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2 * m @ centres.T, 0).round(9)
    label = d.argmin(1)
    return m, label, d[np.arange(len(m)), label]


def _furthest(df: DataFrame, key: list[str], centres: list[list[float]], race: Column | None = None) -> list[float]:
    """The row furthest from all centres (ties by key): each partition offers one, the best of those is taken.

    With ``race``, a uniform draw for each row, one row is drawn with a chance in proportion to its
    squared distance instead: the first to arrive of exponential waits at these rates.
    """
    c, drawn = np.array(centres), race is not None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = None
        for pdf in batches:
            if len(pdf):
                d = _distances(pdf, c)[2]
                pdf = pdf.assign(d=d / -np.log(np.clip(pdf["u"], 1e-300, 1 - 1e-16)) if drawn else d)
                top = pdf[pdf["d"] == pdf["d"].max()].sort_values(key).head(1)
                best = top if best is None else pd.concat([best, top]).sort_values(["d", *key], ascending=[False, *[True] * len(key)]).head(1)
        if best is not None:
            yield best[[*key, "v", "d"]]

    kinds = ", ".join(f"{n} {t}" for n, t in df.select(*key).dtypes)
    offers = df.select(*key, "v", (F.lit(0.0) if race is None else race).alias("u")).mapInPandas(run, f"{kinds}, v array<double>, d double")
    return list(offers.orderBy(F.desc("d"), *key).limit(1).first()["v"])


def spread_start(df: DataFrame, key: list[str], k: int, seed: int) -> list[list[float]]:
    """k starting centres drawn as in k-means++: one at random, each further one with a chance in proportion to its squared distance.

    Draws are hashes of seed, turn and key, so they don't depend on partitioning.
    """
    u = lambda turn: F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(turn), *key), 11) / F.lit(float(1 << 53))
    centres = [list(df.agg(F.min_by("v", F.struct(u(0), *key))).first()[0])]
    while len(centres) < k:
        centres.append(_furthest(df, key, centres, u(len(centres))))
    return centres


def _centre_sums(df: DataFrame, centres: list[list[float]]) -> dict[int, list[float]]:
    """Mean of the rows nearest to each centre: partial sums in each partition, k vectors to the driver."""
    c = np.array(centres)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros_like(c), np.zeros(len(c))
        for pdf in batches:
            if len(pdf):
                m, label, _ = _distances(pdf, c)
                np.add.at(total, label, m)
                n += np.bincount(label, minlength=len(c))
        used = np.flatnonzero(n)
        yield pd.DataFrame({"label": used, "n": n[used], "s": list(total[used])})

    part = df.select("v").mapInPandas(run, "label int, n double, s array<double>")
    sums = part.select("label", "n", F.posexplode("s").alias("i", "x")).groupBy("label", "i").agg((F.sum("x") / F.sum("n")).alias("mean"))
    out: dict[int, list[float]] = {}
    for r in sums.orderBy("label", "i").collect():
        out.setdefault(r["label"], []).append(r["mean"])
    return out


def kmeans(df: DataFrame, key: list[str], k: int, max_iterations: int = 100, least: int = MIN_WARD_DAYS, seed: int = 2026) -> tuple[DataFrame, list[list[float]]]:
    """Lloyd's algorithm on column ``v``: ``key..., label, distance`` and the centres.

    Each step is one pass with partial sums on the executors; only k vectors come back. An emptied
    cluster takes the row furthest from all centres. Stops when the centres, to nine places, stay.
    Rows with a null vector are left out.
    """
    df = df.where("v is not null").select(*key, F.col("v").cast("array<double>").alias("v"))
    n = df.count()
    if n < least:
        raise InsufficientWardDays(f"{n} rows; clustering needs {least}")
    centres = spread_start(df, key, k, seed)
    for _ in range(max_iterations):
        got = _centre_sums(df, centres)
        spare = _furthest(df, key, centres) if len(got) < k else None
        new = [[round(x, 9) for x in got.get(i, spare)] for i in range(k)]
        if new == centres:
            break
        centres = new
    c = np.array(centres)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                _, label, d = _distances(pdf, c)
                yield pdf[key].assign(label=label, distance=np.sqrt(d))

    kinds = ", ".join(f"{x} {t}" for x, t in df.select(*key).dtypes)
    return df.mapInPandas(run, f"{kinds}, label int, distance double"), centres


def top_neighbours(rows: DataFrame, queries: DataFrame, key: str, k: int = 5, cosine: bool = False, block: int = 2048, drop_self: bool = True) -> DataFrame:
    """k nearest rows of each query by exact distance on array column ``v``: ``query, neighbour, rank, distance``.

    Queries go to the executors in blocks of bounded size; each partition keeps k rows for each
    query, and those are ranked together. Distance is Euclidean, of unit vectors with ``cosine``;
    ties go by key. Rows with a null vector are left out; a zero vector stays zero.
    """
    spark = rows.sparkSession
    rows = rows.where("v is not null").select(F.col(key).cast("bigint").alias("id"), F.col("v").cast("array<double>").alias("v"))
    ask = queries.where("v is not null").select(F.col(key).cast("bigint").alias("id"), F.col("v").cast("array<double>").alias("v"))
    blocks = max(1, -(-ask.count() // block))
    unit = lambda m: m / np.where((s := np.linalg.norm(m, axis=1, keepdims=True)) == 0, 1, s)

    def search(ids: np.ndarray, q: np.ndarray):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            near, who = np.full((len(ids), 0), np.inf), np.zeros((len(ids), 0), dtype=np.int64)
            for pdf in batches:
                if not len(pdf):
                    continue
                m = np.array(pdf["v"].tolist())
                m = unit(m) if cosine else m
                d = np.maximum((q * q).sum(1)[:, None] + (m * m).sum(1)[None, :] - 2 * q @ m.T, 0).round(12)
                mine = np.broadcast_to(pdf["id"].to_numpy()[None, :], d.shape)
                if drop_self:
                    d = np.where(mine == ids[:, None], np.inf, d)
                near, who = np.hstack([near, d]), np.hstack([who, mine])
                at = np.lexsort((who, near), axis=1)[:, :k]
                near, who = np.take_along_axis(near, at, 1), np.take_along_axis(who, at, 1)
            if near.shape[1]:
                keep = np.isfinite(near)
                yield pd.DataFrame({"query": np.repeat(ids, keep.sum(1)), "neighbour": who[keep], "d": near[keep]})

        return run

    out = None
    for i in range(blocks):
        part = ask if blocks == 1 else ask.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i)
        got = bounded_rows(part, 4 * block, "a block of queries")
        if not got:
            continue
        q = np.array([r["v"] for r in got])
        found = rows.mapInPandas(search(np.array([r["id"] for r in got]), unit(q) if cosine else q), "query bigint, neighbour bigint, d double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "query bigint, neighbour bigint, d double")
    w = Window.partitionBy("query").orderBy("d", "neighbour")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", "neighbour", "rank", F.sqrt("d").alias("distance"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row ``ari`` of two labellings from their contingency table; 0 where it is undefined."""
    n2 = lambda c: c * (c - 1) / 2
    table = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    cells = table.agg(F.sum(n2(F.col("n"))).alias("x"), F.sum("n").alias("n"))
    side = lambda c, o: table.groupBy(c).agg(F.sum("n").alias("m")).agg(F.sum(n2(F.col("m"))).alias(o))
    t = cells.select(F.struct("x", "n").alias("c"), F.lit(1).alias("_j")).join(side("a", "sa").withColumn("_j", F.lit(1)), "_j").join(side("b", "sb").withColumn("_j", F.lit(1)), "_j")
    mean = F.col("sa") * F.col("sb") / n2(F.col("c.n"))
    top = (F.col("sa") + F.col("sb")) / 2
    return t.select(F.when((F.col("c.n") < 2) | (top - mean == 0), 0.0).otherwise((F.col("c.x") - mean) / (top - mean)).alias("ari"))


def cohort_summary(features: DataFrame, labels: DataFrame, n_atypical: int = 5) -> tuple[DataFrame, DataFrame]:
    """Each cluster's size, distinct people and mean features, or only ``suppressed`` below the floor; and its most atypical ward-days."""
    x = features.join(labels, ["day", "ward"])
    people = lambda c: F.size(F.array_distinct(F.flatten(F.collect_set(c)))).alias(f"distinct_{c}")
    who = x.groupBy("label").agg(
        F.count("*").alias("n_ward_days"), F.count_distinct("day").alias("n_days"), people("patients"), people("clinicians"), *(F.avg(c).alias(f"mean_{c}") for c in FEATURES)
    )
    ok = above_floor(F.col("distinct_patients"), F.col("distinct_clinicians"))
    numbers = ("n_days", "distinct_patients", "distinct_clinicians", *(f"mean_{c}" for c in FEATURES))
    shown = who.select("label", "n_ward_days", (~ok).alias("suppressed"), *(F.when(ok, F.col(c)).alias(c) for c in numbers))
    w = Window.partitionBy("label").orderBy(F.round("distance", 9).desc(), "day", "ward")
    odd = labels.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n_atypical)
    return shown, odd


def trace_text(eps: DataFrame) -> DataFrame:
    """A ward-day as text: for each clinician, by id, ``round i: bed bucket bed bucket ...``, counted from 0 and joined by `` ; ``.

    Beds are named by what follows the ward, in lower case.
    """
    d = F.col("dwell_s")
    bucket = F.when(d < 300, "brief").when(d < 600, "short").when(d < 1200, "medium").when(d < 2400, "long").otherwise("extended")
    x = eps.withColumns({"day": F.to_date("start"), "ward": ward_of("bed"), "step": F.concat_ws(" ", F.lower(F.regexp_replace("bed", "^[^/]*/", "")), bucket)})
    one = x.groupBy("day", "ward", "clinician").agg(F.array_sort(F.collect_list(F.struct("start", "bed", "step"))).alias("s"))
    one = one.withColumn("text", F.array_join(F.transform("s", lambda e: e["step"]), " "))
    w = Window.partitionBy("day", "ward").orderBy("clinician")
    one = one.withColumn("i", F.row_number().over(w) - 1)
    lines = F.array_sort(F.collect_list(F.struct("i", F.concat(F.lit("round "), F.col("i"), F.lit(": "), F.col("text")).alias("t"))))
    return one.groupBy("day", "ward").agg(F.array_join(F.transform(lines, lambda e: e["t"]), " ; ").alias("trace"))
