"""Queries of motion, coverage and ward-day vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardloom.functions.draws import sql_draw
from wardloom.operators import coverage as C
from wardloom.operators import evidence as V_
from wardloom.operators import features as V
from wardloom.operators import geometry as G
from wardloom.operators import motion as M
from wardloom.operators import suppression as S
from wardloom.plans import views
from wardloom.plans.views import CLAIMS, LAYOUT, STAYS
from wardloom.plans.ward import COSTS, joined
from wardloom.session import Query, cut, local_table, table

PARAMS = M.MotionParams(n_replicates=200, model_confidence=False)  # of the variant in SQL, which takes every stop as certain
REPORT_PARAMS = M.MotionParams()


def r6(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in names})


def _stays(spark: SparkSession, d: str) -> DataFrame:
    """Episodes written once: the queries below read them several times."""
    return cut(views.stays(spark, d))


def modal_ward(spark: SparkSession, d: str) -> DataFrame:
    return M.modal_ward(_stays(spark, d))


def round_observed_metres(spark: SparkSession, d: str) -> DataFrame:
    kept = M.stops(_stays(spark, d)).where(F.col("dwell_s") >= 120)
    return r6(M.observed(kept, G.costs(spark, LAYOUT), ["clinician", "day"]), "observed_m")


def necessary_metres(spark: SparkSession, d: str) -> DataFrame:
    m = M.round_motion(_stays(spark, d), LAYOUT, G.costs(spark, LAYOUT), 120)
    return r6(m, "observed_m", "necessary_m")


def motion_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return r6(M.motion_replicates(_stays(spark, d), LAYOUT, G.costs(spark, LAYOUT), REPORT_PARAMS), "observed_m", "necessary_m")


def motion_observed_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    eps, cost = _stays(spark, d), G.costs(spark, LAYOUT)
    out = None
    for i, v in enumerate(PARAMS.dwell_values):
        kept = M.stops(eps).where(F.col("dwell_s") >= v)
        u = M.modal_ward(eps).join(M.observed(kept, cost, ["clinician", "day"]), ["clinician", "day"], "left").groupBy("day", "ward")
        u = u.agg(F.coalesce(F.sum("observed_m"), F.lit(0.0)).alias("observed_m")).withColumns({"necessary_m": F.lit(0.0), "dwell_no": F.lit(i)})
        out = u if out is None else out.unionByName(u)
    return M.motion_bootstrap(cut(out), PARAMS).select("replicate", F.round("observed_m", 4).alias("observed_m"))


def motion_report(spark: SparkSession, d: str) -> DataFrame:
    """The report over all stays, or why it is refused."""
    try:
        return M.motion_report(_stays(spark, d), LAYOUT, G.costs(spark, LAYOUT), REPORT_PARAMS).withColumn("refused", F.lit(None).cast("string"))
    except S.SuppressionFloor as why:
        return local_table(spark, [(*[None] * 9, str(why))], M.REPORT + ", refused string")


def motion_report_joined(spark: SparkSession, d: str) -> DataFrame:
    """The report over the stays at occupied beds only: a cohort that can be verified."""
    return M.motion_report(_stays(spark, d).where("patient is not null"), LAYOUT, G.costs(spark, LAYOUT), REPORT_PARAMS)


def suppression_floor(spark: SparkSession, d: str) -> DataFrame:
    c = S.cohort(_stays(spark, d))
    return c.withColumn("above_floor", S.above_floor(F.col("n_patients"), F.col("n_clinicians")) & (F.col("n_unjoined") == 0))


def _units(spark: SparkSession, d: str) -> DataFrame:
    return C.coverage_units(_stays(spark, d), views.required(spark, d))


def coverage_units(spark: SparkSession, d: str) -> DataFrame:
    return _units(spark, d)


def coverage_units_wide(spark: SparkSession, d: str) -> DataFrame:
    """Units over stays of any length, moments within an hour, and patients taken together in 500 groups."""
    r = V_.required_map(V_.claims(V_.evidence_index(views.recognised(spark, d).withColumn("patient", views.patient_group("patient")))))
    return C.coverage_units(cut(views.stays(spark, d, 0).withColumn("patient", views.patient_group("patient"))), r, 3600)


def coverage_cells_wide(spark: SparkSession, d: str) -> DataFrame:
    return r6(C.coverage_cells(coverage_units_wide(spark, d)), "coverage", "ci_low", "ci_high")


def coverage_cells(spark: SparkSession, d: str) -> DataFrame:
    return r6(C.coverage_cells(_units(spark, d)), "coverage", "ci_low", "ci_high")


def coverage_cells_open(spark: SparkSession, d: str) -> DataFrame:
    return r6(C.coverage_cells(_units(spark, d), 1, 1), "coverage", "ci_low", "ci_high")


def wilson(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("k"))
    low, high = C.wilson(F.col("k"), F.col("n"))
    return r6(o.withColumns({"ci_low": low, "ci_high": high}), "ci_low", "ci_high")


def coverage_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return r6(C.coverage_bootstrap(cut(_units(spark, d))), "coverage")


def coverage_by_strategy(spark: SparkSession, d: str) -> DataFrame:
    return r6(C.coverage_by_strategy(cut(_units(spark, d))), "coverage", "ci_low", "ci_high")


def _features(spark: SparkSession, d: str) -> DataFrame:
    return V.ward_day_features(_stays(spark, d), LAYOUT, G.costs(spark, LAYOUT), views.required(spark, d, "union"))


def ward_day_features(spark: SparkSession, d: str) -> DataFrame:
    f = _features(spark, d).drop("patients", "clinicians", "moments_known")
    return f.select("day", "ward", *(F.round(F.col(c) + 1e-7, 4).alias(c) for c in V.FEATURES))  # exact halves differ by engine


def features_standardised(spark: SparkSession, d: str) -> DataFrame:
    f = V.standardise(cut(_features(spark, d).drop("patients", "clinicians", "moments_known")))
    return f.select("day", "ward", *(F.round(c, 4).alias(c) for c in V.FEATURES))


def _clusters(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    f = cut(_features(spark, d))
    x = cut(V.vectors(V.standardise(f)).select("day", "ward", "v"))
    try:
        return f, V.kmeans(x, ["day", "ward"], 4)[0]
    except V.InsufficientWardDays:  # refused: no labels
        return f, local_table(spark, [], "day date, ward string, label int, distance double")


def kmeans_full(spark: SparkSession, d: str) -> DataFrame:
    return r6(_clusters(spark, d)[1], "distance")


def cohort_summary(spark: SparkSession, d: str) -> DataFrame:
    f, labels = _clusters(spark, d)
    return V.cohort_summary(f, cut(labels))[0]


def cohort_atypical(spark: SparkSession, d: str) -> DataFrame:
    f, labels = _clusters(spark, d)
    return r6(V.cohort_summary(f, cut(labels))[1], "distance")


def kmeans_embeddings(spark: SparkSession, d: str) -> DataFrame:
    x = cut(table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v")))
    return r6(V.kmeans(x, ["vec_id"], 10)[0], "distance")


def ari_embeddings(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    x = cut(e.select("vec_id", F.col("embedding").cast("array<double>").alias("v")))
    labels = V.kmeans(x, ["vec_id"], 10)[0]
    return r6(V.adjusted_rand(labels.join(e.select("vec_id", F.col("label").alias("truth")), "vec_id"), "label", "truth"), "ari")


def ari(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").withColumn("other", F.when(F.col("embedding")[0] > 0, F.col("label")).otherwise(F.col("label") % 3))
    return r6(V.adjusted_rand(e, "label", "other"), "ari")


def kmeans_assign_step(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    centres = [[round(((i * 37 + j * 11) % 19 - 9) / 40, 3) for j in range(64)] for i in range(5)]
    label, dist = V._nearest(F.col("v"), centres)
    return e.select("vec_id", label.alias("centre"), F.round(F.sqrt(dist), 5).alias("distance"))


def nearest_ward_days(spark: SparkSession, d: str) -> DataFrame:
    x = V.vectors(V.standardise(cut(_features(spark, d)))).withColumn("id", F.expr("cast(unix_date(day) * 1000L + ascii(ward) * 10 + locate(substring(ward, 2, 1), 'NES') as bigint)"))
    x = cut(x.select("id", "v"))
    return V.top_neighbours(x, x, "id").withColumn("distance", F.round("distance", 5))


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    got = V.top_neighbours(e, e.where("vec_id % 50 = 0"), "vec_id", 10, cosine=True)
    return got.select("query", "neighbour", "rank", F.round(1 - F.col("distance") * F.col("distance") / 2, 5).alias("similarity"))


def trace_text(spark: SparkSession, d: str) -> DataFrame:
    return V.trace_text(_stays(spark, d))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        modal_ward, round_observed_metres, necessary_metres, motion_bootstrap, motion_observed_bootstrap, motion_report, motion_report_joined, suppression_floor, coverage_units, coverage_units_wide, coverage_cells_wide, coverage_cells,
        coverage_cells_open, wilson, coverage_bootstrap, coverage_by_strategy, ward_day_features, features_standardised, kmeans_full, cohort_summary, cohort_atypical,
        kmeans_assign_step, kmeans_embeddings, ari, ari_embeddings, nearest_ward_days, vector_topk, trace_text,
    )
}

_MODAL = """
dwell as (select clinician, start::date as day, split_part(bed, '/', 1) as ward, sum(dwell_s) as d from stays group by 1, 2, 3),
modal as (select clinician, day, arg_max(ward, (round(d, 6), ward)) as ward from dwell group by 1, 2)"""

_LEGS = """
legs as (select clinician, start::date as day, bed, lead(bed) over (partition by clinician, start::date order by start, bed) as nxt from stays where dwell_s >= {0})"""

_UNITS = f"""
with {STAYS}, {CLAIMS},
x as (select *, start::date as day, split_part(bed, '/', 1) as ward from stays),
cells as (select day, ward, count(distinct patient) as n_observed, count(distinct clinician) as n_clinicians from x group by 1, 2),
multi as (select strategy, patient, required from required where len(required) >= 2),
seen as (select distinct day, ward, x.patient, strategy, required from x join multi using (patient)),
m1 as (select *, case when lag("end") over w is null or start - lag("end") over w > interval 300 second then 1 else 0 end as far
  from x where patient is not null window w as (partition by day, ward, bed, patient order by start, "end", clinician)),
m2 as (select *, sum(far) over (partition by day, ward, bed, patient order by start, "end", clinician) as g from m1),
m3 as (select day, ward, bed, patient, g, list_distinct(flatten(list(specialties))) as present from m2 group by 1, 2, 3, 4, 5),
hit as (select distinct day, ward, patient, strategy from m3 join required using (patient) where len(list_intersect(present, required)) >= 2),
n as (select seen.day, seen.ward, seen.strategy, count(*) as n_patients, count(hit.patient) as n_covered from seen left join hit
  on seen.day = hit.day and seen.ward = hit.ward and seen.patient = hit.patient and seen.strategy = hit.strategy group by 1, 2, 3),
units as (select c.day, c.ward, s.strategy, n_observed, n_clinicians, coalesce(n_patients, 0) as n_patients, coalesce(n_covered, 0) as n_covered
  from cells c cross join strategies s left join n on n.day = c.day and n.ward = c.ward and n.strategy = s.strategy)
"""


_WIDE = views.grouped(_UNITS).replace("r.b - r.a >= 120000000", "r.b - r.a >= 0").replace("interval 300 second", "interval 3600 second")


def _wilson_sql(k: str, n: str, sign: str) -> str:
    z = repr(C.Z)
    z2 = repr(C.Z * C.Z)
    mid = f"(({k}::double / {n}) + {z2} / (2 * {n})) / (1 + {z2} / {n})"
    half = f"{z} * sqrt(({k}::double / {n}) * (1 - {k}::double / {n}) / {n} + {z2} / (4.0 * {n} * {n})) / (1 + {z2} / {n})"
    return f"greatest(0.0, {mid} - {half})" if sign == "-" else f"least(1.0, {mid} + {half})"


def _cells_sql(p: int, c: int, units: str = _UNITS) -> str:
    ok = f"n_patients >= {p} and n_clinicians >= {c}"
    return (
        units
        + f"""select day, ward, strategy, not ({ok}) as suppressed, case when {ok} then n_patients end as n_patients, case when {ok} then n_covered end as n_covered,
  case when {ok} then round(n_covered / n_patients, 6) end as coverage, case when {ok} then round({_wilson_sql("n_covered", "n_patients", "-")}, 6) end as ci_low,
  case when {ok} then round({_wilson_sql("n_covered", "n_patients", "+")}, 6) end as ci_high from units"""
    )


_FEATURES = f"""
with {STAYS}, {CLAIMS}, {COSTS},
x as (select *, start::date as day, split_part(bed, '/', 1) as ward from stays),
base as (
  select day, ward, count(*)::double as n_episodes, count(distinct clinician)::double as n_clinicians, count(distinct patient)::double as n_patients,
    quantile_cont(dwell_s, 0.5) as median_dwell_s, quantile_cont(dwell_s, 0.75) - quantile_cont(dwell_s, 0.25) as iqr_dwell_s,
    len(list_distinct(flatten(list(specialties))))::double as n_specialties, (epoch_us(max("end")) - epoch_us(min(start))) / 1e6 as span_s,
    (count(*) filter (strftime(start, '%H:%M:%S') < '13:00:00' and strftime("end", '%H:%M:%S') > '12:00:00'))::double as protected_episodes
  from x group by 1, 2
),
l0 as (select day, ward, clinician, bed, lead(bed) over w as nxt, greatest(0, epoch_us(lead(start) over w) - epoch_us("end")) / 1e6 as gap0,
  lead(start) over w as ns from x window w as (partition by day, ward, clinician order by start, bed)),
l1 as (select l0.*, case when ns is not null then gap0 end as gap, metres, ga.floor as fa, gb.floor as fb from l0 left join cost on cost.a = bed and cost.b = nxt
  left join bed_geo ga on ga.bed = l0.bed left join bed_geo gb on gb.bed = nxt),
route as (select day, ward, coalesce(sum(metres), 0.0) as motion_m, (count(*) filter (fa <> fb))::double as floor_transitions, coalesce(quantile_cont(gap, 0.5), 0.0) as median_gap_s from l1 group by 1, 2),
rev as (select day, ward, sum(r)::double as bed_revisits from (select day, ward, clinician, count(*) - count(distinct bed) as r from x group by 1, 2, 3) group by 1, 2),
m1 as (select *, case when lag("end") over w is null or start - lag("end") over w > interval 300 second then 1 else 0 end as far
  from x where patient is not null window w as (partition by day, ward, bed, patient order by start, "end", clinician)),
m2 as (select *, sum(far) over (partition by day, ward, bed, patient order by start, "end", clinician) as g from m1),
m3 as (select day, ward, bed, patient, g, list_distinct(flatten(list(specialties))) as present from m2 group by 1, 2, 3, 4, 5),
mom as (select day, ward, count(*)::double as mdt_moments from m3 join required using (patient) where strategy = 'union' and len(list_intersect(present, required)) >= 2 group by 1, 2),
feats as (
  select day, ward, n_episodes, n_clinicians, n_patients, median_dwell_s, iqr_dwell_s, n_specialties, motion_m, motion_m / n_episodes as motion_per_episode_m, floor_transitions,
    bed_revisits, coalesce(mdt_moments, 0.0) as mdt_moments, span_s, median_gap_s, protected_episodes
  from base join route using (day, ward) join rev using (day, ward) left join mom using (day, ward)
)
"""

SQL: dict[str, str] = {
    "modal_ward": f"with {STAYS}, {_MODAL} select * from modal",
    "round_observed_metres": f"""with {STAYS}, {COSTS}, {_LEGS.format(120)} select clinician, day, round(coalesce(sum(metres), 0.0), 6) as observed_m
from legs left join cost on cost.a = bed and cost.b = nxt group by 1, 2""",
    "motion_observed_bootstrap": f"""with {STAYS}, {COSTS}, {_MODAL},
th as (select * from (values (0, 60), (1, 120), (2, 180), (3, 300)) t(dwell_no, v)),
l2 as (select dwell_no, clinician, start::date as day, bed, lead(bed) over (partition by dwell_no, clinician, start::date order by start, bed) as nxt from stays join th on dwell_s >= v),
obs as (select dwell_no, clinician, day, sum(metres) as m from l2 left join cost on cost.a = bed and cost.b = nxt group by 1, 2, 3),
units as (select th.dwell_no, day, ward, coalesce(sum(m), 0) as m from modal cross join th left join obs using (dwell_no, clinician, day) group by 1, 2, 3),
ids as (select day, ward, row_number() over (order by day, ward) - 1 as unit from (select distinct day, ward from units)),
n as (select count(*) as n from ids),
reps as (select i as replicate, {sql_draw(PARAMS.seed, "i")} % 4 as dwell_no from range(200) t(i)),
draws as (select replicate, dwell_no, {sql_draw(PARAMS.seed + 1, "replicate", "k")} % n as unit from reps, n, range(1, n.n + 1) t(k))
select replicate, round(sum(m), 4) as observed_m from draws join ids using (unit) join units using (day, ward, dwell_no) group by 1""",
    "suppression_floor": f"""with {STAYS}, c as (select count(distinct patient) as n_patients, count(distinct clinician) as n_clinicians, count(*) filter (patient is null) as n_unjoined from stays)
select *, n_patients >= 5 and n_clinicians >= 2 and n_unjoined = 0 as above_floor from c""",
    "coverage_units": _UNITS + "select * from units",
    "coverage_units_wide": _WIDE + "select * from units",
    "coverage_cells_wide": _cells_sql(5, 2, _WIDE),
    "coverage_cells": _cells_sql(5, 2),
    "coverage_cells_open": _cells_sql(1, 1),
    "wilson": f"""with o as (select o_orderpriority, count(*) as n, count(*) filter (o_orderstatus = 'F') as k from orders group by 1)
select *, round({_wilson_sql("k", "n", "-")}, 6) as ci_low, round({_wilson_sql("k", "n", "+")}, 6) as ci_high from o""",
    "coverage_bootstrap": _UNITS.rstrip()
    + f""",
ids as (select day, ward, row_number() over (order by day, ward) - 1 as unit from cells),
nn as (select count(*) as n from ids),
draws as (select i as replicate, k, {sql_draw(7, "i", "k")} % n as unit from range(1000) t(i), nn, range(1, nn.n + 1) u(k)),
d2 as (select replicate, k, strategy, n_patients, n_covered from draws join ids using (unit) join units using (day, ward)),
d3 as (select replicate, strategy, n_patients, case when n_patients > 0 then
  len(list_filter(range(1, n_patients + 1), lambda p: {sql_draw(8, "replicate", f"k * {C.STRIDE} + p")} % n_patients < n_covered)) else 0 end as hits from d2)
select strategy, replicate, round(sum(hits) / nullif(sum(n_patients), 0), 6) as coverage from d3 group by 1, 2""",
    "ward_day_features": _FEATURES + "select day, ward, " + ", ".join(f"round({c} + 1e-7, 4) as {c}" for c in V.FEATURES) + " from feats",
    "features_standardised": _FEATURES
    + "select day, ward, "
    + ", ".join(f"round(({c} - avg({c}) over ()) / case when stddev_pop({c}) over () > 1e-12 then stddev_pop({c}) over () else 1 end, 4) as {c}" for c in V.FEATURES)
    + " from feats",
    "ari": """with e as (select label as a, case when embedding[1] > 0 then label else label % 3 end as b from embeddings),
t as (select a, b, count(*) as n from e group by 1, 2),
s as (select (select sum(n * (n - 1) / 2) from t) as x, (select sum(m * (m - 1) / 2) from (select sum(n) as m from t group by a)) as sa,
  (select sum(m * (m - 1) / 2) from (select sum(n) as m from t group by b)) as sb, (select sum(n) from t) as n)
select round((x - sa * sb / (n * (n - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2)), 6)::double as ari from s""",
    "kmeans_assign_step": """with c as (select i, list_transform(range(64), lambda j: round(((i * 37 + j * 11) % 19 - 9) / 40.0, 3)) as c from range(5) t(i)),
d as (select vec_id, i, round(list_sum(list_transform(list_zip(embedding, c), lambda p: power(p[1]::double - p[2]::double, 2))), 9) as d from embeddings, c)
select vec_id, arg_min(i, (d, i))::int as centre, round(sqrt(min(d)), 5) as distance from d group by 1""",
    "vector_topk": """with v as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings),
p as (select q.vec_id as query, r.vec_id as neighbour, list_cosine_similarity(q.v, r.v) as s from v q, v r where q.vec_id % 50 = 0 and q.vec_id <> r.vec_id)
select query, neighbour, row_number() over (partition by query order by round(2 - 2 * s, 12), neighbour)::int as rank, round(s, 5) as similarity from p
qualify row_number() over (partition by query order by round(2 - 2 * s, 12), neighbour) <= 10""",
    "trace_text": f"""with {STAYS},
x as (select *, start::date as day, split_part(bed, '/', 1) as ward, lower(split_part(bed, '/', 2)) || ' ' || case when dwell_s < 300 then 'brief' when dwell_s < 600 then 'short'
  when dwell_s < 1200 then 'medium' when dwell_s < 2400 then 'long' else 'extended' end as step from stays),
one as (select day, ward, clinician, string_agg(step, ' ' order by start, bed, step) as text from x group by 1, 2, 3),
num as (select *, row_number() over (partition by day, ward order by clinician) - 1 as i from one)
select day, ward, string_agg('round ' || i || ': ' || text, ' ; ' order by i) as trace from num group by 1, 2""",
}
#: The refusal; the tables always hold stays at beds without a patient.
SQL["motion_report"] = f"""with {STAYS}, c as (select count(*) filter (patient is null) as u from stays)
select null::double as observed_m, null::double as necessary_m, null::double as attributable_m, null::double as ci_low, null::double as ci_high, null::bigint as n_ward_days,
  null::bigint as n_patients, null::bigint as n_clinicians, null::int as n_replicates, u || ' episodes have no patient; the cohort can''t be verified' as refused from c"""
SQL["coverage_by_strategy"] = f"""with boot as ({SQL["coverage_bootstrap"].replace("round(sum(hits) / nullif(sum(n_patients), 0), 6)", "sum(hits) / nullif(sum(n_patients), 0)")}),
bs as (select strategy, count(*) as usable, quantile_cont(coverage, 0.025) as lo, quantile_cont(coverage, 0.975) as hi from boot where coverage is not null group by 1),
u as ({SQL["coverage_units"]}),
pool as (select strategy, sum(n_patients)::bigint as n, sum(n_covered)::bigint as k, count(*) as n_ward_days from u group by 1)
select strategy, n, k, n_ward_days, case when n > 0 and usable >= 2 then round(k / n, 6) end as coverage,
  case when n > 0 and usable >= 2 then round(least({_wilson_sql("k", "n", "-")}, lo), 6) end as ci_low,
  case when n > 0 and usable >= 2 then round(greatest({_wilson_sql("k", "n", "+")}, hi), 6) end as ci_high,
  case when n = 0 then 'nobody needs two specialties' when usable is null or usable < 2 then 'too few replicates' end as refused
from pool left join bs using (strategy)"""
