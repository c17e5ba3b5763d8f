"""Queries of ingest, episodes, evidence and co-presence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardloom.operators import episodes as E
from wardloom.operators import evidence as V
from wardloom.operators import geometry as G
from wardloom.operators import ingest as I
from wardloom.operators import moments as M
from wardloom.plans import views
from wardloom.plans.views import CLAIMS, EVENTS, LAYOUT, RECOGNISED, RUNS, STAYS
from wardloom.session import Query, cut, local_table, table

SALT = b"wardloom-demo-salt"


def joined(c: str):
    """A sorted array as text, so that engines agree on its type."""
    return F.array_join(F.array_sort(c), ",").alias(c)


def scan_events_typed(spark: SparkSession, d: str) -> DataFrame:
    return I.typed_events(table(spark, d, "ward_event"))


def location_map_tiers(spark: SparkSession, d: str) -> DataFrame:
    return views.events(spark, d).groupBy("place", "place_confidence").agg(F.count("*").alias("n_events"))


def pseudonymise_subjects(spark: SparkSession, d: str) -> DataFrame:
    e = views.events(spark, d).where("subject is not null").select("subject_kind", "subject").distinct()
    return e.select("subject_kind", "subject", I.pseudonym("subject", SALT).alias("pseudonym"))


def ingestion_report(spark: SparkSession, d: str) -> DataFrame:
    return I.ingestion_report(views.events(spark, d))


def quarantined_places(spark: SparkSession, d: str) -> DataFrame:
    """What stays unknown where only beds are known, not the wards' stations."""
    known = views.beds(spark).withColumnRenamed("bed", "place")
    return I.quarantined_places(I.map_places(I.typed_events(table(spark, d, "ward_event")), known))


def bay_aliases(spark: SparkSession, d: str) -> DataFrame:
    """Free bay spellings of the events and the place that each alias stands for."""
    given = local_table(spark, [(f"Bay {i}", p) for i, p in enumerate(LAYOUT.bed_names())], "alias string, place string")
    bays = spark.range(40).select(F.concat(F.element_at(F.array(*map(F.lit, ("Bay ", "b", "BAY 0", " bay"))), (F.col("id") % 4 + 1).cast("int")), F.col("id")).alias("location"))
    return I.map_places(bays, views.places(spark), given)


def straight_and_routed(spark: SparkSession, d: str) -> DataFrame:
    """Distance as the crow flies beside the routed one, of all pairs of beds."""
    n = G.nodes(spark, LAYOUT).where("kind = 'bed'")
    a, b = (n.select(F.col("id").alias(k), F.struct("x", "y", "z").alias(f"p{k}")) for k in ("a", "b"))
    both = G.costs(spark, LAYOUT).join(a, "a").join(b, "b")
    point = lambda k: (F.col(f"p{k}.x"), F.col(f"p{k}.y"), F.col(f"p{k}.z"))
    return both.select("a", "b", F.round(G.straight_metres(point("a"), point("b")), 6).alias("straight_m"), F.round("metres", 6).alias("routed_m"))


def sweep_is_stable(spark: SparkSession, d: str) -> DataFrame:
    """Whether recall stays within half of its mean over the dwell thresholds."""
    return E.stable_within(E.dwell_sensitivity(views.events(spark, d), E.EpisodeParams(), known_visits=1000), 0.5)


def transitions(spark: SparkSession, d: str) -> DataFrame:
    t = I.transitions(views.events(spark, d))
    return t.select("subject_kind", "subject", "seq", "origin", "destination", "departed_at", "arrived_at", F.round("seconds", 6).alias("seconds"))


def episodes(spark: SparkSession, d: str) -> DataFrame:
    e = E.episodes(views.events(spark, d))
    return e.withColumns({"dwell_s": F.round("dwell_s", 6), "confidence": F.round("confidence", 6)})


def episodes_by_dwell_sweep(spark: SparkSession, d: str) -> DataFrame:
    return E.dwell_sensitivity(views.events(spark, d), E.EpisodeParams(), known_visits=1000).withColumn("recall", F.round("recall", 6))


def episodes_enriched(spark: SparkSession, d: str) -> DataFrame:
    return views.stays(spark, d).select("clinician", "bed", "start", "end", "patient", joined("specialties"))


def rounds(spark: SparkSession, d: str) -> DataFrame:
    return E.rounds(views.stays(spark, d)).select("clinician", "day", "stop_no", "bed", "start", "patient")


def evidence_long(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "specialty_evidence").where("patient is not null").select("patient").distinct()


def specialty_recognition(spark: SparkSession, d: str) -> DataFrame:
    return V.quarantine_counts(views.recognised(spark, d))


def evidence_index(spark: SparkSession, d: str) -> DataFrame:
    return V.evidence_index(views.recognised(spark, d))


def bounds_degenerate(spark: SparkSession, d: str) -> DataFrame:
    return V.bounds_degenerate(views.recognised(spark, d))


def strategies_all(spark: SparkSession, d: str) -> DataFrame:
    index = V.evidence_index(views.recognised(spark, d))
    return V.patient_grid(index, V.claims(index))


def mdt_selection(spark: SparkSession, d: str) -> DataFrame:
    return V.selection(views.claims(spark, d)).withColumn("confidence", F.round("confidence", 6))


def mdt_moments_by_strategy(spark: SparkSession, d: str) -> DataFrame:
    m = M.mdt_moments(views.stays(spark, d), views.required(spark, d))
    return m.select("strategy", "bed", "patient", "start", "end", joined("present"), joined("satisfied"))


def mdt_moments(spark: SparkSession, d: str) -> DataFrame:
    m = M.mdt_moments(views.stays(spark, d), views.required(spark, d, "union"))
    return m.select("bed", "patient", "start", "end", joined("present"), joined("satisfied"))


def mdt_moments_wide(spark: SparkSession, d: str) -> DataFrame:
    """Moments within an hour over stays of any length, of patients taken together in 500 groups.

    Hardly any patient in a bed needs several specialties in the tables; a group needs what its
    patients need.
    """
    r = V.required_map(V.claims(V.evidence_index(views.recognised(spark, d).withColumn("patient", views.patient_group("patient")))))
    m = M.mdt_moments(views.stays(spark, d, 0).withColumn("patient", views.patient_group("patient")), r, 3600)
    return m.select("strategy", "bed", "patient", "start", "end", joined("present"), joined("satisfied"))


def opportunistic_candidates(spark: SparkSession, d: str) -> DataFrame:
    n = M.near_misses(
        I.transitions(views.events(spark, d)), cut(views.stays(spark, d)), views.required(spark, d, "union"), G.passed_beds(spark, LAYOUT, 15.0)
    )
    return n.select(
        "clinician", "patient", "bed", "seq", "specialty", "at",
        *(F.round(c, 4).alias(c) for c in ("proximity_m", "gap_s", "confidence")),
    )


def travel_nodes(spark: SparkSession, d: str) -> DataFrame:
    return G.nodes(spark, G.Layout())


def travel_edges(spark: SparkSession, d: str) -> DataFrame:
    return G.edges(spark, G.Layout()).select("a", "b", F.round("metres", 6).alias("metres"), F.round("seconds", 6).alias("seconds"))


def travel_cost(spark: SparkSession, d: str) -> DataFrame:
    return G.costs(spark, LAYOUT).select("a", "b", F.round("metres", 6).alias("metres"), F.round("seconds", 6).alias("seconds"))


def _bed_sql(layout: G.Layout) -> str:
    along: dict[int, int] = {}
    rows = []
    for ward, floor in layout.wards:
        i = along.get(floor, 0)
        along[floor] = i + 1
        rows += [f"('{ward}/{b}', '{ward}', {floor}, {i}, {x}, {z})" for b, x, z in layout.beds]
    return "bed_geo as (select * from (values " + ", ".join(rows) + ") t(bed, ward, floor, i, x, z))"


#: Costs in closed form: at the default wait the stairs are quicker than the lift between any two floors.
COSTS = f"""{_bed_sql(LAYOUT)},
cost as (
  select a.bed as a, b.bed as b,
    case when a.bed = b.bed then 0.0 when a.ward = b.ward then sqrt(power(a.x + 6, 2) + a.z * a.z) + sqrt(power(b.x + 6, 2) + b.z * b.z)
      when a.floor = b.floor then sqrt(power(a.x + 6, 2) + a.z * a.z) + sqrt(power(b.x + 6, 2) + b.z * b.z) + 32 * (a.i + b.i) + 20
      else sqrt(power(a.x + 6, 2) + a.z * a.z) + sqrt(power(b.x + 6, 2) + b.z * b.z) + 32 * (a.i + b.i) + 28 + 4.2 * abs(a.floor - b.floor) end as metres,
    case when a.bed = b.bed then 0.0 when a.ward = b.ward then (sqrt(power(a.x + 6, 2) + a.z * a.z) + sqrt(power(b.x + 6, 2) + b.z * b.z)) / 1.2
      when a.floor = b.floor then (sqrt(power(a.x + 6, 2) + a.z * a.z) + sqrt(power(b.x + 6, 2) + b.z * b.z) + 32 * (a.i + b.i) + 20) / 1.2
      else (sqrt(power(a.x + 6, 2) + a.z * a.z) + sqrt(power(b.x + 6, 2) + b.z * b.z) + 32 * (a.i + b.i) + 28) / 1.2 + 8.4 * abs(a.floor - b.floor) end as seconds
  from bed_geo a, bed_geo b
)"""

_MOMENTS = f"""
with {STAYS}, {CLAIMS},
m1 as (select *, case when lag("end") over w is null or start - lag("end") over w > interval 300 second then 1 else 0 end as far
  from stays where patient is not null window w as (partition by bed, patient order by start, "end", clinician)),
m2 as (select *, sum(far) over (partition by bed, patient order by start, "end", clinician) as g from m1),
m3 as (select bed, patient, g, min(start) as start, max("end") as "end", list_sort(list_distinct(flatten(list(specialties)))) as present from m2 group by 1, 2, 3),
m4 as (select m3.*, strategy, list_sort(list_intersect(present, required)) as satisfied from m3 join required using (patient))
"""

QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        scan_events_typed, location_map_tiers, pseudonymise_subjects, ingestion_report, quarantined_places, bay_aliases, straight_and_routed, sweep_is_stable, transitions, episodes, episodes_by_dwell_sweep, episodes_enriched,
        rounds, evidence_long, specialty_recognition, evidence_index, bounds_degenerate, strategies_all, mdt_selection, mdt_moments, mdt_moments_by_strategy, mdt_moments_wide,
        opportunistic_candidates, travel_nodes, travel_edges, travel_cost,
    )
}

_TRANSITIONS = """
moves as (
  select subject_kind, subject, seq, lag(place) over w as origin, place as destination, lag(event_ts) over w as departed_at, event_ts as arrived_at
  from ev where subject is not null and place is not null window w as (partition by subject_kind, subject order by seq)
)"""

def _pad(byte: int) -> str:
    """Padded key of the HMAC as hex digits."""
    return bytes(b ^ byte for b in SALT.ljust(64, b"\0")).hex()


SQL: dict[str, str] = {
    "scan_events_typed": f"with {EVENTS} select seq, event_ts, subject_kind, subject, activity, location, source, confidence from ev",
    "location_map_tiers": f"with {EVENTS} select place, place_confidence, count(*) as n_events from ev group by 1, 2",
    "ingestion_report": f"""with {EVENTS}, x as (
  select *, lag(event_ts) over w as pt, lag(activity) over w as pa, lag(place) over w as pp from ev window w as (partition by subject_kind, subject order by seq)
) select subject_kind, subject, count(*) as n_events, count(*) filter (event_ts < pt) as n_out_of_order,
  count(*) filter (event_ts >= pt and activity = pa and place = pp and event_ts - pt <= interval 10 second) as n_duplicates,
  count(*) filter (place like 'QUARANTINE:%') as n_quarantined from x group by 1, 2""",
    "quarantined_places": f"""with {EVENTS.replace(views._PLACES, ", ".join(f"('{x}')" for x in LAYOUT.bed_names()))} select substr(place, 12) as raw, count(*) as n_events, count(distinct subject) as n_subjects from ev where place like 'QUARANTINE:%' group by 1""",
    "bay_aliases": f"""with b as (select id, ['Bay ', 'b', 'BAY 0', ' bay'][id % 4 + 1] || id as location from range(40) t(id)),
p as (select place, row_number() over () - 1 as i from (select unnest([{", ".join(f"'{x}'" for x in LAYOUT.bed_names())}]) as place))
select location, p.place as place, 0.85::double as place_confidence from b join p on p.i = b.id""",
    "straight_and_routed": f"""with {COSTS} select a, b, round(sqrt(power(32 * (p.i - q.i) + p.x - q.x, 2) + power(4.2 * (p.floor - q.floor), 2) + power(p.z - q.z, 2)), 6)::double as straight_m,
  round(metres, 6)::double as routed_m from cost join bed_geo p on p.bed = a join bed_geo q on q.bed = b""",
    "sweep_is_stable": f"""with {RUNS}, v as (select * from (values (60.0), (120.0), (180.0), (300.0)) t(w)),
r as (select w, count(*) filter (b - a >= w * 1000000) / 1000.0 as recall from v, runs group by 1)
select greatest(max(recall) - avg(recall), avg(recall) - min(recall)) <= 0.5 as stable from r""",
    "transitions": f"""with {EVENTS}, {_TRANSITIONS} select subject_kind, subject, seq, origin, destination, departed_at, arrived_at,
  round((epoch_us(arrived_at) - epoch_us(departed_at)) / 1e6, 6) as seconds from moves where origin <> destination""",
    "episodes": f"""with {RUNS} select clinician, place as bed, make_timestamp(a) as start, make_timestamp(b) as "end", round((b - a) / 1e6, 6) as dwell_s, n_events,
  round(confidence, 6) as confidence from runs where b - a >= 120000000""",
    "episodes_by_dwell_sweep": f"""with {RUNS}, v as (select * from (values (60.0), (120.0), (180.0), (300.0)) t(min_dwell_s))
select min_dwell_s::double as min_dwell_s, count(*) filter (b - a >= min_dwell_s * 1000000) as n_episodes,
  round(count(*) filter (b - a >= min_dwell_s * 1000000) / 1000.0, 6)::double as recall from v, runs group by 1""",
    "episodes_enriched": f"""with {STAYS} select clinician, bed, start, "end", patient, array_to_string(specialties, ',') as specialties from stays""",
    "rounds": f"""with {STAYS} select clinician, start::date as day, row_number() over (partition by clinician, start::date order by start, bed)::int as stop_no, bed, start, patient from stays""",
    "evidence_long": "select distinct patient from specialty_evidence where patient is not null",
    "specialty_recognition": f"with {RECOGNISED} select evidence_source, count(*) as n_records, count(*) filter (recognition < 0.8) as n_unrecognised from recognised group by 1",
    "evidence_index": f"with {CLAIMS} select * from idx",
    "bounds_degenerate": "select count(distinct evidence_source) as n_sources, count(distinct evidence_source) < 3 as bounds_degenerate from specialty_evidence",
    "strategies_all": f"""with {CLAIMS} select p.patient, s.strategy, count(c.specialty) as n_claims from (select distinct patient from idx) p, strategies s
  left join claims c on c.patient = p.patient and c.strategy = s.strategy group by 1, 2""",
    "mdt_selection": f"with {CLAIMS} select patient, specialty, strategy, round(confidence, 6) as confidence, confidence >= 1.0 / 3 - 1e-12 as included from claims",
    "mdt_moments": _MOMENTS
    + """select bed, patient, start, "end", array_to_string(present, ',') as present, array_to_string(satisfied, ',') as satisfied
from m4 where strategy = 'union' and len(satisfied) >= 2""",
    "mdt_moments_by_strategy": _MOMENTS
    + """select strategy, bed, patient, start, "end", array_to_string(present, ',') as present, array_to_string(satisfied, ',') as satisfied
from m4 where len(satisfied) >= 2""",
    "mdt_moments_wide": views.grouped(_MOMENTS).replace("r.b - r.a >= 120000000", "r.b - r.a >= 0").replace("interval 300 second", "interval 3600 second")
    + """select strategy, bed, patient, start, "end", array_to_string(present, ',') as present, array_to_string(satisfied, ',') as satisfied
from m4 where len(satisfied) >= 2""",
    "travel_cost": f"with {COSTS} select a, b, round(metres, 6) as metres, round(seconds, 6) as seconds from cost",
    "pseudonymise_subjects": f"""with {EVENTS}, s as (select distinct subject_kind, subject from ev where subject is not null)
select subject_kind, subject, sha256(unhex('{_pad(0x5C)}') || unhex(sha256(unhex('{_pad(0x36)}') || encode(subject))))[1:16] as pseudonym from s""",
    "travel_nodes": f"""with {_bed_sql(G.Layout())}, w as (select distinct ward, floor, i from bed_geo)
select bed as id, 'bed' as kind, (32.0 * i + x)::double as x, floor * 4.2::double as y, z::double as z from bed_geo
union all select ward || '/CORRIDOR', 'corridor', (32.0 * i - 6)::double, floor * 4.2::double, 0.0::double from w
union all select distinct 'FLOOR' || floor || '/LIFT', 'lift', -16.0::double, floor * 4.2::double, 0.0::double from w
union all select distinct 'FLOOR' || floor || '/STAIR', 'stair', -20.0::double, floor * 4.2::double, 0.0::double from w""",
    "travel_edges": f"""with {_bed_sql(G.Layout())}, w as (select distinct ward, floor, i from bed_geo), f as (select distinct floor from w), e as (
  select bed as a, ward || '/CORRIDOR' as b, sqrt(power(x + 6, 2) + z * z) as m, sqrt(power(x + 6, 2) + z * z) / 1.2 as s from bed_geo
  union all select ward || '/CORRIDOR', 'FLOOR' || floor || '/LIFT', 32 * i + 10, (32 * i + 10) / 1.2 from w
  union all select ward || '/CORRIDOR', 'FLOOR' || floor || '/STAIR', 32 * i + 14, (32 * i + 14) / 1.2 from w
  union all select 'FLOOR' || p.floor || '/LIFT', 'FLOOR' || q.floor || '/LIFT', 4.2 * (q.floor - p.floor), 4.2 * (q.floor - p.floor) + 45 from f p join f q on p.floor < q.floor
  union all select 'FLOOR' || p.floor || '/STAIR', 'FLOOR' || q.floor || '/STAIR', 4.2 * (q.floor - p.floor), 8.4 * (q.floor - p.floor) from f p join f q on p.floor < q.floor
) select a, b, round(m, 6)::double as metres, round(s, 6)::double as seconds from e""",
    "opportunistic_candidates": f"""with {STAYS}, {CLAIMS}, {_bed_sql(LAYOUT)}, {_TRANSITIONS},
g as (select *, sqrt(power(x + 6, 2) + z * z) as d from bed_geo),
near as (
  select o.bed as origin, q.bed as destination, x.bed, least(
    case when x.bed = o.bed then 0.0 when x.ward = o.ward then x.d else 1e9 end, case when x.bed = q.bed then 0.0 when x.ward = q.ward then x.d else 1e9 end,
    case when o.ward <> q.ward and o.floor = q.floor and x.floor = o.floor then 32 * x.i + 10 + x.d else 1e9 end) as metres
  from g o, g q, g x where o.bed <> q.bed
),
skills as (select clinician, list_distinct(flatten(list(specialties))) as skills from stays group by 1),
beds as (select distinct bed, patient from stays where patient is not null),
seen as (select distinct clinician, patient from stays where patient is not null),
m as (
  select subject as clinician, b.patient, b.bed, m.seq, arrived_at, departed_at, metres, list_intersect(required, skills) as needed from moves m
  join near n on n.origin = m.origin and n.destination = m.destination and metres <= 15 join beds b on b.bed = n.bed join skills on skills.clinician = m.subject
  join required r on r.patient = b.patient and r.strategy = 'union' where m.subject_kind = 'clinician' and m.origin <> m.destination
),
gaps as (
  select m.*, (select min(greatest(0, epoch_us(e.start) - epoch_us(m.arrived_at), epoch_us(m.departed_at) - epoch_us(e."end"))) / 1e6 from stays e where e.bed = m.bed and e.patient = m.patient) as gap_s
  from m where len(needed) > 0 and not exists (select 1 from seen s where s.clinician = m.clinician and s.patient = m.patient)
)
select clinician, patient, bed, seq, unnest(needed) as specialty, arrived_at as at, round(metres, 4)::double as proximity_m, round(gap_s, 4) as gap_s,
  round(greatest(0, 1 - metres / 15) * greatest(0, 1 - gap_s / 300), 4)::double as confidence from gaps where gap_s <= 300""",
}
