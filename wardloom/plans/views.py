"""The test tables as the ward operators take them, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardloom.functions.keys import id_key, sql_id, sql_kind, sql_name
from wardloom.operators import episodes as E
from wardloom.operators import evidence as V
from wardloom.operators import ingest as I
from wardloom.operators.geometry import ward_layout
from wardloom.session import local_table, table

LAYOUT = ward_layout()
STATIONS = [f"{w}/NS" for w, _ in LAYOUT.wards]


def places(spark: SparkSession) -> DataFrame:
    return local_table(spark, [(p,) for p in LAYOUT.bed_names() + STATIONS], "place string")


def beds(spark: SparkSession) -> DataFrame:
    return local_table(spark, [(p,) for p in LAYOUT.bed_names()], "bed string")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed events with mapped places."""
    return I.map_places(I.typed_events(table(spark, sf_dir, "ward_event")), places(spark))


def stays(spark: SparkSession, sf_dir: str, min_dwell_s: float = 120) -> DataFrame:
    """Episodes at beds with patients and specialties."""
    eps = E.episodes(events(spark, sf_dir), E.EpisodeParams(min_dwell_s=min_dwell_s), beds(spark))
    return E.attach_specialties(E.attach_patients(eps, table(spark, sf_dir, "bed_occupancy")), table(spark, sf_dir, "clinician_roster"))


def recognised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.recognise(table(spark, sf_dir, "specialty_evidence"), table(spark, sf_dir, "specialty_ref"))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.claims(V.evidence_index(recognised(spark, sf_dir)))


def patient_group(c: str):
    """A patient's group of 500, by the number in the id."""
    return (F.regexp_extract(id_key(c), "([0-9]+)$", 1).try_cast("int") % 500).cast("string")


def grouped(sql: str) -> str:
    """SQL over stays and claims with patients in groups."""
    group = lambda c: f"(regexp_extract({c}, '([0-9]+)$', 1)::int % 500)::varchar"
    assert sql.count(f"select {sql_id('patient')} as patient, specialty") == 1 == sql.count("    o.patient, coalesce(")
    sql = sql.replace(f"select {sql_id('patient')} as patient, specialty", f"select {group(sql_id('patient'))} as patient, specialty")
    return sql.replace("    o.patient, coalesce(", f"    {group('o.patient')} as patient, coalesce(")


def required(spark: SparkSession, sf_dir: str, strategy: str | None = None) -> DataFrame:
    r = V.required_map(claims(spark, sf_dir))
    return r if strategy is None else r.where(F.col("strategy") == strategy).drop("strategy")


# SQL building blocks: each is a list of common table expressions.
_PLACES = ", ".join(f"('{p}')" for p in LAYOUT.bed_names() + STATIONS)
EVENTS = f"""
place_list as (select * from (values {_PLACES}) t(place)),
place_keys as (select {sql_name("place")} as k, min(place) as fuzzy from place_list group by 1),
ev as (
  select seq, event_ts, {sql_kind("subject_kind")} as subject_kind, {sql_id("subject")} as subject,
    regexp_replace(lower(trim(activity)), '[\\s/_-]+', '_', 'g') as activity, location, source,
    case when confidence is null or isnan(confidence) then 1.0 else confidence end as confidence,
    coalesce(p.place, k.fuzzy, 'QUARANTINE:' || location) as place,
    (case when p.place is not null then 1.0 when k.fuzzy is not null then 0.85 else 0.0 end)::double as place_confidence
  from ward_event w left join place_list p on w.location = p.place left join place_keys k on {sql_name("w.location")} = k.k
)"""

RUNS = f"""{EVENTS},
e0 as (
  select seq, event_ts, epoch_us(event_ts) as t, subject, place, coalesce(activity, '') as activity, confidence from ev
  where subject_kind = 'clinician' and confidence >= 0.8 and subject is not null and place is not null and event_ts is not null
),
e1 as (select *, case when lag(place) over w is null or lag(place) over w <> place then 1 else 0 end as moved,
  t - lag(t) over w as pause from e0 window w as (partition by subject order by t, seq)),
e2 as (select *, sum(moved) over (partition by subject order by t, seq) as rid from e1),
e3 as (select *, first_value(activity) over (partition by subject, rid order by t, seq) as fa from e2),
e4 as (select *, sum(case when moved = 1 or (activity = fa and pause > 90000000) then 1 else 0 end) over (partition by subject order by t, seq) as bid from e3),
blocks as (select subject, place, bid, min(t) as a, max(t) as b, count(*) as n, min(confidence) as c from e4 group by all),
e5 as (select *, case when lag(b) over w is null or a - lag(b) over w > 90000000 then 1 else 0 end as far from blocks window w as (partition by subject, place order by bid)),
e6 as (select *, sum(far) over (partition by subject, place order by bid) as sid from e5),
runs as (select subject as clinician, place, min(a) as a, max(b) as b, sum(n)::bigint as n_events, min(c) as confidence from e6 group by subject, place, sid)"""

_BEDS = ", ".join(f"('{p}')" for p in LAYOUT.bed_names())
STAYS = f"""{RUNS},
bed_list as (select * from (values {_BEDS}) t(bed)),
stays as (
  select r.clinician, r.place as bed, make_timestamp(r.a) as start, make_timestamp(r.b) as "end", (r.b - r.a) / 1e6 as dwell_s, r.n_events, r.confidence,
    o.patient, coalesce(list_sort(list_distinct(c.specialties)), []) as specialties
  from runs r join bed_list on r.place = bed_list.bed left join bed_occupancy o on o.bed = r.place left join clinician_roster c on c.clinician = r.clinician
  where r.b - r.a >= 120000000
)"""

_CLASS = r"\s\x{00A0}\x{2000}-\x{200B}\x{202F}\x{2060}\x{3000}\x{FEFF}"


def sql_text(c: str) -> str:
    return f"regexp_replace(lower(regexp_replace({c}, '^[{_CLASS}]+|[{_CLASS}]+$', '', 'g')), '[{_CLASS}_-]+', ' ', 'g')"


RECOGNISED = f"""
spec_names as (select {sql_text("specialty")} as k, min(specialty) as exact from specialty_ref group by 1),
spec_alias as (select {sql_text("a")} as k, min(specialty) as alias from (select unnest(also_known) as a, specialty from specialty_ref) group by 1),
recognised as (
  select e.*, coalesce(n.exact, a.alias) as specialty, (case when n.exact is not null then 1.0 when a.alias is not null then 0.85 else 0.0 end)::double as recognition
  from specialty_evidence e left join spec_names n on {sql_text("e.specialty_text")} = n.k left join spec_alias a on {sql_text("e.specialty_text")} = a.k
)"""

CLAIMS = f"""{RECOGNISED},
idx as (
  select {sql_id("patient")} as patient, specialty, evidence_source, max(recognition) as recognition from recognised
  where recognition >= 0.8 and {sql_id("patient")} is not null group by 1, 2, 3
),
by_source as (
  select patient, specialty, max(recognition) filter (evidence_source = 'referral') as r, max(recognition) filter (evidence_source = 'consult_note') as c,
    max(recognition) filter (evidence_source = 'problem_list') as p from idx group by 1, 2
),
strategies as (select * from (values ('referral'), ('consult_note'), ('problem_list'), ('union'), ('intersection')) t(strategy)),
claims as (
  select patient, specialty, strategy, (coalesce(r, 0) + coalesce(c, 0) + coalesce(p, 0)) / 3.0 as confidence from by_source, strategies
  where case strategy when 'referral' then r is not null when 'consult_note' then c is not null when 'problem_list' then p is not null
    when 'union' then coalesce(r, c, p) is not null else r is not null and c is not null and p is not null end
),
required as (
  select strategy, patient, list_sort(list(distinct specialty)) as required from claims where confidence >= 1.0 / 3 - 1e-12 group by 1, 2
)"""
