"""Queries of the core data operators: parse failures (p3), busy periods (p5), sessions (p7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardloom.functions.keys import id_key, sql_id, sql_kind
from wardloom.operators.intervals import periods_and_gaps
from wardloom.operators.sessions import sessionise
from wardloom.session import Query, table
from wardloom.sources.event_lines import parse_event_lines


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_event_lines(table(spark, sf_dir, "raw_event_line")).where("reason is not null").select("line_id", "reason")


def p3_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = parse_event_lines(table(spark, sf_dir, "raw_event_line"))
    return got.where("reason is null").drop("reason", "failing_cell")


def _busy(spark: SparkSession, sf_dir: str) -> DataFrame:
    visits = table(spark, sf_dir, "planned_visit").where("start_slot >= 0 and duration >= 1")
    visits = visits.select("schedule_id", id_key("clinician").alias("clinician"), "start_slot", "duration").where("clinician is not null")
    spans = periods_and_gaps(visits, ["schedule_id", "clinician"], "start_slot", "duration")
    return spans.select(
        "span_kind", "schedule_id", "clinician", F.col("from_unit").cast("int").alias("from_slot"), F.col("to_unit").cast("int").alias("to_slot")
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _busy(spark, sf_dir)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessionise(table(spark, sf_dir, "ward_event")).select("first_seq", "n_events")


def p7_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sessionise(table(spark, sf_dir, "ward_event"))
    return s.withColumn("duration_s", F.round("duration_s", 6))


QUERIES: dict[str, Query] = {
    "p3_found": p3_found,
    "p3_loaded": p3_loaded,
    "p5_found": p5_found,
    "p7_found": p7_found,
    "p7_sessions": p7_sessions,
}

_SESSIONS = f"""
with e as (
  select {sql_kind("subject_kind")} as kind, {sql_id("subject")} as subject, event_ts as t, seq from ward_event
), o as (
  select *, case when t - lag(t) over w <= interval 1800 second then 0 else 1 end as fresh
  from e where subject is not null and t is not null window w as (partition by kind, subject order by t, seq)
), g as (
  select *, sum(fresh) over (partition by kind, subject order by t, seq) as g from o
)
select kind, subject, arg_min(seq, (t, seq)) as first_seq, min(t) as session_start, max(t) as session_end,
  round(epoch_us(max(t)) / 1e6 - epoch_us(min(t)) / 1e6, 6) as duration_s, count(*) as n_events
from g group by kind, subject, g
"""

_FIELD = '(?:"(?:[^"]|"")*"|[^",]*)'
#: One pass of SQL text over the same records: fields by regular expression, checks in order.
_LINES = f"""
with r as (
  select line_id, regexp_replace(coalesce(raw_line, ''), '\\r?\\n$', '') as raw from raw_event_line
), q as (
  select line_id, raw, regexp_full_match(raw, '{_FIELD}(,{_FIELD})*', 's') as well,
    regexp_replace(raw, '"(?:[^"]|"")*"', '', 'gs') as bare from r
), c as (
  select *, length(bare) - length(replace(bare, ',', '')) + 1 as n, regexp_matches(bare, '[\\r\\n]') as torn from q
), f as (
  select *, case when well and not torn and n = 7 then list_transform(
    regexp_extract_all(',' || raw, ',({_FIELD})', 1, 's'),
    lambda x: case when starts_with(x, '"') then replace(x[2:-2], '""', '"') else x end) end as v from c
), g as (
  select *, v[1] as ts, lower(trim(v[2], E' \\t\\r\\n')) as kind, trim(v[7], E' \\t\\r\\n') as conf,
    regexp_full_match(v[1], '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[T ][0-9]{{2}}:[0-9]{{2}}(:[0-9]{{2}}(\\.[0-9]{{1,6}})?)?(Z|[+-][0-9]{{2}}:[0-9]{{2}})?') as shaped
  from f
), h as (
  select *, coalesce(shaped and try_cast(ts[1:10] as date) is not null and try_cast(ts[12:13] as int) <= 23 and try_cast(ts[15:16] as int) <= 59
    and (ts[17:17] <> ':' or try_cast(ts[18:19] as int) <= 59)
    and (not regexp_matches(ts, '[+-][0-9]{{2}}:[0-9]{{2}}$') or (try_cast(ts[-5:-4] as int) <= 23 and try_cast(ts[-2:] as int) <= 59)), false) as good_ts,
    v[7] = '' or coalesce(regexp_full_match(conf, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?')
      and try_cast(conf as double) between 0 and 1, false) as good_conf
  from g
), x as (
  select *, case when not well then 'broken_quoting' when torn or n <> 7 then 'column_count'
    when not good_ts then 'invalid_timestamp' when kind not in ('clinician', 'patient') then 'invalid_subject_kind'
    when not good_conf then 'invalid_confidence' end as reason from h
)
"""

SQL: dict[str, str] = {
    "p3_found": _LINES + "select line_id, reason from x where reason is not null",
    "p3_loaded": _LINES
    + """
select line_id,
  (ts[1:10] || ' ' || ts[12:16] || coalesce(nullif(regexp_extract(ts, '^.{16}(:[0-9]{2}(\\.[0-9]+)?)', 1), ''), ':00'))::timestamp
    - to_minutes(coalesce(case when regexp_matches(ts, '[+-][0-9]{2}:[0-9]{2}$')
        then (case when ts[-6:-6] = '-' then -1 else 1 end) * (try_cast(ts[-5:-4] as int) * 60 + try_cast(ts[-2:] as int)) end, 0)) as event_ts,
  kind as subject_kind, nullif(v[3], '') as subject, nullif(v[4], '') as activity, nullif(v[5], '') as location,
  nullif(v[6], '') as source, case when v[7] = '' then 1.0 else conf::double end as confidence
from x where reason is null""",
    "p5_found": f"""
with v as (
  select schedule_id, {sql_id("clinician")} as clinician, start_slot as a, start_slot + duration as b
  from planned_visit where start_slot >= 0 and duration >= 1
), m as (
  select *, max(b) over (partition by schedule_id, clinician order by a, b rows between unbounded preceding and 1 preceding) as reach
  from v where clinician is not null
), g as (
  select *, sum(case when a <= reach then 0 else 1 end) over (partition by schedule_id, clinician order by a, b rows unbounded preceding) as g from m
), p as (
  select schedule_id, clinician, g, min(a) as a, max(b) as b from g group by schedule_id, clinician, g
), n as (
  select *, lag(b) over (partition by schedule_id, clinician order by a) as before from p
)
select 'period' as span_kind, schedule_id, clinician, a as from_slot, b as to_slot from p
union all select 'gap', schedule_id, clinician, before, a from n where before is not null""",
    "p7_found": f"select first_seq, n_events from ({_SESSIONS})",
    "p7_sessions": _SESSIONS,
}
