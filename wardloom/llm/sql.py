"""The same results in SQL for DuckDB, where SQL can express them over whole tables."""

from __future__ import annotations

from wardloom.functions.keys import sql_id, sql_kind, sql_name

_RUNS = f"""
with e as (
  select {sql_kind("subject_kind")} as kind, {sql_id("subject")} as subject, event_ts as t, seq,
    {sql_name("activity")} as activity, {sql_name("location")} as place from ward_event
), o as (
  select *, case when t - lag(t) over w <= interval 90 second and activity = lag(activity) over w and place = lag(place) over w
    then 0 else 1 end as fresh
  from e where subject is not null and t is not null window w as (partition by kind, subject order by t, seq)
), g as (
  select *, sum(fresh) over (partition by kind, subject order by t, seq) as g from o
), r as (
  select kind, subject, arg_min(seq, (t, seq)) as first_seq, min(t) as run_start, max(t) as run_end,
    round((epoch_us(max(t)) - epoch_us(min(t))) / 1e6, 6) as duration_s, count(*) as n_events, any_value(activity) as activity, any_value(place) as place
  from g group by kind, subject, g
)
"""

_NEAREST = f"""
with c as (
  select chart_id, charted_at as t, {sql_id("subject")} as subject, {sql_name("location")} as place from chart_event
), w as (
  select seq, event_ts as u, {sql_id("subject")} as subject, {sql_name("location")} as place from ward_event
  where {sql_kind("subject_kind")} = 'clinician'
), j as (
  select chart_id, seq, epoch_us(u) - epoch_us(t) as d from c join w
  on c.subject = w.subject and c.place = w.place and u between t - interval 120 second and t + interval 120 second
)
select chart_id, seq, d from j qualify row_number() over (partition by chart_id order by abs(d), d, seq) = 1
"""

def _plain(c: str) -> str:
    t = f"replace(strip_accents(lower({c})), 'ß', 'ss')"
    for _ in range(2):  # matches may not overlap, so neighbours need a second pass
        t = f"regexp_replace({t}, '(\\p{{L}})[''’](\\p{{L}})', '\\1\\2', 'g')"
    for _ in range(2):
        t = f"regexp_replace({t}, '([0-9])[.,]([0-9])', '\\1\\2', 'g')"
    return f"regexp_extract_all({t}, '[\\p{{L}}\\p{{N}}]+')"


_DENSE = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]"

#: Stretches as joined grams: an independent way to the same pairs. Passages by words and by characters.
_LEAKS = f"""
with dw as (select doc_id, row_number() over () as copy, {_plain("text")} as w from documents where text is not null),
du as (select doc_id, copy, false as dense, w as u from dw union all select doc_id, copy, true, string_split(array_to_string(w, ''), '') from dw where regexp_matches(array_to_string(w, ''), '{_DENSE}')),
iw as (select item_id, {_plain("passage")} as w from eval_item where passage is not null),
ix as (select item_id, w, 2 * len(regexp_extract_all(array_to_string(w, ''), '{_DENSE}')) > length(array_to_string(w, '')) as dense from iw where len(w) > 0),
iu as (select item_id, dense, case when dense then string_split(array_to_string(w, ''), '') else w end as u, case when dense then 12 else 8 end as most from ix),
il as (select *, least(most, len(u)) as m from iu),
ig as (select item_id, dense, m, len(u) as n, p, array_to_string(u[p:p + m - 1], ' ') as gram from il, lateral (select unnest(range(1, len(u) - m + 2)) as p)),
lens as (select distinct dense, m from il),
dg as (select doc_id, copy, dense, m, array_to_string(u[p:p + m - 1], ' ') as gram from du join lens using (dense), lateral (select unnest(range(1, len(u) - m + 2)) as p)),
hit as (select distinct item_id, doc_id, copy, n, m, p from ig join dg using (dense, m, gram)),
cover as (select item_id, doc_id, copy, n, count(distinct q) as k from hit, lateral (select unnest(range(p, p + m)) as q) group by 1, 2, 3, 4)
"""

SQL: dict[str, str] = {
    "p1_found": _RUNS + "select first_seq, n_events from r where n_events >= 2 and activity is not null and place is not null",
    "p1_runs": _RUNS + "select * from r",
    "p2_found": f"select chart_id, seq from ({_NEAREST})",
    "p2_lags": f"select chart_id, seq, round(d / 1e6, 6) as lag_s from ({_NEAREST})",
    "p4_found": "select id from doc_chunk where len(regexp_extract_all(text, '[^ \\t\\r\\n]+')) > 400",
    "p4_restored": "select id, coalesce(len(regexp_extract_all(text, '[^ \\t\\r\\n]+')), 0)::bigint as n_tokens, true as within, md5(text) as text_md5 from doc_chunk",
    "p8_found": _LEAKS + "select item_id, doc_id from cover where 2 * k >= n",
    "p8_stretches": _LEAKS + "select item_id, doc_id, k as found, n as length, k = n as whole from cover",
    "p8_documents": _LEAKS
    + """select doc_id, count(*) as n_items,
  '[' || string_agg('{"item_id":' || item_id || ',"share":' || round(k / n, 4)::double || '}', ',' order by item_id) || ']' as items
from cover where 2 * k >= n group by doc_id""",
}
