"""Queries of process discovery, schedules and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardloom.functions.keys import id_key, sql_id
from wardloom.operators import features as V
from wardloom.operators import geometry as G
from wardloom.operators import ingest as I
from wardloom.operators import petri as N
from wardloom.operators import process as P
from wardloom.operators import retrieval as R
from wardloom.operators import schedule as S
from wardloom.plans import views
from wardloom.plans.views import CLAIMS, EVENTS, LAYOUT
from wardloom.plans.ward import COSTS
from wardloom.session import Query, cut, small_side, table

PROTECTED = list(range(36, 42))
N_SLOTS = 72


# Process logs: a case is a subject, or, where a whole case is gathered, its stay at one place on one day.
def log_of_subjects(spark: SparkSession, d: str) -> DataFrame:
    return I.event_log(views.events(spark, d))


def log_of_stays(spark: SparkSession, d: str) -> DataFrame:
    e = I.event_log(views.events(spark, d).where("place is not null"))
    return e.withColumn("case_id", F.concat_ws("|", "case_id", "resource", F.to_date("event_ts").cast("string")))


def process_log(spark: SparkSession, d: str) -> DataFrame:
    return log_of_subjects(spark, d).groupBy("case_id").agg(F.count("*").alias("n_events"), F.min("event_ts").alias("first_ts"), F.max("event_ts").alias("last_ts"))


def dfg_edges(spark: SparkSession, d: str) -> DataFrame:
    return P.dfg(log_of_subjects(spark, d))


def start_end_activities(spark: SparkSession, d: str) -> DataFrame:
    e = P.dfg(log_of_subjects(spark, d)).where(f"a = '{P.START}' or b = '{P.END}'")
    return e.select(F.when(F.col("a") == P.START, "start").otherwise("end").alias("kind"), F.when(F.col("a") == P.START, F.col("b")).otherwise(F.col("a")).alias("activity"), "n")


def dependency_measure(spark: SparkSession, d: str) -> DataFrame:
    return P.dependency(P.dfg(log_of_subjects(spark, d))).withColumn("dependency", F.round("dependency", 6))


def trace_variants(spark: SparkSession, d: str) -> DataFrame:
    return P.variants(log_of_stays(spark, d)).select(F.array_join("trace", ",").alias("trace"), "n_cases")


def token_replay_cases(spark: SparkSession, d: str) -> DataFrame:
    log = log_of_stays(spark, d)
    arcs = P.discover(cut(P.dfg(log)), "heuristics")
    return P.conformance(log, arcs).withColumn("fitness", F.round("fitness", 6))


def log_fitness(spark: SparkSession, d: str) -> DataFrame:
    log = log_of_stays(spark, d)
    return P.log_fitness(P.conformance(log, P.discover(cut(P.dfg(log)), "heuristics"))).withColumn("fitness", F.round("fitness", 6))


def model_precision(spark: SparkSession, d: str) -> DataFrame:
    edges = cut(P.dfg(log_of_stays(spark, d)))
    return P.precision(edges, P.discover(edges, "heuristics")).withColumn("precision", F.round("precision", 6))


def process_tree(spark: SparkSession, d: str) -> DataFrame:
    edges = cut(P.dfg(log_of_stays(spark, d)))
    rows = [(a, P.process_tree(P.discover(edges, a))) for a in ("inductive", "heuristics")]
    return spark.createDataFrame(rows, "algorithm string, tree string")


def _net(spark: SparkSession, log: DataFrame) -> N.Net:
    return N.net_of_tree(P.mine_tree(P.discover(cut(P.dfg(log))), P.activity_sets(log)))


def petri_net(spark: SparkSession, d: str) -> DataFrame:
    """Transitions of the mined net with their places."""
    rows = [(i, label, list(into), list(out)) for i, (label, into, out) in enumerate(_net(spark, log_of_stays(spark, d)).transitions)]
    return spark.createDataFrame(rows, "transition int, activity string, places_in array<int>, places_out array<int>")


def petri_replay(spark: SparkSession, d: str) -> DataFrame:
    log = log_of_stays(spark, d)
    return N.replay(log, _net(spark, log)).withColumn("fitness", F.round("fitness", 6))


def petri_precision(spark: SparkSession, d: str) -> DataFrame:
    log = log_of_stays(spark, d)
    return N.escaping_precision(log, _net(spark, log)).withColumn("precision", F.round("precision", 6))


# Schedules: what the tables don't hold is made from the numbers of ids (the same in the SQL).
def _number(c: str) -> F.Column:
    return F.regexp_extract(c, "([0-9]+)$", 1).cast("int")


def _visits(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "planned_visit").withColumns({"clinician": id_key("clinician"), "patient": id_key("patient")})
    return S.visits(p)


def _patients(spark: SparkSession, d: str) -> DataFrame:
    return _visits(spark, d).select("patient").distinct().withColumn("k", _number("patient"))


def _beds(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*map(F.lit, LAYOUT.bed_names()))
    return _patients(spark, d).select("patient", F.get(names, F.col("k") % len(LAYOUT.bed_names())).alias("bed"))


def _availability(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "clinician_roster").select("clinician", _number("clinician").alias("k"))
    return r.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(N_SLOTS - 1)))).where("(k + slot) % 9 <> 0").select("clinician", "slot")


def _off(spark: SparkSession, d: str) -> DataFrame:
    return _patients(spark, d).where("k % 5 = 0").select("patient", F.explode(F.array(*map(F.lit, range(20, 24)))).alias("slot"))


def _acuity(spark: SparkSession, d: str) -> DataFrame:
    return _patients(spark, d).where("k % 11 <> 0").select("patient", (F.col("k") % 4 + 1).alias("acuity"))


def _isolated(spark: SparkSession, d: str) -> DataFrame:
    return _patients(spark, d).where("k % 10 = 0").select("patient")


def viol_availability(spark: SparkSession, d: str) -> DataFrame:
    return S.outside_availability(_visits(spark, d), _availability(spark, d))


def viol_offward(spark: SparkSession, d: str) -> DataFrame:
    return S.patient_off_ward(_visits(spark, d), _off(spark, d))


def viol_protected(spark: SparkSession, d: str) -> DataFrame:
    return S.in_protected(_visits(spark, d), PROTECTED)


def viol_acuity(spark: SparkSession, d: str) -> DataFrame:
    return S.acuity_steps_up(_visits(spark, d), _acuity(spark, d))


def viol_isolation(spark: SparkSession, d: str) -> DataFrame:
    return S.isolation_not_last(_visits(spark, d), _isolated(spark, d))


def double_bookings(spark: SparkSession, d: str) -> DataFrame:
    return S.double_bookings(_visits(spark, d))


def travel_time(spark: SparkSession, d: str) -> DataFrame:
    return S.travel_too_short(_visits(spark, d), _beds(spark, d), G.costs(spark, LAYOUT))


def hard_violations(spark: SparkSession, d: str) -> DataFrame:
    parts = {f.__name__: f(spark, d) for f in (viol_availability, viol_offward, viol_acuity, viol_isolation, double_bookings)}
    return S.hard_violations(parts).groupBy("kind", "schedule_id").agg(F.count("*").alias("n"))


def schedule_routes(spark: SparkSession, d: str) -> DataFrame:
    return S.routes(_visits(spark, d)).select("schedule_id", "clinician", "stop_no", "patient", "start_slot", "duration", "next_patient")


def schedule_bedside(spark: SparkSession, d: str) -> DataFrame:
    return S.bedside_specialties(_visits(spark, d), table(spark, d, "clinician_roster")).withColumn("present", F.array_join("present", ","))


def _objectives(spark: SparkSession, d: str) -> DataFrame:
    v = _visits(spark, d)
    p = table(spark, d, "planned_visit").withColumns({"clinician": id_key("clinician"), "patient": id_key("patient")})
    first = p.agg(F.min("plan_day").alias("first_day"))
    previous = S.visits(p.join(F.broadcast(first), F.col("plan_day") == F.col("first_day"))).select("patient", "clinician").distinct()
    return S.quantise(S.objectives(v, table(spark, d, "clinician_roster"), views.required(spark, d, "union"), _beds(spark, d), G.costs(spark, LAYOUT), PROTECTED, previous))


def schedule_objectives(spark: SparkSession, d: str) -> DataFrame:
    return _objectives(spark, d).withColumns({c: F.round(c, 6) for c in ("copresence", "continuity")})


def pareto_front(spark: SparkSession, d: str) -> DataFrame:
    return S.pareto_front(_objectives(spark, d)).withColumns({c: F.round(c, 6) for c in ("copresence", "continuity")})


def front_ranks(spark: SparkSession, d: str) -> DataFrame:
    return S.front_ranks(_objectives(spark, d)).select("schedule_id", "rank")


def crowding(spark: SparkSession, d: str) -> DataFrame:
    return S.sparsities(S.front_ranks(_objectives(spark, d))).withColumn("sparsity", F.round("sparsity", 6))


def payoff_table(spark: SparkSession, d: str) -> DataFrame:
    return S.payoff(_objectives(spark, d)).withColumns({c: F.round(c, 6) for c in ("ideal", "nadir")})


def allowed_starts(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "clinician_roster").where(F.size("specialties") > 0)
    need = views.required(spark, d, "union").where(F.size("required") >= 2)
    got = S.allowed_starts(r, need, _availability(spark, d), _off(spark, d), N_SLOTS, 3, as_rows=False)
    return got.groupBy("patient", "specialty").agg(F.count_distinct("clinician").alias("n_clinicians"), F.sum(F.size("starts")).alias("n_starts"))


# Retrieval.
def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "doc_chunk").select(F.col("id").alias("doc_id"), "path", "start_line", "end_line", "heading_path", "text")


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_item").select(F.col("item_id").alias("query_id"), "query")


def _lexical(spark: SparkSession, d: str) -> DataFrame:
    return R.bm25_scores(_chunks(spark, d), _queries(spark, d), "doc_id", "heading_path", "text", "query_id", "query")


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.top_k(_lexical(spark, d), 10).withColumn("score", F.round("score", 6))


def _dense(spark: SparkSession, d: str, k: int) -> DataFrame:
    chunks = _chunks(spark, d).withColumn("n", F.xxhash64("doc_id"))
    both = chunks.select("n", "text").unionByName(_queries(spark, d).select(F.col("query_id").alias("n"), F.col("query").alias("text")))
    v = cut(R.hashed_vectors(both, "n", "text", 128))
    asked = _queries(spark, d).select(F.col("query_id").alias("n"))
    rows = v.join(F.broadcast(asked), "n", "left_anti")
    got = V.top_neighbours(rows, v.join(F.broadcast(asked), "n", "left_semi"), "n", k, cosine=True)
    return got.join(chunks.select(F.col("n").alias("neighbour"), "doc_id"), "neighbour").select(F.col("query").alias("query_id"), "doc_id", "rank")


def rrf_topk(spark: SparkSession, d: str) -> DataFrame:
    fused = R.rrf_fuse(R.top_k(_lexical(spark, d), R.DEPTH), _dense(spark, d, R.DEPTH))
    return fused.withColumn("score", F.round("score", 9))


def _notes(spark: SparkSession, d: str) -> DataFrame:
    """Documents as chunks of one line."""
    one = F.lit(1)
    return table(spark, d, "documents").select("doc_id", F.concat(F.lit("doc/"), "doc_id").alias("path"), one.alias("start_line"), one.alias("end_line"), F.lit("").alias("heading_path"), "text")


def _relevant(spark: SparkSession, d: str) -> DataFrame:
    """Labels that no ranking has made: the documents into which a stretch of the item's passage has got."""
    grams = lambda c: F.transform(F.filter(F.sequence(F.lit(0), F.greatest(F.size(c) - 8, F.lit(-1))), lambda i: i >= 0), lambda i: F.array_join(F.slice(c, i + 1, 8), " "))
    words = lambda df, key, c: df.where(F.col(c).isNotNull()).select(key, R.tokens(F.col(c)).alias("w")).where(F.size("w") >= 8)
    items = words(table(spark, d, "eval_item"), "item_id", "passage").select(F.col("item_id").alias("query_id"), F.explode(grams(F.col("w"))).alias("g")).distinct()
    notes = words(table(spark, d, "documents"), "doc_id", "text").select("doc_id", F.explode(grams(F.col("w"))).alias("g"))
    one = F.lit(1)
    return notes.join(small_side(items), "g").select("query_id", F.concat(F.lit("doc/"), "doc_id").alias("path"), one.alias("start_line"), one.alias("end_line")).distinct()


def retrieval_eval(spark: SparkSession, d: str) -> DataFrame:
    """Items' queries against the documents, scored by where their passages stand; items that stand nowhere aren't asked."""
    labels = cut(_relevant(spark, d))
    asked = _queries(spark, d).join(labels.select("query_id").distinct(), "query_id", "left_semi")
    ranked = R.top_k(R.bm25_scores(_notes(spark, d), asked, "doc_id", "heading_path", "text", "query_id", "query"), 20)
    s = R.retrieval_scores(ranked, labels, _notes(spark, d), asked)
    return s.withColumns({c: F.round(c, 6) for c in ("recall", "mrr")})


def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id")).alias("path"), F.replace("text", F.lit("\r\n"), F.lit("\n")).alias("text"))
    return R.chunk_texts(x, "path", "text")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        process_log, dfg_edges, start_end_activities, dependency_measure, trace_variants, token_replay_cases, log_fitness, model_precision, process_tree, petri_net, petri_replay, petri_precision, viol_availability,
        viol_offward, viol_protected, viol_acuity, viol_isolation, double_bookings, travel_time, hard_violations, schedule_routes, schedule_bedside, schedule_objectives,
        pareto_front, front_ranks, crowding, payoff_table, allowed_starts, bm25_topk, rrf_topk, retrieval_eval, chunk_documents,
    )
}

_LOG = f"""
with {EVENTS}, log as (
  select subject as case_id, activity, event_ts, seq, place as resource from ev where subject is not null and activity is not null and event_ts is not null
), f as (select case_id, activity as a, coalesce(lead(activity) over w, '{P.END}') as b, lag(activity) over w is null as first from log window w as (partition by case_id order by event_ts, seq)),
dfg as (select a, b, count(*) as n from f group by 1, 2 union all select '{P.START}', a, count(*) from f where first group by a)
"""

#: Replay of stays on the heuristic model of their own log.
_REPLAY = (
    _LOG.rstrip()
    + f""",
slog as (select case_id || '|' || resource || '|' || event_ts::date as case_id, activity, event_ts, seq from log where resource is not null),
sf as (select case_id, activity as a, coalesce(lead(activity) over w, '{P.END}') as b, lag(activity) over w is null as first from slog window w as (partition by case_id order by event_ts, seq)),
sdfg as (select a, b, count(*) as n from sf group by 1, 2 union all select '{P.START}', a, count(*) from sf where first group by a),
dep as (select e.a, e.b, e.n, case when e.a = e.b then e.n / (e.n + 1) else (e.n - coalesce(r.n, 0)) / (e.n + coalesce(r.n, 0) + 1) end as v from sdfg e left join sdfg r on r.a = e.b and r.b = e.a),
arcs as (select distinct a, b from (select a, b from dep where a = '{P.START}' or b = '{P.END}' or v >= 0.5
  union all select a, b from (select *, row_number() over (partition by a order by n desc, b desc) as k from sdfg) where k = 1)),
known as (select a as x from arcs union select b from arcs),
steps as (select case_id, a, b from sf union all select case_id, '{P.START}', a from sf where first),
judged as (select s.*, s.b not in (select x from known) as strange, arcs.a is null as off, s.a in (select a from arcs) as leaves from steps s left join arcs on arcs.a = s.a and arcs.b = s.b),
played as (
  select case_id, count(*)::int as produced, count(*)::int as consumed, (count(*) filter (strange or off))::int as missing,
    count(*) filter (b <> '{P.END}' and (strange or (off and leaves))) as problems from judged group by 1
)
"""
)

_BED_NAMES = "[" + ", ".join(f"'{b}'" for b in LAYOUT.bed_names()) + "]"
_VISITS = f"""
v as (
  select distinct schedule_id, {sql_id("clinician")} as clinician, {sql_id("patient")} as patient, start_slot, duration, start_slot + duration as end_slot
  from planned_visit where start_slot >= 0 and duration >= 1 and {sql_id("clinician")} is not null and {sql_id("patient")} is not null
),
pat as (select distinct patient, regexp_extract(patient, '([0-9]+)$', 1)::int as k from v),
r as (select *, row_number() over w as stop_no, lead(patient) over w as next_patient, lead(start_slot) over w as next_start from v
  window w as (partition by schedule_id, clinician order by start_slot, patient, duration)),
slots as (select *, unnest(range(start_slot, end_slot)) as slot from v),
avail as (select clinician, s::int as slot from clinician_roster, range({N_SLOTS}) t(s) where (regexp_extract(clinician, '([0-9]+)$', 1)::int + s) % 9 <> 0)
"""
_PARTS = {
    "viol_availability": "select schedule_id, clinician, patient, start_slot, slot::int as slot from slots where clinician in (select clinician from avail) and (clinician, slot) not in (select (clinician, slot) from avail)",
    "viol_offward": "select schedule_id, clinician, patient, start_slot, slot::int as slot from slots join pat using (patient) where k % 5 = 0 and slot between 20 and 23",
    "viol_acuity": "select schedule_id, clinician, r.patient, start_slot, next_patient from r join pat p on p.patient = r.patient and p.k % 11 <> 0 join pat q on q.patient = r.next_patient and q.k % 11 <> 0 where q.k % 4 > p.k % 4",
    "viol_isolation": """select schedule_id, clinician, patient, start_slot from (select v.*, k, max((k % 10 = 0)::int) over (partition by schedule_id, clinician
  order by start_slot, v.patient, duration rows between unbounded preceding and 1 preceding) as before from v join pat using (patient)) where k % 10 <> 0 and before = 1""",
    "double_bookings": "select schedule_id, clinician, patient, start_slot, next_patient, next_start from r where next_start < end_slot",
}
_PARTS["viol_availability"] = (
    "select s.schedule_id, s.clinician, s.patient, s.start_slot, s.slot::int as slot from slots s left join avail a on a.clinician = s.clinician and a.slot = s.slot"
    " where a.slot is null and s.clinician in (select clinician from clinician_roster)"
)
_BED_OF = f"beds as (select patient, {_BED_NAMES}[k % {len(LAYOUT.bed_names())} + 1] as bed from pat)"
_LEGS = f"""{COSTS}, {_BED_OF},
legs as (select r.*, metres, seconds from r left join beds a on a.patient = r.patient left join beds b on b.patient = r.next_patient
  left join cost on cost.a = a.bed and cost.b = b.bed where next_patient is not null)"""
_BEDSIDE = """
cs as (select v.*, coalesce(specialties, []) as specialties from v left join clinician_roster using (clinician)),
bounds as (select distinct schedule_id, patient, start_slot as boundary from v),
sets as (select schedule_id, patient, boundary, list_sort(list_distinct(flatten(list(specialties)))) as present from cs join bounds using (schedule_id, patient)
  where boundary >= start_slot and boundary < end_slot group by 1, 2, 3),
bedside as (select schedule_id, patient, arg_max(present, (len(present), -boundary)) as present from sets group by 1, 2)"""
_OBJ = f"""
with {_VISITS.strip()}, {_LEGS}, {_BEDSIDE}, {CLAIMS},
prev as (select distinct patient, clinician from (select {sql_id("patient")} as patient, {sql_id("clinician")} as clinician from planned_visit
  where plan_day = (select min(plan_day) from planned_visit) and start_slot >= 0 and duration >= 1) where patient is not null and clinician is not null),
ma as (select schedule_id, max(end_slot) * 300 as makespan_s from v group by 1),
co as (select schedule_id, avg((len(list_intersect(present, required)) >= 2)::int) as copresence from bedside join required using (patient) where strategy = 'union' and len(required) >= 2 group by 1),
mo as (select schedule_id, sum(metres) as motion_m from legs group by 1),
di as (select schedule_id, count(*) as disruption from v where start_slot < 42 and end_slot > 36 group by 1),
ko as (select schedule_id, count(*) / greatest((select count(*) from prev), 1) as continuity from (select distinct schedule_id, patient, clinician from v) join prev using (patient, clinician) group by 1),
obj as (select schedule_id, coalesce(copresence, 1.0) as copresence, round(coalesce(motion_m, 0.0), 2) as motion_m, coalesce(disruption, 0) as disruption, coalesce(continuity, 0.0) as continuity, makespan_s
  from ma left join co using (schedule_id) left join mo using (schedule_id) left join di using (schedule_id) left join ko using (schedule_id))
"""
#: A schedule's front is the length of the longest chain of schedules that dominate one another above it.
_RANKS = (
    _OBJ.strip().replace("with ", "with recursive ", 1)
    + """,
dom as (select a.schedule_id as a, b.schedule_id as b from obj a, obj b
  where b.copresence >= a.copresence and b.motion_m <= a.motion_m and b.disruption <= a.disruption and b.continuity >= a.continuity and b.makespan_s <= a.makespan_s
  and (b.copresence > a.copresence or b.motion_m < a.motion_m or b.disruption < a.disruption or b.continuity > a.continuity or b.makespan_s < a.makespan_s)),
chain as (select schedule_id, 0 as k from obj union select dom.a, k + 1 from chain join dom on dom.b = chain.schedule_id),
ranks as (select schedule_id, max(k) as rank from chain group by 1)
"""
)
_BM25 = """
with docs as (select id as doc_id, regexp_extract_all(lower(coalesce(heading_path, '') || chr(10) || coalesce(text, '')), '[a-z0-9]+') as t from doc_chunk),
st as (select count(*) as n, avg(len(t)) as avgdl from docs),
q as (select item_id as query_id, term, count(*) as qf from (select item_id, unnest(regexp_extract_all(lower({0}), '[a-z0-9]+')) as term from eval_item) group by 1, 2),
post as (select doc_id, dl, term, count(*) as tf from (select doc_id, len(t) as dl, unnest(t) as term from docs) where term in (select term from q) group by 1, 2, 3),
df as (select term, count(*) as df from post group by 1),
sc as (select query_id, doc_id, sum(qf * greatest(0.0, ln((n - df + 0.5) / (df + 0.5) + 1)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as score
  from q join df using (term) join post using (term), st group by 1, 2),
top as (select query_id, doc_id, score, row_number() over (partition by query_id order by round(score, 9) desc, doc_id)::int as rank from sc)
"""
#: Items and the documents that hold eight consecutive words of their passage.
_LABELS = """
with i as (select item_id, regexp_extract_all(lower(passage), '[a-z0-9]+') as w from eval_item where passage is not null),
d as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as w from documents where text is not null),
ig as (select distinct item_id, array_to_string(w[p:p + 7], ' ') as g from i, lateral (select unnest(range(1, len(w) - 6)) as p)),
dg as (select doc_id, array_to_string(w[p:p + 7], ' ') as g from d, lateral (select unnest(range(1, len(w) - 6)) as p))
select distinct item_id, doc_id from ig join dg using (g)
"""

SQL: dict[str, str] = {
    "process_log": _LOG + "select case_id, count(*) as n_events, min(event_ts) as first_ts, max(event_ts) as last_ts from log group by 1",
    "dfg_edges": _LOG + "select * from dfg",
    "start_end_activities": _LOG + f"select case when a = '{P.START}' then 'start' else 'end' end as kind, case when a = '{P.START}' then b else a end as activity, n from dfg where a = '{P.START}' or b = '{P.END}'",
    "dependency_measure": _LOG.rstrip()
    + f""", e as (select * from dfg where a <> '{P.START}' and b <> '{P.END}')
select e.a, e.b, e.n, round(case when e.a = e.b then e.n / (e.n + 1) else (e.n - coalesce(r.n, 0)) / (e.n + coalesce(r.n, 0) + 1) end, 6)::double as dependency
from e left join e r on r.a = e.b and r.b = e.a""",
    "trace_variants": _LOG
    + """select trace, count(*) as n_cases from (select string_agg(activity, ',' order by event_ts, seq) as trace from log where resource is not null
  group by case_id, resource, event_ts::date) group by 1""",
    **{k: f"with {_VISITS.strip()} {s}" for k, s in _PARTS.items()},
    "viol_protected": f"with {_VISITS.strip()} select schedule_id, clinician, patient, start_slot from v where start_slot < 42 and end_slot > 36",
    "hard_violations": f"with {_VISITS.strip()} select kind, schedule_id, count(*) as n from ("
    + " union all ".join(f"select '{k}' as kind, schedule_id from ({s})" for k, s in _PARTS.items())
    + ") group by 1, 2",
    "travel_time": f"with {_VISITS.strip()}, {_LEGS} select schedule_id, clinician, patient, start_slot, next_patient, next_start from legs where next_start < end_slot + coalesce(ceil(seconds / 300), 0)",
    "schedule_routes": f"with {_VISITS.strip()} select schedule_id, clinician, stop_no::int as stop_no, patient, start_slot, duration, next_patient from r",
    "schedule_bedside": f"with {_VISITS.strip()}, {_BEDSIDE} select schedule_id, patient, array_to_string(present, ',') as present from bedside",
    "schedule_objectives": _OBJ + "select schedule_id, round(copresence, 6) as copresence, motion_m, disruption, round(continuity, 6) as continuity, makespan_s from obj",
    "pareto_front": _OBJ.rstrip()
    + """, d as (select min(schedule_id) as schedule_id, copresence, motion_m, disruption, continuity, makespan_s from obj group by 2, 3, 4, 5, 6)
select schedule_id, round(copresence, 6) as copresence, motion_m, disruption, round(continuity, 6) as continuity, makespan_s from d where not exists (
  select 1 from d b where b.copresence >= d.copresence and b.motion_m <= d.motion_m and b.disruption <= d.disruption and b.continuity >= d.continuity and b.makespan_s <= d.makespan_s
  and (b.copresence > d.copresence or b.motion_m < d.motion_m or b.disruption < d.disruption or b.continuity > d.continuity or b.makespan_s < d.makespan_s))""",
    "payoff_table": _OBJ
    + """select 'copresence' as objective, round(max(copresence), 6) as ideal, round(min(copresence), 6) as nadir from obj union all select 'motion_m', min(motion_m), max(motion_m) from obj
union all select 'disruption', min(disruption), max(disruption) from obj union all select 'continuity', round(max(continuity), 6), round(min(continuity), 6) from obj
union all select 'makespan_s', min(makespan_s), max(makespan_s) from obj""",
    "allowed_starts": f"""with {_VISITS.strip()}, {CLAIMS},
h as (select distinct clinician, unnest(specialties) as specialty from clinician_roster),
need as (select patient, unnest(required) as specialty from required where strategy = 'union' and len(required) >= 2),
st as (select s::int as s from range({N_SLOTS - 2}) t(s)),
free as (select a.clinician, st.s from st join avail a on a.slot between st.s and st.s + 2 group by 1, 2 having count(*) = 3),
ok as (select need.patient, need.specialty, h.clinician, free.s from need join h using (specialty) join free using (clinician) left join pat p on p.patient = need.patient
  where not (p.k is not null and p.k % 5 = 0 and free.s <= 23 and free.s + 2 >= 20))
select patient, specialty, count(distinct clinician) as n_clinicians, count(*) as n_starts from ok group by 1, 2""",
    "bm25_topk": _BM25.format("query") + "select query_id, doc_id, round(score, 6) as score, rank from top where rank <= 10",
    "retrieval_eval": "with lab as ("
    + _LABELS
    + "), lex as ("
    + _BM25.format("query").replace("select id as doc_id, regexp_extract_all(lower(coalesce(heading_path, '')", "select doc_id, regexp_extract_all(lower(''").replace("from doc_chunk)", "from documents)").replace(
        "from eval_item)", "from eval_item where item_id in (select item_id from lab))"
    )
    + """select * from top where rank <= 20),
best as (select query_id, min(rank) as best from lex join lab on lab.item_id = query_id and lab.doc_id = lex.doc_id group by 1)
select count(*) as n_queries, round(avg((coalesce(best, 21) <= 5)::int), 6) as recall, round(avg(coalesce(1.0 / best, 0.0)), 6) as mrr
from (select distinct item_id as query_id from lab) left join best using (query_id)""",
    "token_replay_cases": _REPLAY
    + """select case_id, produced, consumed, missing, missing as remaining, round(0.5 * (1 - missing / consumed) + 0.5 * (1 - missing / produced), 6)::double as fitness,
  case when problems > 0 then 'deviating' when missing > 0 then 'missing-data' else 'clean' end as bucket from played""",
    "log_fitness": _REPLAY
    + """select count(*) as n_cases, count(*) filter (problems > 0) as n_deviating, count(*) filter (problems = 0 and missing > 0) as n_missing_data,
  round(0.5 * (1 - sum(missing) / sum(consumed)) + 0.5 * (1 - sum(missing) / sum(produced)), 6)::double as fitness from played""",
    "model_precision": _REPLAY
    + """select round(1 - sum(w * (n_allowed - n_seen)) / sum(w * n_allowed), 6)::double as precision from
(select a, count(*) as n_allowed from arcs group by 1) join (select a, count(*) as n_seen, sum(n) as w from sdfg where (a, b) in (select (a, b) from arcs) group by 1) using (a)""",
    "front_ranks": _RANKS + "select * from ranks",
    "crowding": _RANKS
    + "select schedule_id, rank, case when n <= 2 then 'infinity'::double else round("
    + " + ".join(
        f"case when max({c}) over p = min({c}) over p then 0.0 when lag({c}) over w{i} is null or lead({c}) over w{i} is null then 'infinity'::double"
        f" else (lead({c}) over w{i} - lag({c}) over w{i})::double / (max({c}) over p - min({c}) over p) end"
        for i, c in enumerate(S.SENSES)
    )
    + ", 6) end as sparsity from (select *, count(*) over (partition by rank) as n from ranks join obj using (schedule_id)) window p as (partition by rank), "
    + ", ".join(f"w{i} as (partition by rank order by {c}, schedule_id)" for i, c in enumerate(S.SENSES)),
}
