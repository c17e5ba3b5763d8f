"""Bounds, motion, coverage, vectors."""

import itertools
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardloom.functions.bounds import BoundUnavailable, necessary, one_tree_bound, open_walk, spanning_tree
from wardloom.functions.draws import draw, draw_of
from wardloom.operators import coverage as C
from wardloom.operators import features as V
from wardloom.operators import geometry as G
from wardloom.operators import motion as M
from wardloom.operators.evidence import STRATEGIES
from wardloom.operators.suppression import SuppressionFloor
from wardloom.plans import analytics as A
from wardloom.sources import synthetic

T0 = datetime(2026, 1, 5, 8)
EP = "clinician string, bed string, patient string, start timestamp_ntz, end timestamp_ntz, specialties array<string>, dwell_s double, confidence double"


def ep(c, bed, patient, minute, dwell=10, spec=(), day=0, conf=1.0):
    a = T0 + timedelta(days=day, minutes=minute)
    return (c, bed, patient, a, a + timedelta(minutes=dwell), sorted(spec), dwell * 60.0, conf)


def matrix(layout, beds):
    return np.array([[layout.quickest(a)[b][1] for b in beds] for a in beds])


def walk(d):
    n = len(d)
    return min((sum(d[a, b] for a, b in itertools.pairwise(p)) for p in itertools.permutations(range(n))), default=0.0)


def test_exact_walk_equals_permutations_and_bounds_stay_below():
    layout, rng = G.Layout(), random.Random(1)
    pool = rng.sample(layout.bed_names(), 7)
    for n in (0, 1, 2, 3, 5, 7):
        d = matrix(layout, pool[:n])
        best = walk(d) if n > 1 else 0.0
        assert abs(open_walk(d) - best) < 1e-9
        if n > 1:
            assert spanning_tree(d)[0] <= best + 1e-9
            assert one_tree_bound(d) <= best + 1e-9
    pts = np.random.default_rng(2).random((40, 2))
    d = np.hypot(*(pts[:, None] - pts[None]).transpose(2, 0, 1))
    value, how = necessary(d)
    assert how == "bound" and spanning_tree(d)[0] <= value <= sum(d[i, i + 1] for i in range(39))
    with pytest.raises(BoundUnavailable):
        necessary(np.zeros((257, 257)))


def test_draws_agree(spark):
    got = spark.range(50).select(draw(9, F.col("id"), F.col("id") * 3).alias("d")).collect()
    assert [r.d for r in got] == [draw_of(9, i, 3 * i) for i in range(50)]


def rounds(n_days=4, confidence=1.0):
    rng, rows = random.Random(5), []
    beds = G.Layout().bed_names()
    for day in range(n_days):
        for c in range(4):
            at = 0
            for _ in range(6):
                dwell = rng.choice([1, 2, 3, 5, 9])
                b = rng.choice(beds[:20])
                rows.append(ep(f"C{c}", b, "P" + b, at, dwell, (), day, confidence))
                at += dwell + 5
    return rows


def test_motion_report(spark):
    layout = G.Layout()
    cost = G.costs(spark, layout)
    df = spark.createDataFrame(rounds(), EP)
    params = M.MotionParams(n_replicates=60)
    r = M.motion_report(df, layout, cost, params).first()
    assert 0 < r.necessary_m <= r.observed_m and abs(r.attributable_m - (r.observed_m - r.necessary_m)) < 1e-9
    assert r.ci_low < r.ci_high
    assert M.motion_report(df.repartition(9), layout, cost, params).first() == r
    by_hand = 0.0
    for day in range(4):
        for c in range(4):
            stops = [x for x in rounds() if x[0] == f"C{c}" and (x[3] - T0).days == day and x[6] >= 120]
            by_hand += sum(layout.quickest(a[1])[b[1]][1] for a, b in itertools.pairwise(sorted(stops, key=lambda x: x[3])))
    assert abs(by_hand - r.observed_m) < 1e-6
    assert M.confidence_kept(spark.createDataFrame(rounds(confidence=0.5), EP), params, 1).count() < df.count()


def test_motion_replicates_draw_the_stops_kept(spark):
    layout = G.Layout()
    cost = G.costs(spark, layout)
    df = spark.createDataFrame(rounds(confidence=0.5), EP).cache()
    params = M.MotionParams(n_replicates=2)
    assert params.model_confidence and M.MotionParams().model_confidence
    got = {r.replicate: r for r in M.motion_replicates(df, layout, cost, params).collect()}
    wards = {(r.clinician, r.day): r.ward for r in M.modal_ward(df).collect()}
    units = sorted({(day, w) for (_, day), w in wards.items()})
    for r in range(2):
        least, o, n = params.dwell_values[draw_of(params.seed, r) % 4], 0.0, 0.0
        for k in range(1, len(units) + 1):
            unit = units[draw_of(params.seed + 1, r, k) % len(units)]
            walks = {}
            for s in sorted(M.confidence_kept(df, params, r, k).where(F.col("dwell_s") >= least).collect(), key=lambda s: (s.start, s.bed)):
                if (s.day, wards[s.clinician, s.day]) == unit:
                    walks.setdefault((s.clinician, s.day), []).append(s.bed)
            for beds in walks.values():
                o += sum(layout.quickest(a)[b][1] for a, b in itertools.pairwise(beds))
                n += necessary(matrix(layout, sorted(set(beds))))[0]
        assert abs(got[r].observed_m - o) < 1e-6 and abs(got[r].necessary_m - n) < 1e-6
    sure = M.MotionParams(n_replicates=40, model_confidence=False)
    mean = lambda p: M.motion_replicates(df, layout, cost, p).agg(F.avg("observed_m")).first()[0]
    assert mean(M.MotionParams(n_replicates=40)) < 0.8 * mean(sure)
    certain = spark.createDataFrame(rounds(), EP)
    a = {r.replicate: r for r in M.motion_replicates(certain, layout, cost, M.MotionParams(n_replicates=20)).collect()}
    for b in M.motion_replicates(certain, layout, cost, M.MotionParams(n_replicates=20, model_confidence=False)).collect():
        assert abs(a[b.replicate].observed_m - b.observed_m) < 1e-6 and abs(a[b.replicate].necessary_m - b.necessary_m) < 1e-6


def test_motion_refusals(spark):
    layout = G.Layout()
    cost = G.costs(spark, layout)
    with pytest.raises(SuppressionFloor):
        M.motion_report(spark.createDataFrame([ep("C", "1A/BED0", "p", 0)], EP), layout, cost)
    with pytest.raises(SuppressionFloor):
        M.motion_report(spark.createDataFrame([*rounds(), ep("C0", "1A/BED0", None, 500)], EP), layout, cost)
    with pytest.raises(M.InsufficientEvidence):
        one_day = [ep(f"C{i % 2}", f"1A/BED{i}", f"P{i}", i * 20) for i in range(6)]
        M.motion_report(spark.createDataFrame(one_day, EP), layout, cost)


def test_modal_ward_tie_takes_the_larger(spark):
    df = spark.createDataFrame([ep("C", "1A/BED0", "p", 0), ep("C", "1B/BED0", "q", 60)], EP)
    assert M.modal_ward(df).first().ward == "1B"


def covered_days():
    rows = []
    for day in range(3):
        for p in range(10):
            bed = f"1A/BED{p}"
            rows.append(ep("C1", bed, f"P{day}_{p}", p * 60, 10, ["cardiology"], day))
            if p < 6:
                rows.append(ep("C2", bed, f"P{day}_{p}", p * 60 + 5, 10, ["nephrology"], day))
            else:
                rows.append(ep("C3", bed, f"P{day}_{p}", p * 60 + 30, 10, ["nephrology"], day))
    return rows


def test_coverage_fixture(spark):
    need = spark.createDataFrame([(s, f"P{d}_{p}", ["cardiology", "nephrology"]) for s in STRATEGIES for d in range(3) for p in range(10)], "strategy string, patient string, required array<string>")
    units = C.coverage_units(spark.createDataFrame(covered_days(), EP), need)
    r = {x.strategy: x for x in C.coverage_by_strategy(units, 50).collect()}["union"]
    assert (r.n, r.k) == (30, 18) and abs(r.coverage - 0.6) < 1e-12 and r.ci_low < 0.6 < r.ci_high
    cells = C.coverage_cells(units).where("strategy = 'union'").collect()
    assert len(cells) == 3 and all(not c.suppressed and c.n_covered == 6 for c in cells)
    few = C.coverage_cells(units, min_patients=11).where("strategy = 'union'").collect()
    assert all(c.suppressed and c.n_patients is None and c.coverage is None for c in few)
    with pytest.raises(C.InsufficientCoverage):
        C.coverage_bootstrap(units.limit(1))
    nobody = C.coverage_by_strategy(C.coverage_units(spark.createDataFrame(covered_days(), EP), need.limit(0)), 20).collect()
    assert all(x.refused == "nobody needs two specialties" and x.coverage is None for x in nobody)


def many_units(spark, n):
    """Ward-days of which some have nobody, nobody covered, everybody covered; most are in between."""
    rows = [(T0.date() + timedelta(days=i // 2), f"1{'AB'[i % 2]}", s, i % 5, min(i % 5, (i // 5 + j) % 4)) for i in range(n) for j, s in enumerate(("union", "referral"))]
    return rows, spark.createDataFrame(rows, "day date, ward string, strategy string, n_patients bigint, n_covered bigint")


@pytest.mark.parametrize("broadcast", [True, False])
def test_bootstrap_of_thousands_of_ward_days(spark, monkeypatch, broadcast):
    """Draw numbers beyond 2147 times STRIDE need 64 bits, and the draws are never the broadcast side."""
    if not broadcast:
        monkeypatch.setattr(C, "BROADCAST_UNITS", 0)
    n, reps = 2300, 3
    rows, units = many_units(spark, n)
    by = {(s, i // 2): (rows[i][3], rows[i][4]) for i, s in enumerate(r[2] for r in rows)}
    want = {}
    for r in range(reps):
        chosen = [draw_of(7, r, k) % n for k in range(1, n + 1)]
        for s in ("union", "referral"):
            total = sum(by[s, u][0] for u in chosen)
            hits = sum(draw_of(8, r, k * C.STRIDE + p) % by[s, u][0] < by[s, u][1] for k, u in enumerate(chosen, 1) for p in range(1, by[s, u][0] + 1))
            want[s, r] = hits / total
    df = C.coverage_bootstrap(units, reps)
    got = df.collect()
    assert {(r.strategy, r.replicate): r.coverage for r in got} == want and len(got) == len(want)
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    join = next(x for x in plan.splitlines() if "Join [unit#" in x)
    assert ("BroadcastHashJoin" in join and "BuildRight" in join) if broadcast else "SortMergeJoin" in join


def test_coverage_by_strategy_over_thousands_of_ward_days(spark):
    rows, units = many_units(spark, 2300)
    got = {r.strategy: r for r in C.coverage_by_strategy(units, 20).collect()}
    for s in ("union", "referral"):
        n, k = (sum(r[i] for r in rows if r[2] == s) for i in (3, 4))
        r = got[s]
        assert (r.n, r.k, r.n_ward_days, r.refused) == (n, k, 2300, None) and r.ci_low < r.coverage == k / n < r.ci_high


def test_replicates_of_the_queries(spark, monkeypatch):
    need = spark.createDataFrame([(s, f"P{d}_{p}", ["cardiology", "nephrology"]) for s in STRATEGIES for d in range(3) for p in range(10)], "strategy string, patient string, required array<string>")
    units = C.coverage_units(spark.createDataFrame(covered_days(), EP), need)
    monkeypatch.setattr(A, "_units", lambda spark, d: units)
    assert A.coverage_bootstrap(spark, "").groupBy("strategy").count().select("count").distinct().collect() == [(1000,)]
    got = {r.strategy: r for r in A.coverage_by_strategy(spark, "").collect()}["union"]
    want = {r.strategy: r for r in C.coverage_by_strategy(units, 1000).collect()}["union"]
    assert abs(got.ci_low - want.ci_low) < 1e-6 and abs(got.ci_high - want.ci_high) < 1e-6
    assert A.REPORT_PARAMS == M.MotionParams() and M.MotionParams().n_replicates == 500


def test_wilson(spark):
    df = spark.createDataFrame([(14, 24), (17, 32), (6, 16), (0, 0), (5, 5)], "k int, n int")
    low, high = C.wilson(F.col("k"), F.col("n"))
    got = [(r.a and round(r.a, 5), r.b and round(r.b, 5)) for r in df.select(low.alias("a"), high.alias("b")).collect()]
    assert got[:3] == [(0.38835, 0.75532), (0.36450, 0.69131), (0.18481, 0.61359)]
    assert got[3] == (None, None) or got[3] == (0.0, 1.0)
    assert got[4][1] == 1.0


def test_features_of_one_ward_day(spark):
    rows = [ep("C", "1A/BED0", "p", 0, 10, ["s"]), ep("C", "1A/BED3", "q", 20, 30, ["s"]), ep("C", "1A/BED0", "p", 240, 20, ["s"]), ep("D", "1A/BED1", None, 5, 10, ["t"])]
    layout = G.Layout()
    f = V.ward_day_features(spark.createDataFrame(rows, EP), layout, G.costs(spark, layout), None).first()
    assert (f.n_episodes, f.n_clinicians, f.n_patients, f.n_specialties, f.bed_revisits, f.floor_transitions) == (4, 2, 2, 2, 1, 0)
    assert f.median_dwell_s == 900 and f.span_s == 260 * 60 and f.protected_episodes == 1 and not f.moments_known
    assert abs(f.motion_m - 2 * 5.9464) < 1e-3 and f.median_gap_s == (10 * 60 + 190 * 60) / 2


def test_standardise_and_kmeans(spark):
    rows = [(i, float(i % 3) * 10 + (i % 7) * 0.01, 5.0) for i in range(300)]
    df = V.standardise(spark.createDataFrame(rows, "id long, a double, b double"), ("a", "b"))
    s = df.agg(F.avg("a"), F.stddev_pop("a"), F.max("b")).first()
    assert abs(s[0]) < 1e-9 and abs(s[1] - 1) < 1e-9 and s[2] == 0
    x = V.vectors(df, ("a", "b"))
    labels, centres = V.kmeans(x, ["id"], 3)
    assert len(centres) == 3
    joined = labels.withColumn("truth", F.col("id") % 3)
    assert abs(V.adjusted_rand(joined, "label", "truth").first().ari - 1) < 1e-12
    again, _ = V.kmeans(x.repartition(5), ["id"], 3)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, labels.collect()))
    with pytest.raises(V.InsufficientWardDays):
        V.kmeans(x.limit(10), ["id"], 3)


def test_embeddings_are_clustered_until_nothing_changes(spark, monkeypatch):
    v = np.random.default_rng(32).exponential(size=(400, 2)).astype("float32").astype(float)
    df = spark.createDataFrame([(i, x.tolist(), i % 3) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int").repartition(2).cache()
    monkeypatch.setattr(A, "table", lambda *_: df)
    label = np.array([r.label for r in A.kmeans_embeddings(spark, "").orderBy("vec_id").collect()])
    means = np.array([v[label == i].mean(0) for i in range(10)])
    assert (((v[:, None] - means[None]) ** 2).sum(2).round(9).argmin(1) == label).all()
    truth = spark.createDataFrame([(int(a), i % 3) for i, a in enumerate(label)], "label int, truth int")
    assert A.ari_embeddings(spark, "").first().ari == round(V.adjusted_rand(truth, "label", "truth").first().ari, 6)


def test_adjusted_rand(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (0, 1), (1, 1), (1, 1), (1, 2)], "a int, b int")
    assert abs(V.adjusted_rand(df, "a", "b").first().ari - 2 / 17) < 1e-6
    assert V.adjusted_rand(df.withColumn("b", F.lit(1)), "a", "b").first().ari == 0.0


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    m = rng.integers(0, 4, (200, 3)).astype(float)
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(m)] + [(999, None)], "id long, v array<double>")
    got = {}
    for block in (2048, 7):
        for r in V.top_neighbours(df.repartition(6), df.where("id % 50 = 0"), "id", 4, block=block).collect():
            got.setdefault((block, r.query), []).append((r.rank, r.neighbour))
    for q in (0, 50, 100, 150):
        d = ((m - m[q]) ** 2).sum(1)
        want = [i for i in np.lexsort((np.arange(200), d)) if i != q][:4]
        for block in (2048, 7):
            assert [i for _, i in sorted(got[block, q])] == want
    assert V.top_neighbours(df, df.limit(0), "id").count() == 0


def test_day_types_come_back(spark):
    layout = G.Layout()
    eps, types = synthetic.ward_days(spark, layout)
    f = V.standardise(V.ward_day_features(eps, layout, G.costs(spark, layout), None))
    labels, _ = V.kmeans(V.vectors(f).select("day", "ward", "v").cache(), ["day", "ward"], 4)
    assert V.adjusted_rand(labels.join(types, ["day", "ward"]), "label", "day_type").first().ari > 0.5
    shown, odd = V.cohort_summary(V.ward_day_features(eps, layout, G.costs(spark, layout), None), labels, 2)
    assert shown.count() == 4 and odd.count() == 8


def test_trace_text(spark):
    rows = [ep("D", "1A/BED1", None, 5, 12), ep("C", "1A/BED0", "p", 0, 3), ep("C", "1A/BED3", "q", 20, 45)]
    assert V.trace_text(spark.createDataFrame(rows, EP)).first().trace == "round 0: bed0 brief bed3 extended ; round 1: bed1 medium"
