"""Ingest, episodes, evidence, geometry and co-presence."""

import hmac
import random
from datetime import datetime, timedelta

import pytest

from wardloom.functions.keys import id_key, name_key
from wardloom.operators import episodes as E
from wardloom.operators import evidence as V
from wardloom.operators import geometry as G
from wardloom.operators import ingest as I
from wardloom.operators import moments as M
from wardloom.operators.sharded import neighbour, number_block, running_count
from wardloom.sources import synthetic

T0 = datetime(2026, 1, 5, 8)
EV = "seq long, event_ts timestamp_ntz, subject_kind string, subject string, activity string, place string, confidence double"


def ev(rows):
    """(seconds, subject, activity, place[, confidence]) rows as events of clinicians."""
    return [(i, T0 + timedelta(seconds=r[0]), "clinician", r[1], r[2], r[3], r[4] if len(r) > 4 else 1.0) for i, r in enumerate(rows)]


def test_keys(spark):
    df = spark.createDataFrame([(" cln001\t", "4S / BED 03"), ("", " - "), (None, None), ("x", "4s_bed_3")], "a string, b string")
    assert [tuple(r) for r in df.select(id_key("a"), name_key("b")).collect()] == [("CLN001", "4sbed3"), (None, None), (None, None), ("X", "4sbed3")]


def test_neighbours_and_counts_across_blocks(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "a", None]), rng.choice("xyz")) for i in range(500)]
    df = spark.createDataFrame(rows, "seq long, who string, v string")
    for back in (True, False):
        got = {r.seq: r.n for r in neighbour(df, ["who"], ["seq"], number_block("seq", 7), {"n": "v"}, back).collect()}
        for w in ("a", None):
            mine = [r for r in rows if r[1] == w]
            for k, r in enumerate(mine):
                j = k - 1 if back else k + 1
                assert got[r[0]] == (mine[j][2] if 0 <= j < len(mine) else None)
    from pyspark.sql import functions as F

    got = {r.seq: r.c for r in running_count(df, ["who"], ["seq"], number_block("seq", 7), F.col("v") == "x", "c").collect()}
    for w in ("a", None):
        n = 0
        for r in (r for r in rows if r[1] == w):
            n += r[2] == "x"
            assert got[r[0]] == n


def test_place_tiers_and_quarantine(spark):
    places = spark.createDataFrame([("4S/BED3",), ("bay7",), (None,)], "place string")
    aliases = spark.createDataFrame([("Bay 7", "bay7")], "alias string, place string")
    df = spark.createDataFrame([("4S/BED3",), ("4s-bed-03",), (" B 007",), ("roof",), (None,)], "location string")
    got = {r.location: (r.place, r.place_confidence) for r in I.map_places(df, places, aliases).collect()}
    assert list(map(got.get, ("4S/BED3", "4s-bed-03", " B 007", "roof", None))) == [("4S/BED3", 1.0), ("4S/BED3", 0.85), ("bay7", 0.85), ("QUARANTINE:roof", 0.0), (None, 0.0)]
    q = spark.createDataFrame([("QUARANTINE:roof",), ("x",)], "place string").select(I.quarantined_raw("place").alias("r")).collect()
    assert [r.r for r in q] == ["roof", None]


@pytest.mark.parametrize("salt", [b"s", b"x" * 64, b"y" * 90])
def test_pseudonyms_are_hmac(spark, salt):
    df = spark.createDataFrame([("CLN0001",), ("é患",), (None,)], "s string").select(I.pseudonym("s", salt).alias("p")).collect()
    assert [r.p for r in df] == [hmac.new(salt, v.encode(), "sha256").hexdigest()[:16] for v in ("CLN0001", "é患")] + [None]
    assert I.pseudonym_of("CLN0001", salt) == df[0].p


def test_ingestion_report(spark):
    rows = ev([(0, "a", "x", "p"), (10, "a", "x", "p"), (5, "a", "x", "p"), (16, "a", "x", "p"), (16, "a", "y", "QUARANTINE:q"), (0, "b", "x", "p")])
    r = {x.subject: x for x in I.ingestion_report(spark.createDataFrame(rows, EV), block_width=2).collect()}
    assert (r["a"].n_events, r["a"].n_out_of_order, r["a"].n_duplicates, r["a"].n_quarantined) == (5, 1, 1, 1)
    assert r["b"].n_duplicates == 0


def test_transitions(spark):
    rows = ev([(0, "a", "x", "p"), (5, "a", "x", "p"), (9, "a", "x", "q"), (3, "a", "x", None), (4, "a", "x", "p")])
    got = I.transitions(spark.createDataFrame(rows, EV), block_width=1).orderBy("seq").collect()
    assert [(r.origin, r.destination, r.seconds) for r in got] == [("p", "q", 4.0), ("q", "p", -5.0)]


def fold(rows, gap=90, least=120):
    """Episodes by one sequential pass, from the rules in words."""
    out = []
    for who in {r[3] for r in rows}:
        blocks, cur = [], None
        for _, t, _, _, a, p, _ in sorted((r for r in rows if r[3] == who), key=lambda r: (r[1], r[0])):
            t = (t - T0).total_seconds()
            if cur and cur[0] == p and not (a == cur[3] and t - cur[2] > gap):
                cur[2], cur[4] = t, cur[4] + 1
            else:
                cur = [p, t, t, a, 1]
                blocks.append(cur)
        open_ = {}
        for p, a, b, _, n in blocks:
            if p in open_ and a - open_[p][2] <= gap:
                open_[p][2], open_[p][3] = b, open_[p][3] + n
            else:
                open_[p] = [p, a, b, n]
                out.append((who, open_[p]))
    return sorted((w, p, a, b, n) for w, (p, a, b, n) in out if b - a >= least)


def found(spark, rows, **kw):
    e = E.episodes(spark.createDataFrame(rows, EV), E.EpisodeParams(**kw)).collect()
    return sorted((r.clinician, r.bed, (r.start - T0).total_seconds(), (r.end - T0).total_seconds(), r.n_events) for r in e)


def test_episode_fixtures(spark):
    detour = ev([(0, "c", "arrive", "1A/BED0"), (60, "c", "ping", "1A/BED0"), (70, "c", "ping", "1A/NS"), (110, "c", "ping", "1A/BED0"), (300, "c", "depart", "1A/BED0")])
    assert found(spark, detour) == [("c", "1A/BED0", 0, 300, 4)]
    again = ev([(0, "c", "arrive", "b"), (300, "c", "depart", "b"), (7200, "c", "arrive", "b"), (7500, "c", "depart", "b")])
    assert len(found(spark, again)) == 2
    assert found(spark, ev([(0, "c", "arrive", "b"), (30, "c", "depart", "b")])) == []
    assert len(found(spark, ev([(0, "c", "arrive", "b")]), min_dwell_s=0)) == 1
    assert found(spark, ev([(0, "c", "arrive", "b", 0.5), (300, "c", "depart", "b", 0.5)])) == []


def test_episodes_equal_a_sequential_fold(spark):
    rng, rows, t = random.Random(11), [], 0
    for _ in range(3000):
        t += rng.choice([0, 10, 30, 90, 91, 200, 4000])
        rows.append((t, rng.choice("ab"), rng.choice(["arrive", "ping", "depart"]), rng.choice("xyz")))
    assert found(spark, ev(rows)) == fold(ev(rows))


@pytest.mark.parametrize("shape", ["mixed", "one place", "dense", "returns"])
def test_episodes_do_not_depend_on_partitions(spark, shape):
    """Also where one subject holds all rows, stays at one place for good, or is seen everywhere without a pause."""
    rng, rows, t = random.Random(5), [], 0
    pauses = {"mixed": [0, 10, 30, 90, 91, 200, 4000], "one place": [5, 91, 300], "dense": [0, 1, 2, 20], "returns": [20, 40, 89, 92]}[shape]
    for _ in range(1200):
        t += rng.choice(pauses)
        place = "x" if shape == "one place" else rng.choice("xxxy") if shape == "returns" else rng.choice("xyz")
        rows.append((t, "a" if shape != "mixed" else rng.choice("aab"), rng.choice(["arrive", "ping", "ping", "depart", "look"]), place))
    want = fold(ev(rows), least=0)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for parts in ("1", "6", "45"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            assert found(spark, ev(rows), min_dwell_s=0) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_clean_log_gives_back_its_visits(spark):
    events, truth = synthetic.event_log(spark, G.Layout(), synthetic.LogConfig(n_days=2))
    eps = E.episodes(events.withColumnRenamed("location", "place"))
    assert eps.count() / truth.count() >= 0.95
    again = synthetic.event_log(spark, G.Layout(), synthetic.LogConfig(n_days=2))[0]
    assert sorted(events.collect()) == sorted(again.repartition(7).collect())


def test_sensitivity(spark):
    rows = ev([(0, "c", "a", "x"), (100, "c", "b", "x"), (500, "c", "a", "y"), (700, "c", "b", "y")])
    s = E.dwell_sensitivity(spark.createDataFrame(rows, EV), E.EpisodeParams(), known_visits=2)
    assert [(r.min_dwell_s, r.n_episodes, r.recall) for r in s.orderBy("min_dwell_s").collect()] == [(60, 2, 1.0), (120, 1, 0.5), (180, 1, 0.5), (300, 0, 0.0)]
    assert not E.stable_within(s, 0.1).first().stable
    assert E.stable_within(s.limit(0), 0.1).first().stable


EP = "clinician string, bed string, patient string, start timestamp_ntz, end timestamp_ntz, specialties array<string>, dwell_s double, confidence double"


def ep(c, bed, patient, a, b, spec):
    return (c, bed, patient, T0 + timedelta(minutes=a), T0 + timedelta(minutes=b), sorted(spec), (b - a) * 60.0, 1.0)


def test_moment_fixture(spark):
    eps = [
        ep("C1", "1A/BED0", "PAT001", 0, 10, ["cardiology"]), ep("C2", "1A/BED0", "PAT001", 7, 15, ["surgical"]), ep("C3", "1A/BED0", "PAT001", 200, 210, ["cardiology"]),
        ep("C4", "1B/BED0", "PAT002", 0, 10, ["cardiology"]), ep("C5", "1B/BED0", "PAT002", 5, 12, ["cardiology"]), ep("C6", "1B/BED0", None, 5, 12, ["renal"]),
    ]
    need = spark.createDataFrame([("PAT001", ["cardiology", "surgical"]), ("PAT002", ["cardiology", "renal"])], "patient string, required array<string>")
    got = M.mdt_moments(spark.createDataFrame(eps, EP), need).collect()
    assert [(r.bed, r.patient, r.present, r.satisfied) for r in got] == [("1A/BED0", "PAT001", ["cardiology", "surgical"], ["cardiology", "surgical"])]
    assert got[0].end == T0 + timedelta(minutes=15)


def test_clusters_look_at_the_episode_before_only(spark):
    eps = [ep("A", "b", "p", 0, 60, ["s"]), ep("B", "b", "p", 1, 2, ["t"]), ep("C", "b", "p", 20, 30, ["u"])]
    assert M.gatherings(spark.createDataFrame(eps, EP), ["bed", "patient"]).count() == 2


def test_near_miss_fixture(spark):
    layout = G.Layout()
    eps = [ep("CLIN_A", "1B/BED0", None, 0, 10, ["surgical"]), ep("NURSE1", "1B/BED3", "PAT_NEED", 5, 12, ["renal"])]
    need = spark.createDataFrame([("PAT_NEED", ["surgical"])], "patient string, required array<string>")
    walk = [(m * 60, c, "ping", p) for c in ("CLIN_A", "CLIN_B") for m, p in ((0, "1B/BED0"), (10, "1B/BED0"), (15, "1C/BED0"), (20, "1C/BED0"))]
    moves = I.transitions(spark.createDataFrame(ev(walk), EV))
    passed = G.passed_beds(spark, layout, 15.0)
    got = M.near_misses(moves, spark.createDataFrame(eps, EP), need, passed).collect()
    assert [(r.clinician, r.patient, r.specialty, r.bed) for r in got] == [("CLIN_A", "PAT_NEED", "surgical", "1B/BED3")]
    assert round(got[0].proximity_m, 2) == 2.97 and got[0].gap_s == 0
    seen = eps + [ep("CLIN_A", "1B/BED3", "PAT_NEED", 100, 110, ["surgical"])]
    assert M.near_misses(moves, spark.createDataFrame(seen, EP), need, passed).count() == 0


def test_strategies_nest(spark):
    rng = random.Random(3)
    spec = ["cardiology", "renal", "general_medicine", "icu"]
    ref = spark.createDataFrame([(s, ["the " + s]) for s in spec], "specialty string, also_known array<string>")
    rows = [(rng.choice(V.SOURCES), rng.choice(["p1", "P1 ", "p2", None]), rng.choice([*spec, "General-Medicine", "the icu", "nonsense", None])) for _ in range(300)]
    r = V.recognise(spark.createDataFrame(rows, "evidence_source string, patient string, specialty_text string"), ref)
    got = {}
    for c in V.claims(V.evidence_index(r)).collect():
        got.setdefault(c.strategy, set()).add((c.patient, c.specialty))
        assert 0 < c.confidence <= 1
    for s in V.SOURCES:
        assert got["intersection"] <= got[s] <= got["union"]
    assert V.bounds_degenerate(r).first().n_sources == 3
    assert {x.patient for x in V.patient_grid(V.evidence_index(r), V.claims(V.evidence_index(r))).collect()} == {"P1", "P2"}
    with pytest.raises(ValueError):
        V.recognise(r, ref, fuzzy=0.5)


def test_full_recall_gives_back_the_truth(spark):
    spec = ["cardiology", "renal", "icu"]
    rows, truth = synthetic.evidence(spark, 40, spec, {})
    ref = spark.createDataFrame([(s, []) for s in spec], "specialty string, also_known array<string>")
    c = V.claims(V.evidence_index(V.recognise(rows, ref))).where("strategy = 'intersection'")
    assert {(r.patient, r.specialty) for r in c.collect()} == {(r.patient, r.specialty) for r in truth.collect()}


@pytest.mark.parametrize(
    "a,b,metres,seconds",
    [("1A/BED0", "1A/BED3", 5.9464, 4.9554), ("1A/BED0", "1B/BED0", 57.9464, 48.2887), ("1A/BED0", "2A/BED0", 38.1464, 36.6887), ("1A/BED0", "3A/BED0", 42.3464, 45.0887), ("1A/BED0", "2B/BED2", 77.4124, 69.4103), ("1A/BED2", "3C/BED5", 120.8783, 110.5319)],
)
def test_travel_costs(a, b, metres, seconds):
    s, m, _ = G.Layout().quickest(a)[b]
    assert (round(m, 4), round(s, 4)) == (metres, seconds)


def test_layout(spark):
    layout = G.Layout()
    assert G.nodes(spark, layout).count() == 69 and G.edges(spark, layout).count() == 78
    assert layout.way("1A/BED0", "1A/BED3") == ["1A/BED0", "1A/CORRIDOR", "1A/BED3"]
    d = {(a, b): layout.quickest(a)[b][0] for a in layout.bed_names()[::7] for b in layout.bed_names()[::7]}
    assert all(abs(d[a, b] - d[b, a]) < 1e-9 for a, b in d) and all(d[a, c] <= d[a, b] + d[b, c] + 1e-9 for a, b in d for _, c in [(b, x) for x in layout.bed_names()[::7]])
    with pytest.raises(ValueError):
        G.Layout(lift_wait_s=-1)
    assert "FLOOR0/LIFT" in G.Layout(lift_wait_s=0).way("1A/BED0", "3A/BED0")


def test_empty_tables(spark):
    e = spark.createDataFrame([], EV)
    for df in (I.ingestion_report(e), I.transitions(e), E.episodes(e)):
        assert df.count() == 0
    eps = spark.createDataFrame([], EP)
    need = spark.createDataFrame([], "patient string, required array<string>")
    assert M.mdt_moments(eps, need).count() == 0
    assert E.rounds(eps).count() == 0


def test_layout_payload():
    p = G.payload(G.Layout())
    assert (len(p["nodes"]), len(p["edges"])) == (69, 78)
    assert {n["kind"] for n in p["nodes"]} == {"bed", "corridor", "lift", "stair"}
    assert all(e["a"] < e["b"] for e in p["edges"])


def test_quarantined_texts(spark):
    e = spark.createDataFrame([("s", "QUARANTINE:Bay x"), ("t", "QUARANTINE:Bay x"), ("s", "1A/BED0"), (None, None)], "subject string, place string")
    assert [tuple(r) for r in I.quarantined_places(e).collect()] == [("Bay x", 2, 2)]
