"""Process discovery, schedules, search, retrieval."""

import itertools
import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from wardloom.operators import geometry as G
from wardloom.operators import exact as B
from wardloom.operators import petri as N
from wardloom.operators import process as P
from wardloom.operators import retrieval as R
from wardloom.operators import schedule as S
from wardloom.operators import search as X
from wardloom.operators import workgraph as W

T0 = datetime(2026, 1, 5, 8)


def log(spark, traces):
    rows = [(c, a, T0 + timedelta(minutes=i), i, None) for c, t in traces.items() for i, a in enumerate(t)]
    return spark.createDataFrame(rows, "case_id string, activity string, event_ts timestamp_ntz, seq long, resource string")


def test_conformance_fixture(spark):
    train = log(spark, {f"c{i}": ["arrive", "depart"] * 3 for i in range(3)})
    arcs = P.discover(P.dfg(train), "inductive")
    test = log(spark, {"missing": ["arrive"], "odd": ["depart", "arrive"], "clean": ["arrive", "depart"]})
    got = {r.case_id: r for r in P.conformance(test, arcs).collect()}
    assert {c: r.bucket for c, r in got.items()} == {"missing": "missing-data", "odd": "deviating", "clean": "clean"}
    assert got["clean"].fitness == 1.0 > got["odd"].fitness
    f = P.log_fitness(P.conformance(train, arcs)).first()
    assert f.fitness >= 0.9 and P.precision(P.dfg(train), arcs).first().precision >= 0.8


def test_discovery(spark):
    edges = P.dfg(log(spark, {"a": "xyz", "b": "xyz", "c": "xzy"}))
    assert {(r.a, r.b): r.n for r in edges.collect()}["x", "y"] == 2
    dep = {(r.a, r.b): r.dependency for r in P.dependency(edges).collect()}
    assert abs(dep["y", "z"] - 1 / 4) < 1e-12 and abs(dep["x", "y"] - 2 / 3) < 1e-12
    assert P.process_tree(P.discover(edges)) == "seq(x, and(y, z))"
    assert P.process_tree(P.discover(P.dfg(log(spark, {"a": "xz", "b": "yz"})))) == "seq(xor(x, y), z)"
    assert {"".join(r.trace): r.n_cases for r in P.variants(log(spark, {"a": "xz", "b": "xz", "c": "z"})).collect()} == {"xz": 2, "z": 1}
    with pytest.raises(P.EmptyLog):
        P.discover(P.dfg(log(spark, {"a": "x"}).limit(0)))
    with pytest.raises(ValueError):
        P.discover(edges, "magic")


def test_petri_replay_fixture(spark):
    train = log(spark, {f"c{i}": ["arrive", "depart"] * 3 for i in range(3)})
    net = N.net_of_tree(P.mine_tree(P.discover(P.dfg(train))))
    test = log(spark, {"missing": ["arrive"], "odd": ["depart", "arrive"], "clean": ["arrive", "depart"], "strange": ["arrive", "depart", "x"]})
    got = {r.case_id: r for r in N.replay(test, net).collect()}
    assert {c: r.bucket for c, r in got.items()} == {"missing": "missing-data", "odd": "deviating", "clean": "clean", "strange": "deviating"}
    assert got["clean"].fitness == 1.0 > got["odd"].fitness
    f = P.log_fitness(N.replay(train, net)).first()
    assert f.fitness == 1.0 and N.escaping_precision(train, net).first().precision >= 0.8


def test_mined_nets_replay_their_own_log(spark):
    """What the miner has seen fits, and nets are sound on it: no token stays behind."""
    rng = random.Random(3)
    shapes = [
        lambda: "a" + rng.choice(["bc", "cb"]) + "d",
        lambda: "a" + "bc" * rng.randint(1, 3),
        lambda: rng.choice(["ab", "cd", "a", "abd"]),
        lambda: "s" + "".join(rng.sample("abc", 3)) + rng.choice(["", "t"]),
        lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 5))),
    ]
    for shape in shapes:
        traces = {f"c{i}": shape() for i in range(40)}
        seen = log(spark, traces)
        net = N.net_of_tree(P.mine_tree(P.discover(P.dfg(seen)), P.activity_sets(seen)))
        assert {r.bucket for r in N.replay(seen, net).collect()} == {"clean"}
        assert 0 < N.escaping_precision(seen, net).first().precision <= 1


PLAN = "schedule_id long, clinician string, patient string, start_slot int, duration int"


def test_constraints(spark):
    df = spark.createDataFrame([(1, "A", "p", 0, 2), (1, "A", "q", 1, 2), (1, "A", "r", 5, 1), (1, "B", "p", 1, 1), (1, "B", "p", 1, 1), (1, "B", None, 1, 1), (1, "B", "z", -1, 1), (1, "B", "z", 1, 0)], PLAN)
    v = S.visits(df)
    assert v.count() == 4
    assert [(r.patient, r.next_patient) for r in S.double_bookings(v).collect()] == [("p", "q")]
    free = spark.createDataFrame([("A", s) for s in range(4)], "clinician string, slot int")
    assert [(r.patient, r.slot) for r in S.outside_availability(v, free).collect()] == [("r", 5)]
    off = spark.createDataFrame([("q", 2)], "patient string, slot int")
    assert [r.patient for r in S.patient_off_ward(v, off).collect()] == ["q"]
    assert sorted(r.patient for r in S.in_protected(v, [2, 5]).collect()) == ["q", "r"]
    acuity = spark.createDataFrame([("p", 1), ("q", 3), ("r", 2)], "patient string, acuity int")
    assert [r.patient for r in S.acuity_steps_up(v, acuity).collect()] == ["p"]
    iso = spark.createDataFrame([("q",)], "patient string")
    assert [r.patient for r in S.isolation_not_last(v, iso).collect()] == ["r"]
    with pytest.raises(S.ConstraintViolation):
        S.validate({"double": S.double_bookings(v)})
    S.validate({"double": S.double_bookings(v.limit(0))})


def test_objectives_agree_with_the_search(spark):
    inst = X.ward_instance()
    prob = X.Problem(inst)
    rng = random.Random(3)
    plans = [p for p in (prob.random_plan(rng) for _ in range(12)) if p]
    rows = [(i, c, p, s, inst.visit_slots) for i, plan in enumerate(plans) for c, p, s in plan]
    frame = lambda r, ddl: spark.createDataFrame(r, ddl)
    got = S.quantise(S.objectives(
        S.visits(frame(rows, PLAN)),
        frame([(c, sorted(k)) for c, k in inst.skills.items()], "clinician string, specialties array<string>"),
        frame([(p, sorted(k)) for p, k in inst.required.items()], "patient string, required array<string>"),
        frame(list(inst.beds.items()), "patient string, bed string"), G.costs(spark, inst.layout), sorted(inst.protected),
        frame(sorted(inst.previous), "patient string, clinician string"),
    ))
    for r in got.collect():
        want = prob.score(plans[r.schedule_id])
        assert all(abs(r[c] - want[c]) < 0.011 for c in S.SENSES)


def test_fronts_equal_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, float(rng.randint(0, 3)), float(rng.randint(0, 5)), float(rng.randint(0, 2)), float(rng.randint(0, 3)), float(rng.randint(0, 4))) for i in range(300)]
    df = spark.createDataFrame(rows, "schedule_id long, " + ", ".join(f"{c} double" for c in S.SENSES)).repartition(7)
    d = [dict(zip(S.SENSES, r[1:])) for r in rows]
    best = {tuple(x.values()) for x in d if not any(S.dominates(y, x) for y in d)}
    got = S.pareto_front(df).collect()
    assert {tuple(r[1:]) for r in got} == best and len(got) == len(best)
    assert all(r.schedule_id == min(x[0] for x in rows if x[1:] == tuple(r[1:])) for r in got)
    ranks = {r.schedule_id: r["rank"] for r in S.front_ranks(df).collect()}
    assert {tuple(rows[i][1:]) for i, r in ranks.items() if r == 0} == best and len(ranks) == 300
    assert S.pareto_front(df.limit(0)).count() == 0


def test_crowding(spark):
    rows = [(1, 0.0, 10.0), (2, 1.0, 5.0), (3, 4.0, 0.0), (4, 9.0, 9.0)]
    df = spark.createDataFrame([(a, b, c, 0 if a < 4 else 1) for a, b, c in rows], "schedule_id long, x double, y double, rank int")
    got = {r.schedule_id: r.sparsity for r in S.sparsities(df, senses={"x": False, "y": False}).collect()}
    assert got[1] == got[3] == got[4] == float("inf") and abs(got[2] - 2.0) < 1e-12


def test_allowed_starts(spark):
    c = spark.createDataFrame([("A", ["s", "t"]), ("B", ["s"])], "clinician string, specialties array<string>")
    p = spark.createDataFrame([("p", ["s", "u"])], "patient string, required array<string>")
    free = spark.createDataFrame([("A", s) for s in (0, 1, 2, 4, 5)] + [("B", 3)], "clinician string, slot int")
    off = spark.createDataFrame([("p", 5)], "patient string, slot int")
    got = sorted((r.clinician, r.start_slot) for r in S.allowed_starts(c, p, free, off, 6, 2).collect())
    assert got == [("A", 0), ("A", 1)]
    assert [r.specialty for r in S.uncoverable(c, p).collect()] == ["u"]


@pytest.mark.parametrize("search", [X.random_search, X.hill_climb, X.ant_colony, X.nsga2])
def test_searches_give_legal_fronts_again_and_again(search):
    prob = X.Problem(X.ward_instance())
    front = search(prob, 5, 120)
    assert front and all(prob.legal(p) and prob.score(p) == s for s, p in front)
    assert not any(S.dominates(a, b) for (a, _), (b, _) in itertools.permutations(front, 2))
    assert [s for s, _ in search(prob, 5, 120)] == [s for s, _ in front]


def test_exact_front_of_a_tiny_instance():
    inst = X.tiny_instance(2, 4)
    prob = X.Problem(inst)
    front = {tuple(s.values()) for s, _ in X.exact_small(prob)}
    every = []
    for n in range(1, 5):
        for plan in itertools.combinations(itertools.product(sorted(inst.skills), sorted(inst.beds), range(inst.n_slots)), n):
            covers = {(c, p) for c, p, _ in plan}
            # one visit for each pair, and none that covers nothing
            if len(covers) == n and all(inst.skills[c] & inst.required[p] for c, p in covers) and prob.legal(tuple(sorted(plan))):
                every.append(prob.score(tuple(sorted(plan))))
    best = {tuple(x.values()) for x in every if not any(S.dominates(y, x) for y in every)}
    assert front <= {tuple(x.values()) for x in every}
    for c, up in S.SENSES.items():
        k = list(S.SENSES).index(c)
        if c not in ("continuity", "copresence"):
            assert (max if up else min)(f[k] for f in front) == (max if up else min)(f[k] for f in best)
    with pytest.raises(X.InfeasibleInstance):
        X.exact_small(prob, budget=3)
    with pytest.raises(X.InfeasibleInstance):
        X.Instance(4, 1, {"p": "1A/BED0"}, {"p": frozenset({"x"})}, {"A": frozenset()})


@pytest.mark.parametrize("seed", [1, 5, 11])
def test_branch_and_bound_equals_enumeration(seed):
    prob = X.Problem(X.tiny_instance(3, 5, seed))
    front = [s for s, _ in X.exact_small(prob)]
    for c, more in S.SENSES.items():
        o = B.solve_single(prob, c)
        assert o.proven and o.gap == 0 and prob.legal(o.plan) and o.value == (max if more else min)(s[c] for s in front)
    for s in front:  # within the limits that a schedule of the front sets, none moves less
        limits = {c: s[c] for c in S.SENSES if c != "motion_m"}
        assert B.solve_single(prob, "motion_m", limits=limits).value == s["motion_m"]
    none = B.solve_single(prob, "motion_m", limits={"makespan_s": 1.0})
    assert none.status == B.NONE and none.proven and none.value is None
    early = B.solve_single(prob, "motion_m", budget=3)
    assert not early.proven and early.status in (B.OPEN, B.INCUMBENT) and early.bound <= min(s["motion_m"] for s in front)


def test_sweep_of_limits(spark):
    inst = X.tiny_instance(3, 5)
    got = B.epsilon_sweep(spark, inst, grid=2).cache()
    report = B.sweep_report(got).first()
    assert report.all_proven and report.n_solves == got.count() and report.largest_gap == 0.0
    exact = {tuple(s[c] for c in S.SENSES) for s, _ in X.exact_small(X.Problem(inst))}
    front = {tuple(r[c] for c in S.SENSES) for r in B.sweep_front(got).collect()}
    assert front and front <= exact


def test_anchor_instance():
    inst = X.anchor_instance()
    assert len(inst.beds) == 30 and len(inst.skills) == 8 and inst.n_slots == 36 and X.anchor_instance() == inst
    assert [X.teams_for(n) for n in (1, 30, 31, 60, 61)] == [1, 1, 2, 2, 3]
    assert len(X.anchor_instance(n_teams=2).skills) == 16
    with pytest.raises(ValueError):
        X.anchor_instance(n_beds=55)


def test_warm_start():
    prob = X.Problem(X.ward_instance())
    rng = random.Random(1)
    plans = [p for p in (prob.random_plan(rng) for _ in range(5)) if p]
    assert all(prob.legal(p) for p in X.warm_start(prob, plans))


TEXT = "intro\n# A\none two\n## B\nthree\n```\n# no heading\n```\n# C\nfour"


def test_heading_chunks():
    got = [(a, b, p) for a, b, p, _ in R.markdown_chunks(TEXT)]
    assert got == [(1, 1, ""), (2, 3, "A"), (4, 8, "A > B"), (9, 10, "C")]


def test_line_windows():
    lines = ["w " * 10] * 10
    got = R.line_windows(lines, 1, 10, 30, 10)
    assert got == [(1, 3), (3, 5), (5, 7), (7, 9), (9, 10)]
    assert R.line_windows(["w " * 100, "w"], 1, 2, 30, 5) == [(1, 1), (2, 2)]
    assert R.line_windows(lines, 1, 6, 40, 15) == [(1, 4), (3, 6)]  # back until 15 tokens are shared
    assert R.line_windows(["", "", "w " * 50, "w"], 1, 4, 30, 0) == [(1, 3), (4, 4)]
    assert R.line_windows(lines, 3, 5, 10, 0) == [(3, 3), (4, 4), (5, 5)]


def test_other_chunkers():
    paged = R.paged_chunks("a\n<!-- page 3 -->\nb\n<!-- page 4 -->\nc")
    assert [(a, t, p) for a, _, _, t, p in paged] == [(1, "a", None), (3, "b", 3), (5, "c", 4)]
    assert [(a, b, h) for a, b, h, _ in R.audit_chunks("x\n## one\nq\n## two")] == [(2, 3, "one"), (4, 4, "two")]
    code = '"""Doc."""\n\n@deco\ndef f(a):\n    """What."""\n    return 1\n\nclass C:\n    x = 1\n\n    def m(self):\n        return 2\n'
    assert [(a, b, h) for a, b, h, _ in R.python_chunks(code, "mod")] == [(1, 1, "mod"), (3, 5, "mod.f"), (8, 8, "mod.C"), (11, 11, "mod.C.m")]
    assert R.python_chunks("def (", "mod")[0][2] == "mod"


def test_chunk_rows(spark):
    df = spark.createDataFrame([("a.md", TEXT), ("b.py", "def f():\n    pass\n"), ("c.md", None), (None, "# x\ny"), ("docs/audit.md", "## e\nz")], "path string, text string")
    got = R.chunk_texts(df, "path", "text").collect()
    assert {r.path for r in got} == {"a.md", "b.py", None, "docs/audit.md"} and all(len(r.sha256) == 64 for r in got)
    assert "a.md:4-8" in {r.id for r in got}


def test_bm25_equals_the_formula(spark):
    docs = [("a", "h", "the lift and the stairs"), ("b", None, "lift lift"), ("c", "", None), ("d", "x", "other words here")]
    qs = [(1, "lift LIFT stairs"), (2, "nothing"), (3, None)]
    got = {(r.query_id, r.doc_id): r.score for r in R.bm25_scores(spark.createDataFrame(docs, "id string, h string, t string"), spark.createDataFrame(qs, "q long, query string"), "id", "h", "t", "q", "query").collect()}
    tok = {d: ((h or "") + " " + (t or "")).lower().split() for d, h, t in docs}
    avg, n = np.mean([len(x) for x in tok.values()]), len(docs)
    for d in "ab":
        want = 0.0
        for term in ("lift", "lift", "stairs"):
            df = sum(term in x for x in tok.values())
            tf = tok[d].count(term)
            want += max(0, np.log((n - df + 0.5) / (df + 0.5) + 1)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(tok[d]) / avg)) if tf else 0
        assert abs(got[1, d] - want) < 1e-9
    assert set(got) == {(1, "a"), (1, "b")}


def test_fusion_and_scores(spark):
    ddl = "query_id long, doc_id string, rank int"
    a, b = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], ddl), spark.createDataFrame([(1, "y", 1), (1, "z", 2), (1, "w", 51)], ddl)
    got = [(r.doc_id, round(r.score, 9)) for r in R.rrf_fuse(a, b).orderBy("rank").collect()]
    assert got == [("y", round(1 / 61 + 1 / 62, 9)), ("x", round(1 / 61, 9)), ("z", round(1 / 62, 9))]
    chunks = spark.createDataFrame([("x", "p", 1, 5), ("y", "p", 6, 9)], "doc_id string, path string, start_line int, end_line int")
    gold = spark.createDataFrame([(1, "p", 9, 12)], "query_id long, path string, start_line int, end_line int")
    s = R.retrieval_scores(a, gold, chunks, spark.createDataFrame([(1,), (2,)], "query_id long")).first()
    assert (s.n_queries, s.recall, s.mrr) == (2, 0.5, 0.25)


def test_work_graph(spark):
    items = spark.createDataFrame([("a", True), ("b", False), ("c", False), ("d", False)], "item string, done boolean")
    edges = spark.createDataFrame([("b", "a"), ("c", "d"), ("d", "c"), ("c", "gone")], "item string, depends_on string")
    assert [r.depends_on for r in W.missing_dependencies(items, edges).collect()] == ["gone"]
    assert {r.item for r in W.on_cycles(edges).collect()} == {"c", "d"}
    assert [r.item for r in W.runnable(items, edges).collect()] == ["b"]


def test_stored_index_and_evaluation(spark, tmp_path):
    df = spark.createDataFrame([("a.md", "# lifts\nthe lift is slow\n# stairs\nthe stairs are quick"), ("b.md", "nothing of note")], "path string, text string")
    R.write_index(R.chunk_texts(df, "path", "text"), str(tmp_path / "ix"))
    chunks, stats, vectors = R.load_index(spark, str(tmp_path / "ix"))
    assert (stats.first().n_chunks, stats.first().n_files, vectors) == (3, 2, None)
    (tmp_path / "q.json").write_text('[{"id": 1, "query": "slow lift", "relevant": [{"path": "a.md", "start_line": 2, "end_line": 2}]}, {"id": 2, "query": "zebra"}]')
    queries, relevant = R.load_queries(spark, str(tmp_path / "q.json"))
    assert R.search(chunks, queries, 1).first().doc_id == "a.md:1-2"
    dense = spark.createDataFrame([("1", "b.md:1-1", 1), ("1", "a.md:1-2", 2)], "query_id string, doc_id string, rank int")
    got = {r.retriever: (r.n_queries, r.recall, r.mrr) for r in R.evaluate(chunks, queries, relevant, dense).collect()}
    assert got == {"lexical": (2, 0.5, 0.5), "vector": (2, 0.5, 0.25), "hybrid": (2, 0.5, 0.5)}


def test_clock_and_levels(spark):
    v = spark.createDataFrame([(1, "A", "p", 3, 2, T0.date())], PLAN + ", day date")
    r = S.to_clock(v, "day").first()
    assert (r.start, r.seconds) == (T0 + timedelta(minutes=15), 600)
    t = spark.createDataFrame([("motion_m", 10.0, 50.0)], "objective string, ideal double, nadir double")
    assert [r.bound for r in S.grid_levels(t).orderBy("level").collect()] == [50.0, 40.0, 30.0, 20.0, 10.0]


def test_long_chains_are_on_no_cycle(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(30)] + [("x", "y"), ("y", "x"), ("n30", "x"), (None, "x"), ("x", "y")], "item string, depends_on string")
    assert {r.item for r in W.on_cycles(edges, cut_every=4).collect()} == {"x", "y"}
    assert W.on_cycles(edges.limit(0)).count() == 0


def test_graph_file_budget_and_audit(spark, tmp_path):
    path = tmp_path / "graph.json"
    path.write_text('{"nodes": [{"id": "a", "title": "First", "status": "done"}, {"id": "b", "gate": "hard-stop", "depends_on": ["a"]}]}')
    items, edges = W.load_graph(spark, str(path))
    assert [(r.item, r.status, r.gate, r.agent) for r in items.orderBy("item").collect()] == [("a", "done", "autonomous", "builder"), ("b", "pending", "hard-stop", "builder")]
    assert [r.line for r in W.flowchart(items, edges).collect()] == ["flowchart TD", '  a["a<br/>First"]:::autonomous', '  b["b"]:::hard_stop', "  a --> b"]
    usage = spark.createDataFrame([("m", 60.0), ("n", 25.0)], "model string, billable double")
    r = W.assess(usage, 100, [(0.8, "slow down"), (0.5, "warn"), (1.0, "stop")]).first()
    assert (r.billable, r.fraction, r.remaining, r.action) == (85.0, 0.85, 15.0, "slow down")
    assert W.assess(usage.limit(0), 100, []).first().action == "ok"
    log = str(tmp_path / "audit")
    for what in ("one", "two"):
        W.append_audit(spark.createDataFrame([(what, "because", "plan", ["f"])], "action string, why string, authority string, artefacts array<string>"), log)
    assert sorted((r.action, r.artefacts, r.node) for r in W.read_audit(spark, log).collect()) == [("one", ["f"], None), ("two", ["f"], None)]
    with pytest.raises(ValueError):
        W.append_audit(spark.createDataFrame([("x", None, "y")], "action string, why string, authority string"), log)
