"""Schedule search: instances, candidate construction and five searches run as parallel islands.

Each search is a function of a seed; ``run_islands`` maps it over seeds on the executors and
reduces all candidates to one Pareto front. Candidates are schedules that keep every hard rule.
"""

from __future__ import annotations

import itertools
import json
import math
import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from wardloom.operators.geometry import Layout
from wardloom.operators.schedule import SENSES, SLOT_S, dominates, pareto_front

Visit = tuple[str, str, int]  # clinician, patient, start slot
Plan = tuple[Visit, ...]


class InfeasibleInstance(ValueError):
    """A required specialty that nobody holds."""


@dataclass(frozen=True)
class Instance:
    """One scheduling problem. Clinicians without an entry in ``available`` are always free."""

    n_slots: int
    visit_slots: int
    beds: dict[str, str]
    required: dict[str, frozenset[str]]
    skills: dict[str, frozenset[str]]
    layout: Layout = field(default_factory=Layout)
    available: dict[str, frozenset[int]] = field(default_factory=dict)
    off: dict[str, frozenset[int]] = field(default_factory=dict)
    protected: frozenset[int] = frozenset()
    previous: frozenset[tuple[str, str]] = frozenset()
    acuity: dict[str, int] = field(default_factory=dict)
    isolated: frozenset[str] = frozenset()

    def __post_init__(self) -> None:
        held = frozenset().union(*self.skills.values()) if self.skills else frozenset()
        for p, need in sorted(self.required.items()):
            if need - held:
                raise InfeasibleInstance(f"nobody holds {sorted(need - held)} for {p}")


def tiny_instance(n_beds: int = 4, n_slots: int = 6, seed: int = 1) -> Instance:
    """Few patients and clinicians, for exhaustive search."""
    rng = random.Random(seed)
    names = ("cardiology", "renal", "surgical")
    beds = Layout().bed_names()[:n_beds]
    patients = [f"P{i}" for i in range(n_beds)]
    need = {p: frozenset(rng.sample(names, 2 if i % 2 == 0 else 1)) for i, p in enumerate(patients)}
    skills = {"A": frozenset(names[:2]), "B": frozenset(names[1:]), "C": frozenset((names[0], names[2]))}
    return Instance(n_slots, 1, dict(zip(patients, beds)), need, skills, protected=frozenset({n_slots // 2}), previous=frozenset({(patients[0], "A")}))


def ward_instance(n_beds: int = 12, n_clinicians: int = 6, n_slots: int = 24, seed: int = 17) -> Instance:
    """A larger instance with limited availability, off-ward times, acuity and isolation."""
    rng = random.Random(seed)
    names = ("cardiology", "renal", "surgical", "general_medicine", "oncology", "neurology")
    beds = Layout().bed_names()[:n_beds]
    patients = [f"P{i:02d}" for i in range(n_beds)]
    need = {p: frozenset(rng.sample(names, rng.choice((1, 2, 2, 3)))) for p in patients}
    clinicians = [f"C{i:02d}" for i in range(n_clinicians)]
    skills = {c: frozenset({names[i % len(names)], names[(i * 2 + 1) % len(names)], rng.choice(names)}) for i, c in enumerate(clinicians)}
    missing = frozenset().union(*need.values()) - frozenset().union(*skills.values())
    skills[clinicians[0]] |= missing
    free = {c: frozenset(range(n_slots)) - frozenset(rng.sample(range(n_slots), 2)) for c in clinicians}
    return Instance(
        n_slots, 1, dict(zip(patients, beds)), need, skills, available=free, off={p: frozenset(rng.sample(range(n_slots), 2)) for p in patients[::3]},
        protected=frozenset(range(n_slots // 2, n_slots // 2 + 3)), previous=frozenset((p, rng.choice(clinicians)) for p in patients[::2]),
        acuity={p: rng.randint(1, 4) for p in patients}, isolated=frozenset(patients[-2:]),
    )


# One team's roles and skills, and the beds for each clinician of a team.
TEAM = (
    ("consultant", ("general_medicine",)),
    ("consultant", ("general_medicine",)),
    ("registrar", ("general_medicine",)),
    ("consultant", ("cardiology",)),
    ("registrar", ("cardiology",)),
    ("consultant", ("surgical",)),
    ("registrar", ("surgical",)),
    ("consultant", ("nephrology", "general_medicine")),
)
BEDS_A_CLINICIAN = 30 / 8


def teams_for(n_beds: int) -> int:
    """Whole teams that a number of beds is staffed with, rounded up."""
    if n_beds < 1:
        raise ValueError("at least one bed is needed")
    return max(1, math.ceil(n_beds / BEDS_A_CLINICIAN / len(TEAM)))


def anchor_instance(n_beds: int = 30, n_slots: int = 36, n_teams: int = 1, seed: int = 20260814) -> Instance:
    """The anchor's shape: 30 beds, one team of eight, 36 slots of five minutes; other sizes by parameter.

    Of patients 60 % need one specialty, 35 % two and 5 % three; acuity is one of four; 10 % are
    isolated; 15 % are away for six slots in a row; six slots in the middle are protected; a quarter
    of the clinicians are away for nine slots; half the patients have someone from yesterday.
    """
    if n_teams < 1:
        raise ValueError("at least one team is needed")
    rng = random.Random(seed)
    beds = Layout().bed_names()
    if n_beds > len(beds):
        raise ValueError(f"the layout has {len(beds)} beds")
    skills = {f"C{k:02d}": frozenset(s) for k, (_, s) in enumerate(TEAM * n_teams)}
    pool = sorted(frozenset().union(*skills.values()))
    patients = [f"P{k:02d}" for k in range(n_beds)]
    need = {p: frozenset(rng.sample(pool, rng.choices((1, 2, 3), (60, 35, 5))[0])) for p in patients}

    def stretch(n: int) -> frozenset[int]:
        first = rng.randrange(max(1, n_slots - n + 1))
        return frozenset(range(first, min(n_slots, first + n)))

    slots = frozenset(range(n_slots))
    holders = {p: sorted(c for c, s in skills.items() if s & need[p]) for p in patients}
    return Instance(
        n_slots, 1, dict(zip(patients, beds)), need, skills,
        available={c: slots - stretch(9) if rng.random() < 0.25 else slots for c in skills},
        off={p: stretch(6) for p in patients if rng.random() < 0.15},
        protected=frozenset(range(n_slots // 2, min(n_slots, n_slots // 2 + 6))),
        previous=frozenset((p, rng.choice(holders[p])) for p in patients if rng.random() < 0.5),
        acuity={p: rng.randint(1, 4) for p in patients}, isolated=frozenset(p for p in patients if rng.random() < 0.1),
    )


class Problem:
    """An instance with its costs worked out: building and scoring of plans."""

    def __init__(self, inst: Instance) -> None:
        self.i = inst
        trees = {b: inst.layout.quickest(b) for b in set(inst.beds.values())}
        self.metres = {(p, q): trees[inst.beds[p]][inst.beds[q]][1] for p in inst.beds for q in inst.beds}
        self.gap = {(p, q): math.ceil(trees[inst.beds[p]][inst.beds[q]][0] / SLOT_S) for p in inst.beds for q in inst.beds}
        self.pairs = [(p, s) for p in sorted(inst.required) for s in sorted(inst.required[p])]
        self.holders = {s: sorted(c for c, k in inst.skills.items() if s in k) for _, s in self.pairs}

    def fits(self, c: str, p: str, start: int) -> bool:
        slots = range(start, start + self.i.visit_slots)
        free = self.i.available.get(c)
        off = self.i.off.get(p, frozenset())
        return start >= 0 and slots[-1] < self.i.n_slots and (free is None or all(s in free for s in slots)) and not any(s in off for s in slots)

    def order(self, patients: list[str], key: Callable[[str], object]) -> list[str]:
        """Isolated patients last, then falling acuity, then ``key``."""
        return sorted(patients, key=lambda p: (p in self.i.isolated, -self.i.acuity.get(p, 0), key(p)))

    def legal(self, plan: Plan) -> bool:
        routes: dict[str, list[Visit]] = {}
        for v in sorted(plan, key=lambda v: (v[2], v[1])):
            routes.setdefault(v[0], []).append(v)
        for c, route in routes.items():
            seen_isolated = False
            for k, (_, p, start) in enumerate(route):
                if not self.fits(c, p, start) or (seen_isolated and p not in self.i.isolated):
                    return False
                seen_isolated |= p in self.i.isolated
                if k:
                    _, q, before = route[k - 1]
                    if start < before + self.i.visit_slots + self.gap[q, p] or self.i.acuity.get(p, 0) > self.i.acuity.get(q, 9):
                        return False
        covered: dict[str, frozenset[str]] = {}
        for c, p, _ in plan:
            covered[p] = covered.get(p, frozenset()) | self.i.skills[c]
        return all(need <= covered.get(p, frozenset()) for p, need in self.i.required.items())

    def build(self, choice: dict[tuple[str, str], str], wish: dict[tuple[str, str], int], tie: Callable[[str], object]) -> Plan | None:
        """Visits of a choice of clinicians, each at the first fitting slot from its wished one on; None if some don't fit."""
        todo: dict[str, set[str]] = {}
        for (p, _), c in choice.items():
            todo.setdefault(c, set()).add(p)
        out: list[Visit] = []
        for c, patients in sorted(todo.items()):
            at, prev = 0, None
            route = self.order(sorted(patients), lambda p, c=c: (wish.get((c, p), 0), tie(p)))
            for k, p in enumerate(route):
                low = at + (self.gap[prev, p] if prev else 0)
                # Later stops need room too: never wish beyond what leaves a slot for each.
                start = max(low, min(wish.get((c, p), 0), self.i.n_slots - (len(route) - k) * self.i.visit_slots))
                tries = [s for s in range(start, self.i.n_slots) if self.fits(c, p, s)] or [s for s in range(low, start) if self.fits(c, p, s)]
                if not tries:
                    return None
                out.append((c, p, tries[0]))
                at, prev = tries[0] + self.i.visit_slots, p
        return tuple(sorted(out))

    def score(self, plan: Plan) -> dict[str, float]:
        i, d = self.i, self.i.visit_slots
        multi = [p for p, need in i.required.items() if len(need) >= 2]
        met = 0
        for p in multi:
            mine = [(c, s) for c, q, s in plan if q == p]
            best: frozenset[str] = frozenset()
            for b in sorted({s for _, s in mine}):
                there = frozenset().union(*(i.skills[c] for c, s in mine if s <= b < s + d))
                if len(there) > len(best):
                    best = there
            met += len(best & i.required[p]) >= 2
        routes: dict[str, list[tuple[int, str]]] = {}
        for c, p, s in plan:
            routes.setdefault(c, []).append((s, p))
        metres = sum(self.metres[a[1], b[1]] for r in routes.values() for a, b in itertools.pairwise(sorted(r)))
        pairs = {(p, c) for c, p, _ in plan}
        return {
            "copresence": met / len(multi) if multi else 1.0,
            "motion_m": round(metres, 2),
            "disruption": float(sum(any(x in i.protected for x in range(s, s + d)) for _, _, s in plan)),
            "continuity": len(pairs & i.previous) / len(i.previous) if i.previous else 0.0,
            "makespan_s": float(max((s + d for _, _, s in plan), default=0) * SLOT_S),
        }

    def random_plan(self, rng: random.Random) -> Plan | None:
        choice = {k: rng.choice(self.holders[k[1]]) for k in self.pairs}
        wish = {(c, p): rng.randrange(self.i.n_slots) for (p, _), c in choice.items()}
        return self.build(choice, wish if rng.random() < 0.7 else {}, lambda _: rng.random())


    def even_choice(self, rng: random.Random) -> dict[tuple[str, str], str]:
        """A clinician for each required pair, who sees the patient anyway or has the fewest patients so far."""
        load: dict[str, set[str]] = {c: set() for c in self.i.skills}
        choice = {}
        for p, s in rng.sample(self.pairs, len(self.pairs)):
            c = min(self.holders[s], key=lambda c: (p not in load[c], len(load[c]), rng.random()))
            load[c].add(p)
            choice[p, s] = c
        return choice


class Archive:
    """Plans that none other seen dominates; of equal scores the first."""

    def __init__(self) -> None:
        self.items: list[tuple[dict[str, float], Plan]] = []

    def add(self, score: dict[str, float], plan: Plan) -> bool:
        if any(s == score or dominates(s, score) for s, _ in self.items):
            return False
        self.items = [(s, p) for s, p in self.items if not dominates(score, s)] + [(score, plan)]
        return True


Search = Callable[[Problem, int, int], list[tuple[dict[str, float], Plan]]]


def random_search(prob: Problem, seed: int, budget: int) -> list:
    rng, front = random.Random(seed), Archive()
    for _ in range(budget):
        plan = prob.random_plan(rng)
        if plan:
            front.add(prob.score(plan), plan)
    return front.items


def _tweak(prob: Problem, plan: Plan, rng: random.Random) -> Plan | None:
    """One visit moved in time, or one patient's visits chosen anew."""
    moves = list(plan)
    k = rng.randrange(len(moves))
    c, p, _ = moves[k]
    if rng.random() < 0.6:
        moves[k] = (c, p, rng.randrange(prob.i.n_slots))
        new = tuple(sorted(moves))
    else:
        rest = [v for v in moves if v[1] != p]
        picked = {rng.choice(prob.holders[s]) for s in prob.i.required[p]}
        new = tuple(sorted(rest + [(x, p, rng.randrange(prob.i.n_slots)) for x in picked]))
    return new if prob.legal(new) else None


def hill_climb(prob: Problem, seed: int, budget: int, patience: int = 60) -> list:
    """Restarts; a tweak is taken only if it dominates."""
    rng, front, used = random.Random(seed), Archive(), 0
    while used < budget:
        plan, used = prob.random_plan(rng), used + 1
        if not plan:
            continue
        score, idle = prob.score(plan), 0
        front.add(score, plan)
        while idle < patience and used < budget:
            new, used, idle = _tweak(prob, plan, rng), used + 1, idle + 1
            if new:
                s = prob.score(new)
                front.add(s, new)
                if dominates(s, score):
                    plan, score, idle = new, s, 0
    return front.items


def ant_colony(prob: Problem, seed: int, budget: int, ants: int = 8, q0: float = 0.6, alpha: float = 1.0, beta: float = 2.0, rho: float = 0.1, xi: float = 0.1) -> list:
    """Ants order each clinician's stops by trail and nearness; trails of the least motion are reinforced."""
    rng, front, best = random.Random(seed), Archive(), None
    base = 1.0
    trail: dict[tuple[str, str], float] = {}
    for _ in range(max(1, budget // ants)):
        for _ in range(ants):
            choice = {k: rng.choice(prob.holders[k[1]]) for k in prob.pairs}
            todo: dict[str, set[str]] = {}
            for (p, _), c in choice.items():
                todo.setdefault(c, set()).add(p)
            wish: dict[tuple[str, str], int] = {}
            for c, patients in sorted(todo.items()):
                at, left, n = "", sorted(patients), 0
                while left:
                    pull = [trail.get((at, p), base) ** alpha * (1.0 / (1.0 + (prob.metres[at, p] if at else 0.0))) ** beta for p in left]
                    p = left[max(range(len(left)), key=lambda j: pull[j])] if rng.random() < q0 else rng.choices(left, pull)[0]
                    trail[at, p] = (1 - xi) * trail.get((at, p), base) + xi * base
                    wish[c, p], n, at = n, n + 1, p
                    left.remove(p)
            plan = prob.build(choice, wish, lambda _: 0)
            if plan:
                s = prob.score(plan)
                front.add(s, plan)
                if best is None or s["motion_m"] < best[0]:
                    best = (s["motion_m"], wish, todo)
        if best:
            for c, patients in best[2].items():
                at = ""
                for p in sorted(patients, key=lambda p: best[1][c, p]):
                    trail[at, p] = (1 - rho) * trail.get((at, p), base) + rho * 100.0 / (1.0 + best[0])
                    at = p
    return front.items


def _ranked(scores: list[dict[str, float]]) -> list[tuple[int, float]]:
    """Front number and crowding of each."""
    n = len(scores)
    rank, left, r = [0] * n, set(range(n)), 0
    while left:
        top = {a for a in left if not any(dominates(scores[b], scores[a]) for b in left if b != a)}
        for a in top:
            rank[a] = r
        left, r = left - top, r + 1
    crowd = [0.0] * n
    for q in range(r):
        mine = [a for a in range(n) if rank[a] == q]
        for c in SENSES:
            mine.sort(key=lambda a: (scores[a][c], a))
            span = scores[mine[-1]][c] - scores[mine[0]][c]
            if span:
                crowd[mine[0]] = crowd[mine[-1]] = math.inf
                for x, a, y in zip(mine, mine[1:], mine[2:]):
                    crowd[a] += (scores[y][c] - scores[x][c]) / span
        if len(mine) <= 2:
            for a in mine:
                crowd[a] = math.inf
    return list(zip(rank, crowd))


def nsga2(prob: Problem, seed: int, budget: int, size: int = 24) -> list:
    """Genomes choose clinician and wished slot of every required pair; ranks and crowding select."""
    rng, front = random.Random(seed), Archive()

    def gene(k: tuple[str, str]) -> tuple[str, int]:
        return rng.choice(prob.holders[k[1]]), rng.randrange(prob.i.n_slots)

    def decode(g: dict) -> tuple[dict[str, float], Plan] | None:
        plan = prob.build({k: c for k, (c, _) in g.items()}, {(c, k[0]): w for k, (c, w) in g.items()}, lambda p: p)
        return (prob.score(plan), plan) if plan else None

    def fresh() -> tuple[dict, tuple]:
        for turn in range(400):
            # Where random genomes don't fit, patients are shared out evenly and seen as early as can be.
            g = {k: gene(k) for k in prob.pairs} if turn < 20 else {k: (c, 0) for k, c in prob.even_choice(rng).items()}
            if got := decode(g):
                return g, got
        raise InfeasibleInstance("no legal schedule found")

    pop = [fresh() for _ in range(size)]
    for _, got in pop:
        front.add(*got)
    used = size
    while used < budget:
        fit = _ranked([s for _, (s, _) in pop])

        def pick() -> dict:
            a, b = rng.randrange(size), rng.randrange(size)
            return pop[a if (fit[a][0], -fit[a][1]) <= (fit[b][0], -fit[b][1]) else b][0]

        young = []
        while len(young) < size and used < budget:
            a, b, used = pick(), pick(), used + 1
            g = {k: (a if rng.random() < 0.5 else b)[k] for k in prob.pairs}
            for k in prob.pairs:
                if rng.random() < 1 / len(prob.pairs):
                    g[k] = gene(k)
            if got := decode(g):
                young.append((g, got))
                front.add(*got)
        pop += young
        fit = _ranked([s for _, (s, _) in pop])
        pop = [pop[i] for i in sorted(range(len(pop)), key=lambda i: (fit[i][0], -fit[i][1], i))[:size]]
    return front.items


def exact_small(prob: Problem, seed: int = 0, budget: int = 2_000_000) -> list:
    """The whole front of a tiny instance: every cover by clinicians, every start, with early cuts.

    Exact only where it ends within ``budget`` placements, else it refuses. ``seed`` isn't used.
    """
    front, spent = Archive(), 0
    patients = sorted(prob.i.required)
    covers = []
    for p in patients:
        sets = {frozenset(c) for c in itertools.product(*(prob.holders[s] for s in sorted(prob.i.required[p])))}
        covers.append(sorted(map(sorted, sets)))
    for cover in itertools.product(*covers):
        todo = [(c, p) for p, cs in zip(patients, cover) for c in cs]

        def place(k: int, plan: list[Visit]) -> None:
            nonlocal spent
            if k == len(todo):
                t = tuple(sorted(plan))
                if prob.legal(t):
                    front.add(prob.score(t), t)
                return
            c, p = todo[k]
            for s in range(prob.i.n_slots):
                spent += 1
                if spent > budget:
                    raise InfeasibleInstance("too large to enumerate")
                if prob.fits(c, p, s) and not any(v[0] == c and abs(v[2] - s) < prob.i.visit_slots for v in plan):
                    place(k + 1, [*plan, (c, p, s)])

        place(0, [])
    return front.items


def warm_start(prob: Problem, neighbours: list[Plan]) -> list[Plan]:
    """Legal plans made from those of other days: beds in the order in which they were reached there."""
    out = []
    for plan in neighbours:
        first: dict[str, int] = {}
        for _, p, s in plan:
            first[p] = min(s, first.get(p, s))
        choice = {(p, s): next((c for c, q, _ in plan if q == p and s in prob.i.skills.get(c, ())), prob.holders[s][0]) for p, s in prob.pairs}
        new = prob.build(choice, {(c, p): first.get(p, 0) for (p, _), c in choice.items()}, lambda p: first.get(p, 0))
        if new and prob.legal(new):
            out.append(new)
    return out


def run_islands(spark: SparkSession, inst: Instance, search: Search, seeds: list[int], budget: int, seconds: float | None = None) -> DataFrame:
    """Front of all islands: ``schedule_id, five objectives``, smallest id of equal ones.

    Each seed is a task of its own; an island that overruns ``seconds`` ends with what it has only
    between searches, so budgets bound the work. Plans are found again from seed and number.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        prob, end = Problem(inst), None if seconds is None else time.time() + seconds
        for pdf in batches:
            rows = []
            for seed in pdf["id"]:
                if end and time.time() > end:
                    break
                for i, (s, plan) in enumerate(search(prob, int(seed), budget)):
                    rows.append((int(seed) * 1_000_000 + i, *(float(s[c]) for c in SENSES), json.dumps(plan)))
            yield pd.DataFrame(rows, columns=["schedule_id", *SENSES, "plan"])

    ddl = "schedule_id long, " + ", ".join(f"{c} double" for c in SENSES) + ", plan string"
    ids = spark.createDataFrame([(s,) for s in seeds], "id long").repartition(len(seeds))
    return pareto_front(ids.mapInPandas(run, ddl).drop("plan"))
