"""Exact schedule search by branch and bound: single objectives with a proven flag and gap, and the epsilon sweep.

A node of the search tree fixes who sees the first patients, and when; its children place the next
patient's visits. Every objective has a bound over all ways to go on, so a branch that can't beat the
best schedule found, or can't keep to a limit on another objective, is cut. Solves are independent
of each other and run as one task each.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardloom.operators.schedule import SENSES, SLOT_S, pareto_front
from wardloom.operators.search import Instance, Plan, Problem, Visit

PROVEN, INCUMBENT, NONE, OPEN = "optimal", "feasible", "infeasible", "unknown"


@dataclass(frozen=True)
class Outcome:
    """What one solve came to. ``bound``: no schedule within the limits has a better value."""

    objective: str
    status: str
    value: float | None
    bound: float | None
    nodes: int
    score: dict[str, float] | None
    plan: Plan | None

    @property
    def proven(self) -> bool:
        return self.status in (PROVEN, NONE)

    @property
    def gap(self) -> float | None:
        """Distance of value and bound relative to the value; null without a schedule."""
        return None if self.value is None else abs(self.value - self.bound) / max(1.0, abs(self.value))


class _Tree:
    def __init__(self, prob: Problem) -> None:
        self.prob, i = prob, prob.i
        self.sign = {c: -1.0 if more else 1.0 for c, more in SENSES.items()}
        # Patients with few ways first; the ways are sets of clinicians that together hold what is needed.
        self.covers = {p: sorted({tuple(sorted(set(c))) for c in itertools.product(*(prob.holders[s] for s in sorted(need)))}, key=lambda c: (len(c), c)) for p, need in i.required.items()}
        self.patients = sorted((p for p in i.required if i.required[p]), key=lambda p: (len(self.covers[p]), p))
        self.multi = [p for p in i.required if len(i.required[p]) >= 2]
        m, beds = prob.metres, list(i.beds)
        self.metric = all(m[a, c] <= m[a, b] + m[b, c] + 1e-9 for a in beds for b in beds for c in beds)

    def clash(self, a: Visit, b: Visit) -> bool:
        """Whether two visits of one clinician can't be in one legal route."""
        if a[2] > b[2]:
            a, b = b, a
        i = self.prob.i
        if b[2] < a[2] + i.visit_slots + self.prob.gap[a[1], b[1]]:
            return True
        return (a[1] in i.isolated and b[1] not in i.isolated) or i.acuity.get(b[1], 0) > i.acuity.get(a[1], 9)

    def bounds(self, plan: Plan, depth: int) -> dict[str, float]:
        """For each objective the best that any schedule which holds these visits can reach."""
        i, left = self.prob.i, self.patients[depth:]
        got = self.prob.score(plan)
        open_ = set(left)
        met = got["copresence"] * len(self.multi) + sum(p in open_ for p in self.multi) if self.multi else 1.0
        pairs = {(p, c) for c, p, _ in plan}
        may = sum(p in open_ and any(c in w for w in self.covers[p]) for p, c in i.previous)
        return {
            "copresence": met / len(self.multi) if self.multi else 1.0,
            # A stop more never makes a route shorter where metres keep the triangle inequality.
            "motion_m": got["motion_m"] if self.metric else 0.0,
            "disruption": got["disruption"],
            "continuity": (len(pairs & i.previous) + may) / len(i.previous) if i.previous else 0.0,
            "makespan_s": max([got["makespan_s"], *([i.visit_slots * SLOT_S] if left else [])]),
        }

    def children(self, plan: Plan, depth: int) -> Iterator[Plan]:
        p = self.patients[depth]
        mine: dict[str, list[Visit]] = {}
        for v in plan:
            mine.setdefault(v[0], []).append(v)
        for cover in self.covers[p]:
            fitting = [[(c, p, s) for s in range(self.prob.i.n_slots) if self.prob.fits(c, p, s) and not any(self.clash((c, p, s), v) for v in mine.get(c, ()))] for c in cover]
            for visits in itertools.product(*fitting):
                yield (*plan, *visits)


def solve_single(prob: Problem, objective: str, budget: int = 200_000, limits: dict[str, float] | None = None) -> Outcome:
    """The best schedule by one objective within ``budget`` nodes; ``limits`` bound other objectives (at most, or at least where more is better).

    ``optimal`` and ``infeasible`` are proofs. Where the budget ends first the status is ``feasible``
    or ``unknown`` and the bound is that of the best branch left open. Equal values keep the
    schedule found first; the order of the search is fixed, so results repeat.
    """
    tree, limits = _Tree(prob), limits or {}
    sign = tree.sign[objective]

    def kept(x: dict[str, float]) -> bool:
        return all(tree.sign[c] * x[c] <= tree.sign[c] * v + 1e-9 for c, v in limits.items())

    best: tuple[float, dict[str, float], Plan] | None = None
    root = tree.bounds((), 0)
    stack: list[tuple[float, int, Plan]] = [(sign * root[objective], 0, ())]
    nodes = 0
    while stack:
        low, depth, plan = stack.pop()
        if best and low >= best[0] - 1e-9:
            continue
        if nodes >= budget:
            stack.append((low, depth, plan))
            break
        nodes += 1
        if depth == len(tree.patients):
            score = prob.score(tuple(sorted(plan)))
            if kept(score) and prob.legal(plan) and (best is None or sign * score[objective] < best[0] - 1e-9):
                best = (sign * score[objective], score, tuple(sorted(plan)))
            continue
        young = []
        for child in tree.children(plan, depth):
            b = tree.bounds(child, depth + 1)
            if kept(b) and not (best and sign * b[objective] >= best[0] - 1e-9):
                young.append((sign * b[objective], depth + 1, child))
        stack += sorted(young, key=lambda x: -x[0])
    open_ = [low for low, _, _ in stack if best is None or low < best[0] - 1e-9]
    bound = min([*open_, *([best[0]] if best else [])], default=None)
    status = (INCUMBENT if open_ else PROVEN) if best else (OPEN if open_ else NONE)
    value = lambda x: None if x is None else sign * x + 0.0
    return Outcome(objective, status, value(best and best[0]), value(bound), nodes, best and best[1], best and best[2])


def solve_in_turn(prob: Problem, objectives: list[str], budget: int = 200_000, limits: dict[str, float] | None = None) -> Outcome:
    """The first objective's best and, among its schedules, the second's, and so on: a schedule that none within the limits dominates.

    Value, bound and gap are the first objective's; it is proven if every turn is.
    """
    held, first, last = dict(limits or {}), None, None
    for c in objectives:
        got = solve_single(prob, c, budget, held)
        first = first or got
        last = got if got.plan else last
        if got.status != PROVEN:
            status = got.status if got is first else INCUMBENT
            return Outcome(first.objective, status, first.value, first.bound, first.nodes, last and last.score, last and last.plan)
        held[c] = got.value
    return Outcome(first.objective, PROVEN, first.value, first.bound, first.nodes, last.score, last.plan)


_OUT = "solve int, objective string, status string, proven boolean, value double, bound double, gap double, nodes long, " + ", ".join(f"{c} double" for c in SENSES) + ", limits string"


def solves(spark: SparkSession, inst: Instance, jobs: list[tuple[str, dict[str, float]]], budget: int = 200_000) -> DataFrame:
    """One row for each (objective, limits), solved in a task of its own; the other objectives decide in turn among equals."""
    jobs = list(jobs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        prob = Problem(inst)
        for pdf in batches:
            rows = []
            for k in pdf["id"]:
                objective, limits = jobs[int(k)]
                o = solve_in_turn(prob, [objective, *(c for c in SENSES if c != objective)], budget, limits)
                said = ", ".join(f"{c}={v:g}" for c, v in sorted(limits.items()))
                rows.append((int(k), objective, o.status, o.proven, o.value, o.bound, o.gap, o.nodes, *((o.score or {}).get(c) for c in SENSES), said))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in _OUT.split(", ")])

    ids = spark.range(len(jobs)).repartition(max(1, len(jobs)), "id")
    return ids.mapInPandas(run, _OUT)


def payoff(spark: SparkSession, inst: Instance, budget: int = 200_000) -> DataFrame:
    """Each objective's own best, with the other objectives of that schedule."""
    return solves(spark, inst, [(c, {}) for c in SENSES], budget)


def epsilon_sweep(spark: SparkSession, inst: Instance, primary: str = "motion_m", grid: int = 3, budget: int = 200_000) -> DataFrame:
    """The primary objective's best under every combination of limits on the others.

    Limits are ``grid`` levels from each objective's best to its worst over the payoff table (five
    rows on the driver). One row a box as in :func:`solves`.
    """
    table = [r.asDict() for r in payoff(spark, inst, budget).where("value is not null").collect()]
    levels = []
    for c in SENSES:
        if c != primary:
            seen = [r[c] for r in table]
            lo, hi = min(seen, default=0.0), max(seen, default=0.0)
            levels.append([(c, x) for x in sorted({lo + (hi - lo) * k / max(1, grid - 1) for k in range(grid)})])
    return solves(spark, inst, [(primary, dict(box)) for box in itertools.product(*levels)], budget)


def sweep_front(outcomes: DataFrame) -> DataFrame:
    """Pareto front of a sweep's schedules, equal ones once: ``schedule_id, five objectives``."""
    found = outcomes.where("value is not null").groupBy(*SENSES).agg(F.min("solve").cast("bigint").alias("schedule_id"))
    return pareto_front(found.select("schedule_id", *SENSES))


def sweep_report(outcomes: DataFrame) -> DataFrame:
    """One row: solves, how many boxes are proven empty, whether all are proven, and the largest gap."""
    return outcomes.agg(
        F.count("*").alias("n_solves"), F.count_if(F.col("status") == NONE).alias("n_infeasible"), F.bool_and("proven").alias("all_proven"), F.max("gap").alias("largest_gap")
    )


