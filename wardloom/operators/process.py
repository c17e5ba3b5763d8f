"""Process discovery and conformance on event logs (case_id, activity, event_ts, seq)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardloom.operators.ordered import micros
from wardloom.operators.sharded import neighbour, time_block
from wardloom.session import bounded_rows, small_side

START, END = "__start__", "__end__"


class EmptyLog(ValueError):
    pass


def _with_next(log: DataFrame, block: Column | None) -> DataFrame:
    x = log.select("case_id", "activity", micros("event_ts").alias("_t"), "seq")
    return neighbour(x, ["case_id"], ["_t", "seq"], block if block is not None else time_block("_t"), {"_n": "activity"}, back=False)


def follows(log: DataFrame, block: Column | None = None) -> DataFrame:
    """Each event with the activity after it in its case, ``__end__`` for the last: ``case_id, activity, next``.

    Cases are ordered by time, then seq; a long case is worked on in blocks of time.
    """
    x = _with_next(log, block)
    return x.select("case_id", "activity", F.coalesce("_n", F.lit(END)).alias("next"))


def dfg(log: DataFrame) -> DataFrame:
    """Directly-follows counts ``a, b, n`` with ``__start__`` and ``__end__`` edges."""
    x = _with_next(log, None)
    firsts = log.groupBy("case_id").agg(F.min_by("activity", F.struct("event_ts", "seq")).alias("b")).groupBy("b").agg(F.count("*").alias("n"))
    inner = x.groupBy(F.col("activity").alias("a"), F.coalesce("_n", F.lit(END)).alias("b")).agg(F.count("*").alias("n"))
    return inner.unionByName(firsts.select(F.lit(START).alias("a"), "b", "n"))


def dependency(edges: DataFrame) -> DataFrame:
    """``a, b, n, dependency``: (ab - ba) / (ab + ba + 1) between activities, aa / (aa + 1) for a loop."""
    e = edges.where((F.col("a") != START) & (F.col("b") != END))
    back = e.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("n").alias("m"))
    m = F.coalesce("m", F.lit(0))
    value = F.when(F.col("a") == F.col("b"), F.col("n") / (F.col("n") + 1)).otherwise((F.col("n") - m) / (F.col("n") + m + 1))
    return e.join(back, ["a", "b"], "left").select("a", "b", "n", value.alias("dependency"))


def variants(log: DataFrame) -> DataFrame:
    """``trace, n_cases``; the trace is the case's activities in order. Cases must fit a task each."""
    t = F.transform(F.array_sort(F.collect_list(F.struct("event_ts", "seq", "activity"))), lambda e: e["activity"])
    return log.groupBy("case_id").agg(t.alias("trace")).groupBy("trace").agg(F.count("*").alias("n_cases"))


def discover(edges: DataFrame, algorithm: str = "inductive", threshold: float = 0.5, max_edges: int = 100_000) -> list[tuple[str, str]]:
    """Arcs of a model from directly-follows counts: all of them, or those of a dependency of at least ``threshold``.

    The heuristic keeps start and end arcs and each activity's strongest arc out, so that no
    activity is cut off. The counts are bounded by the alphabet squared.
    """
    rows = bounded_rows(edges, max_edges, "the directly-follows table")
    if not rows:
        raise EmptyLog("the log has no events")
    if algorithm == "inductive":
        return sorted((r["a"], r["b"]) for r in rows)
    if algorithm != "heuristics":
        raise ValueError(f"unknown algorithm {algorithm!r}")
    n = {(r["a"], r["b"]): r["n"] for r in rows}
    keep = set()
    for (a, b), k in n.items():
        m = n.get((b, a), 0) if a != b else 0
        value = k / (k + 1) if a == b else (k - m) / (k + m + 1)
        if START == a or END == b or value >= threshold:
            keep.add((a, b))
    for a in {a for a, _ in n}:
        keep.add(max(((a, b) for x, b in n if x == a), key=lambda e: (n[e], e)))
    return sorted(keep)


#: A process tree: an activity's name, or an operator (xor, seq, and, loop, flower) with its parts; TAU does nothing.
Tree = str | tuple[str, list]
TAU = ("tau", [])


def tree_text(tree: Tree) -> str:
    return tree if isinstance(tree, str) else tree[0] + (f"({', '.join(map(tree_text, tree[1]))})" if tree[1] else "")


def process_tree(arcs: list[tuple[str, str]]) -> str:
    """The tree of :func:`mine_tree` as text."""
    return tree_text(mine_tree(arcs))


def activity_sets(log: DataFrame, limit: int = 100_000) -> list[frozenset[str]]:
    """The distinct sets of activities that cases hold, on the driver; refuses more than ``limit``."""
    sets = log.groupBy("case_id").agg(F.array_sort(F.collect_set("activity")).alias("s")).select("s").distinct()
    return [frozenset(r["s"]) for r in bounded_rows(sets, limit, "the table of activity sets")]


def mine_tree(arcs: list[tuple[str, str]], sets: list[frozenset[str]] = ()) -> Tree:
    """Process tree of a directly-follows graph by exclusive, sequence, parallel and loop cuts; ``flower`` where none fits.

    A part of a sequence that an arc leads past may be left out, and so may a part of a sequence or of
    a parallel block that some case lacks which holds others of the block; ``sets`` are the sets of
    activities of cases (see :func:`activity_sets`).
    """
    acts = sorted({x for e in arcs for x in e} - {START, END})
    starts, ends = {b for a, b in arcs if a == START}, {a for a, b in arcs if b == END}
    return _tree(acts, {(a, b) for a, b in arcs if a != START and b != END}, starts, ends, sets)


def _components(nodes: list[str], linked) -> list[list[str]]:  # noqa: ANN001
    left, out = set(nodes), []
    while left:
        group, todo = set(), [min(left)]
        while todo:
            x = todo.pop()
            if x in group:
                continue
            group.add(x)
            todo += [y for y in left if y not in group and linked(x, y)]
        left -= group
        out.append(sorted(group))
    return sorted(out)


def _tree(acts: list[str], arcs: set[tuple[str, str]], starts: set[str], ends: set[str], sets: list[frozenset[str]]) -> Tree:
    if len(acts) == 1:
        a = acts[0]
        return ("loop", [a, TAU]) if (a, a) in arcs else a

    def sub(part: list[str]) -> Tree:
        p = set(part)
        into = {b for a, b in arcs if b in p and a not in p} | (starts & p)
        out = {a for a, b in arcs if a in p and b not in p} | (ends & p)
        return _tree(part, {(a, b) for a, b in arcs if a in p and b in p}, into, out, sets)

    def lacking(part: list[str]) -> bool:
        return any(s & whole and not s & set(part) for s in sets)

    whole = set(acts)

    parts = _components(acts, lambda x, y: (x, y) in arcs or (y, x) in arcs)
    if len(parts) > 1:
        return ("xor", [sub(p) for p in parts])
    reach = {a: {a} for a in acts}
    changed = True
    while changed:
        changed = False
        for a, b in arcs:
            for r in reach.values():
                if a in r and b not in r:
                    r.add(b)
                    changed = True
    parts = _components(acts, lambda x, y: (y in reach[x]) == (x in reach[y]))
    if len(parts) > 1:
        order = sorted(parts, key=lambda p: -len(reach[p[0]]))
        at = {a: i for i, p in enumerate(order) for a in p}
        spans = [(at[a], at[b]) for a, b in arcs] + [(-1, at[a]) for a in starts] + [(at[a], len(order)) for a in ends]
        past = [any(i < k < j for i, j in spans) for k in range(len(order))]
        return ("seq", [("xor", [TAU, sub(p)]) if skip or lacking(p) else sub(p) for p, skip in zip(order, past)])
    parts = _components(acts, lambda x, y: not ((x, y) in arcs and (y, x) in arcs))
    if len(parts) > 1 and all(set(p) & starts and set(p) & ends for p in parts):
        return ("and", [("xor", [TAU, sub(p)]) if lacking(p) else sub(p) for p in parts])
    body = starts | ends
    rest = [a for a in acts if a not in body]
    groups = _components(rest, lambda x, y: (x, y) in arcs or (y, x) in arcs)
    redo = [g for g in groups if {b for a, b in arcs if a in g and b in body} <= starts and {a for a, b in arcs if b in g and a in body} <= ends]
    do = sorted(body | {a for g in groups if g not in redo for a in g})
    if redo and len(do) < len(acts):
        return ("loop", [sub(do), *map(sub, redo)])
    if starts <= ends | starts and any((e, s) in arcs for e in ends for s in starts) and len(acts) > 1:
        inner = {(a, b) for a, b in arcs if not (a in ends and b in starts)}
        if inner != arcs and len(_components(acts, lambda x, y: (x, y) in inner or (y, x) in inner)) == 1:
            return ("loop", [_tree(acts, inner, starts, ends, sets), TAU])
    return ("flower", list(acts))


def _replay(arcs: set[tuple[str, str]]):
    """Token replay of a trace on the net with one place for each activity reached: produced, consumed, missing, remaining."""
    known = {x for e in arcs for x in e}

    def trace(t: list[str]) -> tuple[int, int, int, int, int]:
        at, produced, consumed, missing, problems = START, 1, 0, 0, 0
        for b in [*t, END]:
            consumed, produced = consumed + 1, produced + (b != END)
            if b not in known:
                problems += b != END
                missing += 1
            elif (at, b) not in arcs:
                missing += 1
                problems += b != END and any(x == at for x, _ in arcs)
            at = b
        return produced, consumed, missing, missing, problems

    return trace


def conformance(log: DataFrame, arcs: list[tuple[str, str]]) -> DataFrame:
    """Token replay of every case: ``case_id, produced, consumed, missing, remaining, fitness, bucket``.

    Equal traces are replayed once. Fitness is (1 - missing/consumed)/2 + (1 - remaining/produced)/2.
    A case is ``deviating`` if a step of it isn't allowed or unknown, else ``missing-data`` if it
    doesn't fit (it breaks off), else ``clean``. Cases must fit a task each.
    """
    replay = _replay(set(map(tuple, arcs)))
    t = F.transform(F.array_sort(F.collect_list(F.struct("event_ts", "seq", "activity"))), lambda e: e["activity"])
    cases = log.groupBy("case_id").agg(t.alias("trace"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(list(x), *replay(list(x))) for x in pdf["trace"]]
            yield pd.DataFrame(rows, columns=["trace", "produced", "consumed", "missing", "remaining", "problems"])

    played = cases.select("trace").distinct().mapInPandas(run, "trace array<string>, produced int, consumed int, missing int, remaining int, problems int")
    fit = 0.5 * (1 - F.col("missing") / F.col("consumed")) + 0.5 * (1 - F.col("remaining") / F.col("produced"))
    bucket = F.when(F.col("problems") > 0, "deviating").when(F.col("missing") > 0, "missing-data").otherwise("clean")
    return cases.join(small_side(played), "trace").select("case_id", "produced", "consumed", "missing", "remaining", fit.alias("fitness"), bucket.alias("bucket"))


def log_fitness(replayed: DataFrame) -> DataFrame:
    """One row: fitness over all tokens, and cases in each bucket."""
    s = replayed.agg(*(F.sum(c).alias(c) for c in ("produced", "consumed", "missing", "remaining")), F.count_if(F.col("bucket") == "deviating").alias("n_deviating"), F.count_if(F.col("bucket") == "missing-data").alias("n_missing_data"), F.count("*").alias("n_cases"))
    return s.select("n_cases", "n_deviating", "n_missing_data", (0.5 * (1 - F.col("missing") / F.col("consumed")) + 0.5 * (1 - F.col("remaining") / F.col("produced"))).alias("fitness"))


def precision(edges: DataFrame, arcs: list[tuple[str, str]]) -> DataFrame:
    """One row ``precision``: share of what the model allows after each activity that the log shows, weighted by how often it is left."""
    spark = edges.sparkSession
    allowed = spark.createDataFrame(arcs, "a string, b string").groupBy("a").agg(F.count("*").alias("n_allowed"))
    inside = edges.join(F.broadcast(spark.createDataFrame(arcs, "a string, b string")), ["a", "b"], "left_semi")
    seen = inside.groupBy("a").agg(F.count("*").alias("n_seen"), F.sum("n").alias("w"))
    x = allowed.join(seen, "a")
    return x.agg((1 - F.sum(F.col("w") * (F.col("n_allowed") - F.col("n_seen"))) / F.sum(F.col("w") * F.col("n_allowed"))).alias("precision"))
