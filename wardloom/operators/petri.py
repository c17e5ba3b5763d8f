"""Petri nets of process trees, token replay with silent transitions, precision by escaping edges."""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardloom.operators.process import Tree
from wardloom.session import small_side

#: Markings looked at for one step of silent transitions; block-structured nets need far fewer.
MOST_MARKINGS = 10_000

Marking = tuple[int, ...]


@dataclass
class Net:
    """Places by number, 0 the source and 1 the sink; transitions as (activity or None, places in, places out)."""

    n_places: int = 2
    transitions: list[tuple[str | None, tuple[int, ...], tuple[int, ...]]] = field(default_factory=list)

    def place(self) -> int:
        self.n_places += 1
        return self.n_places - 1

    def add(self, label: str | None, into: list[int], out: list[int]) -> None:
        self.transitions.append((label, tuple(into), tuple(out)))


def net_of_tree(tree: Tree) -> Net:
    """The workflow net of a process tree: block by block, with silent transitions for splits, joins, loops and skips."""
    net = Net()

    def lay(t: Tree, a: int, z: int) -> None:
        if isinstance(t, str):
            return net.add(t, [a], [z])
        op, parts = t
        if op == "tau":
            return net.add(None, [a], [z])
        if op == "xor":
            for p in parts:
                lay(p, a, z)
        elif op == "seq":
            stops = [a, *(net.place() for _ in parts[1:]), z]
            for p, x, y in zip(parts, stops, stops[1:]):
                lay(p, x, y)
        elif op == "and":
            pairs = [(net.place(), net.place()) for _ in parts]
            net.add(None, [a], [x for x, _ in pairs])
            net.add(None, [y for _, y in pairs], [z])
            for p, (x, y) in zip(parts, pairs):
                lay(p, x, y)
        else:  # loop and flower: in by a silent transition, round, and out by another
            x, y = net.place(), net.place()
            net.add(None, [a], [x])
            net.add(None, [y], [z])
            if op == "loop":
                lay(parts[0], x, y)
                for p in parts[1:]:
                    lay(p, y, x)
            else:
                net.add(None, [x], [y])
                for p in parts:
                    lay(p, x, x)

    lay(tree, 0, 1)
    return net


class Player:
    """Replays traces on one net; silent ways between markings are found by breadth and remembered."""

    def __init__(self, net: Net) -> None:
        self.net = net
        self.silent = [t for t in net.transitions if t[0] is None]
        self.labelled: dict[str, list] = {}
        for t in net.transitions:
            if t[0] is not None:
                self.labelled.setdefault(t[0], []).append(t)
        self.ways: dict[Marking, dict[Marking, tuple[int, int]]] = {}

    def near(self, start: Marking) -> dict[Marking, tuple[int, int]]:
        """Markings that silent transitions reach, the nearest first, with tokens consumed and produced on the way."""
        if start not in self.ways:
            found, todo = {start: (0, 0)}, deque([start])
            while todo and len(found) < MOST_MARKINGS:
                m = todo.popleft()
                for _, into, out in self.silent:
                    if all(m[p] for p in into):
                        new = self.fire(m, into, out)
                        if new not in found:
                            found[new] = (found[m][0] + len(into), found[m][1] + len(out))
                            todo.append(new)
            self.ways[start] = found
        return self.ways[start]

    @staticmethod
    def fire(m: Marking, into: tuple[int, ...], out: tuple[int, ...]) -> Marking:
        x = list(m)
        for p in into:
            x[p] -= 1
        for p in out:
            x[p] += 1
        return tuple(x)

    def enabled(self, m: Marking) -> set[str]:
        """Activities that can come next, after silent transitions."""
        return {a for a, ts in self.labelled.items() if any(all(x[p] for p in t[1]) for x in self.near(m) for t in ts)}

    def play(self, trace: list[str]) -> tuple[int, int, int, int, int, list[set[str]]]:
        """Produced, consumed, missing, remaining, steps with problems, and what was enabled before each step while none had any.

        An activity that the net doesn't know is a problem but moves no token.
        """
        m: Marking = (1, *[0] * (self.net.n_places - 1))
        produced, consumed, missing, problems, allowed = 1, 0, 0, 0, []
        for a in trace:
            if not problems:
                allowed.append(self.enabled(m))
            ts = self.labelled.get(a)
            if not ts:
                problems += 1
                continue
            hit = next(((x, t, way) for x, way in self.near(m).items() for t in ts if all(x[p] for p in t[1])), None)
            if hit:
                m, (_, into, out), way = hit[0], hit[1], hit[2]
                consumed, produced = consumed + way[0], produced + way[1]
            else:
                problems += 1
                _, into, out = ts[0]
                lack = Counter(p for p in into if not m[p])
                missing += sum(lack.values())
                m = tuple(k + lack.get(p, 0) for p, k in enumerate(m))
            m = self.fire(m, into, out)
            consumed, produced = consumed + len(into), produced + len(out)
        if not problems:
            allowed.append(self.enabled(m))
        end = next(((x, way) for x, way in self.near(m).items() if x[1] and sum(x) == 1), None) or next(((x, way) for x, way in self.near(m).items() if x[1]), None)
        if end:
            m, way = end
            consumed, produced = consumed + way[0], produced + way[1]
            m = tuple(k - (p == 1) for p, k in enumerate(m))
        else:
            missing += 1
        return produced, consumed + 1, missing, sum(m), problems, allowed


def _traces(log: DataFrame) -> DataFrame:
    t = F.transform(F.array_sort(F.collect_list(F.struct("event_ts", "seq", "activity"))), lambda e: e["activity"])
    return log.groupBy("case_id").agg(t.alias("trace"))


def replay(log: DataFrame, net: Net) -> DataFrame:
    """Token replay of every case: ``case_id, produced, consumed, missing, remaining, fitness, bucket``.

    Equal traces are replayed once. Fitness is (1 - missing/consumed)/2 + (1 - remaining/produced)/2.
    A case is ``deviating`` if a step wasn't enabled or isn't known, else ``missing-data`` if tokens
    are missing or remain (it breaks off), else ``clean``. Cases must fit a task each.
    """
    cases = _traces(log)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        player = Player(net)
        for pdf in batches:
            yield pd.DataFrame([(list(x), *player.play(list(x))[:5]) for x in pdf["trace"]], columns=["trace", "produced", "consumed", "missing", "remaining", "problems"])

    played = cases.select("trace").distinct().mapInPandas(run, "trace array<string>, produced int, consumed int, missing int, remaining int, problems int")
    fit = 0.5 * (1 - F.col("missing") / F.col("consumed")) + 0.5 * (1 - F.col("remaining") / F.col("produced"))
    bucket = F.when(F.col("problems") > 0, "deviating").when(F.col("missing") + F.col("remaining") > 0, "missing-data").otherwise("clean")
    return cases.join(small_side(played), "trace").select("case_id", "produced", "consumed", "missing", "remaining", fit.alias("fitness"), bucket.alias("bucket"))


def escaping_precision(log: DataFrame, net: Net) -> DataFrame:
    """One row ``precision``: of what the net allows after each beginning of a trace, the share that the log goes on with, weighted by cases.

    Beginnings count as far as a trace fits. Variants are replayed once; a beginning is known by a
    hash of its activities, and beginnings are added up by it.
    """
    variants = _traces(log).groupBy("trace").agg(F.count("*").alias("n"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        player = Player(net)
        for pdf in batches:
            rows = []
            for trace, n in zip(pdf["trace"], pdf["n"]):
                t = list(trace)
                for k, may in enumerate(player.play(t)[5]):
                    rows.append(("\x1f".join(t[:k]), t[k] if k < len(t) and t[k] in may else None, len(may), int(n)))
            yield pd.DataFrame(rows, columns=["begun", "next", "allowed", "n"])

    steps = variants.mapInPandas(run, "begun string, next string, allowed int, n bigint").withColumn("begun", F.sha2("begun", 256))
    states = steps.groupBy("begun").agg(F.sum("n").alias("n"), F.count_distinct("next").alias("seen"), F.max("allowed").alias("allowed")).where("allowed > 0")
    return states.agg((1 - F.sum(F.col("n") * (F.col("allowed") - F.col("seen"))) / F.sum(F.col("n") * F.col("allowed"))).alias("precision"))
