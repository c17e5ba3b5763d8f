"""Dwell episodes at the bedside, rounds and the sensitivity of episode counts to the dwell threshold."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardloom.operators.ordered import changes, from_micros, micros, range_sorted
from wardloom.session import cut, small_side


@dataclass(frozen=True)
class EpisodeParams:
    """Thresholds of episode derivation."""

    min_dwell_s: float = 120
    max_gap_s: float = 90
    min_confidence: float = 0.8

    def __post_init__(self) -> None:
        if self.min_dwell_s < 0 or self.max_gap_s < 0 or not 0 <= self.min_confidence <= 1:
            raise ValueError("thresholds out of range")


# Rows that leave the scan: a finished stay; one that holds if the stretch at the partition's start has
# the first activity ``cond``; a piece of a stay at the partition's edge, with or without such a
# condition (``others`` lists the conditions of which none may hold); the edge itself.
STAY, IF_STAY, PIECE, IF_PIECE, ELSE_PIECE, EDGE = range(6)
_ROW = [
    ("kind", "int"), ("part", "int"), ("subject", "string"), ("place", "string"), ("a", "bigint"), ("b", "bigint"), ("n", "bigint"), ("c", "double"),
    ("cond", "string"), ("others", "array<string>"), ("first", "boolean"), ("act", "string"), ("last_place", "string"), ("last_act", "string"),
]
_DDL = ", ".join(f"{c} {t}" for c, t in _ROW)
_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
_SCHEMA = pa.schema([(c, _ARROW[t]) for c, t in _ROW])


class _Walk:
    """One subject's fragments in order: stays that are complete, and pieces where a partition's edge is near.

    A fragment is a stretch of events at one place without a pause above the gap, as a list
    [start, end, events, least confidence]. ``head``: earlier fragments may lie in another partition,
    so the first activity of the first stretch isn't known, and stays that begin within the gap of
    what lies before leave as pieces.
    """

    def __init__(self, subject: str, head: bool, gap: int, out: list[tuple], part: int) -> None:
        self.subject, self.head, self.gap, self.out, self.part = subject, head, gap, out, part
        self.place: str | None = None
        self.act = ""  # first activity of the current stretch
        self.block: list | None = None
        self.stays: dict[str, tuple[list, bool]] = {}  # place -> stay that may go on, whether it may have begun before
        self.before = None  # last instant that what lies before the known part may reach
        self.start: tuple | None = None  # place, time and activity of the subject's first event here
        # First stretch of a head: all of it, and for each activity after a pause the part before and the last part.
        self.whole: list | None = None
        self.split: dict[str, tuple[list, list]] = {}

    def put(self, kind: int, place: str, x: list, cond: str | None = None, others: list | None = None, first: bool = False, act: str | None = None) -> None:
        self.out.append((kind, self.part, self.subject, place, *x, cond, others, first, act, None, None))

    def fragment(self, place: str, act: str, x: list) -> None:
        if self.start is None:
            self.start = (place, x[0], act)
            self.before = x[0] if self.head else None
            if self.head:
                self.place, self.whole = place, x
                return
        if self.whole is not None:
            if place == self.place:
                self._in_first_stretch(act, x)
                return
            self._leave_first_stretch()
        if place == self.place and self.block is not None:
            if act == self.act:
                self._close()
                self.block = x
            else:
                _extend(self.block, x)
        else:
            self._close()
            self.place, self.act, self.block = place, act, x
        for p in [p for p, (stay, _) in self.stays.items() if p != place and x[0] - stay[1] > self.gap]:
            self._finish(p)

    def _in_first_stretch(self, act: str, x: list) -> None:
        if act in self.split:
            self.put(IF_STAY, self.place, self.split[act][1], cond=act)
            self.split[act] = (self.split[act][0], list(x))
        for y, (_, last) in self.split.items():
            if y != act:
                _extend(last, x)
        if act not in self.split:
            self.split[act] = (list(self.whole), list(x))
        _extend(self.whole, x)

    def _leave_first_stretch(self) -> None:
        first_act = self.start[2]
        self.put(ELSE_PIECE, self.place, self.whole, others=sorted(self.split), first=True, act=first_act)
        for y, (prefix, last) in sorted(self.split.items()):
            self.put(IF_PIECE, self.place, prefix, cond=y, first=True, act=first_act)
            self.put(IF_PIECE, self.place, last, cond=y)
        self.before, self.whole, self.split = self.whole[1], None, {}

    def _close(self) -> None:
        """The block ends; it joins the stay at its place if that is near enough."""
        if self.block is None:
            return
        stay, p = self.stays.get(self.place), self.place
        if stay and self.block[0] - stay[0][1] <= self.gap:
            _extend(stay[0], self.block)
        else:
            if stay:
                self._finish(p)
            self.stays[p] = (self.block, self.before is not None and self.block[0] <= self.before + self.gap)
        self.block = None

    def _finish(self, place: str) -> None:
        stay, open_ = self.stays.pop(place)
        self.put(PIECE if open_ else STAY, place, stay)

    def end(self, tail: bool) -> None:
        """``tail``: later fragments may lie in another partition."""
        last_place, last_act = self.place, None if self.whole is not None else self.act
        if self.whole is not None:
            self._leave_first_stretch()
        reach = None if self.block is None else self.block[1]
        self._close()
        for p in list(self.stays):
            stay, open_ = self.stays.pop(p)
            near = tail and (p == last_place or reach is None or reach - stay[1] <= self.gap)
            self.put(PIECE if open_ or near else STAY, p, stay)
        if self.head or tail:
            place, t, act = self.start
            self.out.append((EDGE, self.part, self.subject, place, t, None, None, None, None, None, None, act, last_place, last_act))


def _extend(x: list, y: list) -> None:
    x[1], x[2], x[3] = y[1], x[2] + y[2], min(x[3], y[3])


def _scan(gap: int):
    """Partition reader: rows sorted by subject, time and seq to the rows above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        out: list[tuple] = []
        walk: _Walk | None = None
        held: tuple | None = None  # subject, place, activity, fragment that the next batch may go on with

        def flush() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _SCHEMA)], schema=_SCHEMA)
            out.clear()
            return rows

        def step(subject: str, place: str, act: str, x: list) -> None:
            nonlocal walk
            if walk is None or walk.subject != subject:
                if walk is not None:
                    walk.end(False)
                walk = _Walk(subject, walk is None, gap, out, part)
            walk.fragment(place, act, x)

        for b in batches:
            if not b.num_rows:
                continue
            subject, place, act = b.column(0), b.column(3), b.column(4)
            t, conf = b.column(1).to_numpy(), b.column(5).to_numpy()
            before = held or (None, None, None, [0, 0, 0, 0.0])
            new = changes(subject, before[0]) | changes(place, before[1])
            new[0] |= held is None or t[0] - before[3][1] > gap
            new[1:] |= np.diff(t) > gap
            starts = np.flatnonzero(new)
            lead = int(starts[0]) if len(starts) else len(t)
            if lead:
                _extend(held[3], [0, int(t[lead - 1]), lead, float(conf[:lead].min())])
            if not len(starts):
                continue
            ends, take = np.append(starts[1:], len(t)), pa.array(starts)
            least = np.minimum.reduceat(conf, starts).tolist()
            rows = zip(subject.take(take).to_pylist(), place.take(take).to_pylist(), act.take(take).to_pylist(), t[starts].tolist(), t[ends - 1].tolist(), (ends - starts).tolist(), least)
            for who, where, what, a, z, n, c in rows:
                if held is not None:
                    step(*held)
                held = (who, where, what, [a, z, n, c])
            if len(out) >= 4096:
                yield flush()
        if held is not None:
            step(*held)
            walk.end(True)
        if out:
            yield flush()

    return run


def dwell_runs(events: DataFrame, params: EpisodeParams = EpisodeParams()) -> DataFrame:
    """Merged stays of clinicians at a place, before the dwell threshold.

    Input ``seq, event_ts, subject_kind, subject, activity, place, confidence``; output
    ``clinician, place, start_us, end_us, n_events, confidence`` (the least of its events).

    Events below the confidence threshold, of other kinds than clinician, or without subject,
    place or time are left out; the rest are ordered by time, then seq. A stretch at one place is
    cut into blocks before an event that repeats the stretch's first activity after a pause of
    more than ``max_gap_s``; blocks at the same place at most ``max_gap_s`` apart are one stay,
    also when the clinician was elsewhere in between. A null activity repeats a null one.

    Plan: one range exchange on (subject, time, seq), a sort and one scan that holds only the stays
    of the last ``max_gap_s``. What the scan puts out, a row for each stay and a few for each
    partition's edges, is written once to the shared checkpoint folder. At an edge it isn't known
    with which activity the stretch began, so the stays that depend on it leave once for each
    activity that would matter; the edges, one row for each partition and subject, tell which hold,
    and the pieces at the edges are joined. No subject's events gather in one task, however
    densely it is seen.
    """
    gap = round(params.max_gap_s * 1_000_000)
    x = events.where(
        (F.col("subject_kind") == "clinician") & (F.col("confidence") >= params.min_confidence) & F.col("subject").isNotNull() & F.col("place").isNotNull() & F.col("event_ts").isNotNull()
    ).select("subject", micros("event_ts").alias("t"), "seq", "place", F.coalesce("activity", F.lit("")).alias("activity"), "confidence")
    rows = cut(range_sorted(x, ["subject"], ["t", "seq"]).mapInArrow(_scan(gap), _DDL))

    by = Window.partitionBy("subject").orderBy("part")
    edges = rows.where(F.col("kind") == EDGE).select("subject", "part", "place", F.col("act").alias("first_act"), "last_place", "last_act")
    edges = edges.withColumn("on", F.coalesce(F.lag("last_place").over(by) == F.col("place"), F.lit(False)))
    after = F.coalesce("last_act", F.when(~F.col("on"), F.col("first_act")))
    edges = edges.withColumn("after", F.last(after, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    # The first activity of the stretch at each partition's start.
    edges = edges.select("subject", "part", "on", F.when(F.col("on"), F.lag("after").over(by)).otherwise(F.col("first_act")).alias("x"))
    held = rows.where(F.col("kind").isin(IF_STAY, PIECE, IF_PIECE, ELSE_PIECE)).join(edges, ["subject", "part"])
    held = held.where((F.col("kind") == PIECE) | (F.col("cond") == F.col("x")) | ((F.col("kind") == ELSE_PIECE) & ~F.array_contains("others", F.col("x"))))
    stay = ["subject", "place", "a", "b", "n", "c"]
    w = Window.partitionBy("subject", "place").orderBy("part", "a", "b")
    near = F.col("a") - F.lag("b").over(w) <= gap
    joined = F.when(F.col("first") & F.col("on"), near | (F.col("act") != F.col("x"))).otherwise(near)
    pieces = held.where(F.col("kind") != IF_STAY).withColumn("fresh", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1))
    pieces = pieces.withColumn("g", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = pieces.groupBy("subject", "place", "g").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.sum("n").alias("n"), F.min("c").alias("c"))
    out = rows.where(F.col("kind") == STAY).select(*stay).unionByName(held.where(F.col("kind") == IF_STAY).select(*stay)).unionByName(merged.select(*stay))
    return out.select(F.col("subject").alias("clinician"), "place", F.col("a").alias("start_us"), F.col("b").alias("end_us"), F.col("n").alias("n_events"), F.col("c").alias("confidence"))


def episodes(events: DataFrame, params: EpisodeParams = EpisodeParams(), places: DataFrame | None = None) -> DataFrame:
    """Stays of at least ``min_dwell_s``: ``clinician, bed, start, end, dwell_s, n_events, confidence``.

    ``places(bed)`` restricts them to beds. A stay of one event is kept only at threshold 0.
    """
    runs = dwell_runs(events, params).where(F.col("end_us") - F.col("start_us") >= round(params.min_dwell_s * 1_000_000))
    if places is not None:
        runs = runs.join(small_side(places.select(F.col("bed").alias("place")).distinct()), "place", "left_semi")
    return runs.select(
        "clinician", F.col("place").alias("bed"), from_micros("start_us").alias("start"), from_micros("end_us").alias("end"),
        ((F.col("end_us") - F.col("start_us")) / 1_000_000).alias("dwell_s"), "n_events", "confidence",
    )


def attach_patients(eps: DataFrame, occupancy: DataFrame) -> DataFrame:
    """Patient of the bed; a bed without one keeps null, or what the episode already had."""
    o = occupancy.select("bed", F.col("patient").alias("_patient")).dropDuplicates(["bed"])
    had = F.col("patient") if "patient" in eps.columns else F.lit(None).cast("string")
    out = eps.join(small_side(o), "bed", "left").withColumn("patient", F.coalesce(F.col("_patient"), had))
    return out.drop("_patient")


def attach_specialties(eps: DataFrame, roster: DataFrame) -> DataFrame:
    """Specialties of the clinician, sorted; an empty array for one who isn't on the roster or has none."""
    r = roster.select("clinician", F.array_sort(F.array_distinct(F.coalesce("specialties", F.array().cast("array<string>")))).alias("specialties")).dropDuplicates(["clinician"])
    out = eps.join(small_side(r), "clinician", "left")
    return out.withColumn("specialties", F.coalesce("specialties", F.array().cast("array<string>")))


def rounds(eps: DataFrame) -> DataFrame:
    """Episodes with ``day`` and ``stop_no``: their place in the clinician's round of that day, by start, then bed."""
    w = Window.partitionBy("clinician", "day").orderBy("start", "bed")
    return eps.withColumn("day", F.to_date("start")).withColumn("stop_no", F.row_number().over(w))


def dwell_sensitivity(events: DataFrame, base: EpisodeParams, dwell_values: tuple[float, ...] = (60, 120, 180, 300), known_visits: int | None = None) -> DataFrame:
    """Episodes found at each dwell threshold in one pass over the merged stays; recall against ``known_visits``."""
    runs = dwell_runs(events, base)
    dwell = F.col("end_us") - F.col("start_us")
    counts = runs.agg(*(F.count_if(dwell >= round(v * 1_000_000)).alias(f"d{i}") for i, v in enumerate(dwell_values)))
    rows = F.array(*(F.struct(F.lit(float(v)).alias("min_dwell_s"), F.col(f"d{i}").alias("n_episodes")) for i, v in enumerate(dwell_values)))
    out = counts.select(F.explode(rows).alias("r")).select("r.*")
    return out if known_visits is None else out.withColumn("recall", F.col("n_episodes") / F.lit(float(known_visits)))


def stable_within(sensitivity: DataFrame, tolerance: float) -> DataFrame:
    """One row ``stable``: whether every recall lies within ``tolerance`` of their mean; true of none."""
    mean = sensitivity.agg(F.avg("recall").alias("m"), F.max("recall").alias("hi"), F.min("recall").alias("lo"))
    return mean.select(F.coalesce(F.greatest(F.col("hi") - F.col("m"), F.col("m") - F.col("lo")) <= tolerance, F.lit(True)).alias("stable"))
