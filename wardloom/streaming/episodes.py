"""Dwell episodes over a stream of events, by custom state for each subject."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wardloom.operators.episodes import EpisodeParams

_OUT = "clinician string, bed string, start timestamp, end timestamp, n_events long, confidence double"


class Tracker:
    """Open block and open stays of one subject; the rules of batch episodes, one event at a time."""

    def __init__(self, params: EpisodeParams, saved: dict[str, Any] | None = None) -> None:
        self.gap, self.least = params.max_gap_s, params.min_dwell_s
        s = saved or {}
        self.place, self.first, self.last = s.get("place"), s.get("first"), s.get("last")
        self.stays: dict[str, list[float]] = s.get("stays", {})  # place -> start, end, events, confidence
        self.done: list[tuple[str, float, float, int, float]] = []

    def saved(self) -> dict[str, Any]:
        return {"place": self.place, "first": self.first, "last": self.last, "stays": self.stays}

    def _finish(self, place: str) -> None:
        a, b, n, c = self.stays.pop(place)
        if b - a >= self.least:
            self.done.append((place, a, b, int(n), c))

    def add(self, t: float, place: str, activity: str, confidence: float) -> None:
        if place != self.place:
            self.place, self.first, cut = place, activity, True
        else:
            cut = activity == self.first and t - self.last > self.gap
        stay = self.stays.get(place)
        if stay and cut and t - stay[1] > self.gap:
            self._finish(place)
            stay = None
        if stay:
            stay[1], stay[2], stay[3] = max(stay[1], t), stay[2] + 1, min(stay[3], confidence)
        else:
            self.stays[place] = [t, t, 1, confidence]
        self.last = t

    def expire(self, now: float) -> None:
        """Finish stays that no later event can extend: left, and ended more than the gap ago."""
        for place in [p for p, s in self.stays.items() if p != self.place and now - s[1] > self.gap]:
            self._finish(place)

    def close(self) -> None:
        for place in list(self.stays):
            self._finish(place)


def stream_episodes(events: DataFrame, params: EpisodeParams = EpisodeParams(), delay: str = "30 seconds", idle_s: float = 3600) -> DataFrame:
    """Episodes of a stream of events ``event_ts, subject_kind, subject, activity, place, confidence``.

    A stay comes out once its clinician has gone elsewhere and the gap has passed, or after
    ``idle_s`` without events. Rows later than ``delay`` are dropped by the watermark; rows that
    arrive together are ordered by time. For input in order the result is that of the batch.
    """
    e = events.where("subject_kind = 'clinician' and subject is not null and place is not null").where(F.col("confidence") >= params.min_confidence)
    e = e.select(F.col("event_ts").cast("timestamp").alias("event_ts"), "subject", F.coalesce("activity", F.lit("")).alias("activity"), "place", "confidence").withWatermark("event_ts", delay)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        t = Tracker(params, json.loads(state.get[0]) if state.exists else None)
        if state.hasTimedOut:
            t.close()
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values("event_ts", kind="stable")
            for r in rows.itertuples(index=False):
                now = r.event_ts.timestamp()
                t.add(now, r.place, r.activity, r.confidence)
                t.expire(now)
            state.update((json.dumps(t.saved()),))
            last = max(t.last, state.getCurrentWatermarkMs() / 1000)
            state.setTimeoutTimestamp(int((last + idle_s) * 1000))
        if t.done:
            yield pd.DataFrame([(key[0], p, pd.Timestamp(a, unit="s"), pd.Timestamp(b, unit="s"), n, c) for p, a, b, n, c in t.done], columns=["clinician", "bed", "start", "end", "n_events", "confidence"])

    return e.groupBy("subject").applyInPandasWithState(run, _OUT, "saved string", "append", GroupStateTimeout.EventTimeTimeout)


def stream_counts(events: DataFrame, window: str = "10 minutes", delay: str = "5 minutes") -> DataFrame:
    """Events for each place and tumbling window, late rows within ``delay`` included."""
    e = events.withColumn("event_ts", F.col("event_ts").cast("timestamp")).withWatermark("event_ts", delay)
    c = e.groupBy(F.window("event_ts", window).alias("w"), "place").agg(F.count("*").alias("n_events"))
    return c.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "place", "n_events")
