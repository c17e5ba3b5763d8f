"""Grouping activity into sessions: one sorted linear scan with constant memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardloom.functions.keys import id_key, kind_key
from wardloom.operators.ordered import changes, from_micros, micros, range_sorted

_SCAN = "kind string, subject string, first_seq bigint, t0 bigint, t1 bigint, n bigint, edge int"
_ARROW = pa.schema(
    [("kind", pa.string()), ("subject", pa.string()), ("first_seq", pa.int64()), ("t0", pa.int64()), ("t1", pa.int64()), ("n", pa.int64()), ("edge", pa.int32())]
)
HEAD, TAIL = 1, 2


def _scan(gap_us: int):
    """Partition reader: sorted (kind, subject, t, seq) batches to session rows.

    Holds one open session between batches. ``edge`` is 1 for the first session of the
    partition, 2 for the last, 3 for both, else 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list | None = None  # kind, subject, first_seq, t0, t1, n
        first = True

        def emit(rows: list[np.ndarray | list], edge: np.ndarray) -> pa.RecordBatch:
            cols = [pa.array(rows[0], pa.string()), pa.array(rows[1], pa.string())]
            cols += [pa.array(x, pa.int64()) for x in rows[2:]] + [pa.array(edge, pa.int32())]
            return pa.RecordBatch.from_arrays(cols, schema=_ARROW)

        for b in batches:
            if not b.num_rows:
                continue
            kind, subj = b.column(0), b.column(1)
            t = b.column(2).to_numpy(zero_copy_only=False)
            seq = b.column(3).to_numpy(zero_copy_only=False)
            before = open_ or [None, None, 0, 0, 0, 0]
            fresh = changes(kind, before[0]) | changes(subj, before[1])
            late = np.empty(len(t), dtype=bool)
            late[0] = t[0] - before[4] > gap_us
            late[1:] = np.diff(t) > gap_us
            new = fresh | late
            if open_ is None:
                new[0] = True
            starts = np.flatnonzero(new)
            lead = int(starts[0]) if len(starts) else len(t)
            if lead and open_:  # rows that go on with the open session
                open_[4], open_[5] = int(t[lead - 1]), open_[5] + lead
            if not len(starts):
                continue
            ends = np.append(starts[1:], len(t)) - 1
            done = len(starts) - 1
            kinds, subjects = kind.take(pa.array(starts)).to_pylist(), subj.take(pa.array(starts)).to_pylist()
            cols = [kinds[:done], subjects[:done], seq[starts[:-1]], t[starts[:-1]], t[ends[:-1]], (ends - starts + 1)[:-1]]
            if open_:
                cols = [[open_[0], *cols[0]], [open_[1], *cols[1]], *(np.append([v], c) for v, c in zip(open_[2:], cols[2:]))]
            if len(cols[0]):
                edge = np.zeros(len(cols[0]), dtype=np.int32)
                if first:
                    edge[0], first = HEAD, False
                yield emit(cols, edge)
            s, e = starts[-1], ends[-1]
            open_ = [kinds[-1], subjects[-1], int(seq[s]), int(t[s]), int(t[e]), int(e - s + 1)]
        if open_:
            yield emit([[v] for v in open_], np.array([TAIL | (HEAD if first else 0)]))

    return run


def sessionise(
    df: DataFrame,
    gap_s: float = 1800,
    kind: str | None = "subject_kind",
    subject: str = "subject",
    ts: str = "event_ts",
    seq: str = "seq",
) -> DataFrame:
    """Sessions of each subject: longest stretches with at most ``gap_s`` seconds between rows.

    Returns ``kind, subject, first_seq, session_start, session_end, duration_s, n_events``.

    Rows are ordered by time, then ``seq``. A gap of exactly ``gap_s`` doesn't part. Rows with a
    null or blank subject, a null time or a null seq belong to no session. A null kind is a kind
    of its own. Repeated rows count. An empty table gives no rows. Other columns of ``df``,
    whatever their names, are not read.

    Plan: one range exchange on (kind, subject, time, seq), a sort and one linear scan within
    each partition, then one exchange of sessions to join those cut at partition edges; sessions
    inside a partition are spread by their first row, so no subject gathers in one task.
    """
    gap_us = round(gap_s * 1_000_000)
    rows = df.select(
        (kind_key(kind) if kind else F.lit(None).cast("string")).alias("kind"),
        id_key(subject).alias("subject"),
        micros(ts).alias("t"),
        F.col(seq).cast("bigint").alias("seq"),
    ).where("subject is not null and t is not null and seq is not null")
    scanned = range_sorted(rows, ["kind", "subject"], ["t", "seq"]).mapInArrow(_scan(gap_us), _SCAN)
    group = scanned.withColumn("spread", F.when(F.col("edge") == 0, F.pmod(F.xxhash64("first_seq"), F.lit(4096))).otherwise(F.lit(-1)))
    w = Window.partitionBy("kind", "subject", "spread").orderBy("t0", "first_seq")
    joined = (
        (F.lag("edge").over(w).bitwiseAND(F.lit(TAIL)) > 0) & (F.col("edge").bitwiseAND(F.lit(HEAD)) > 0) & (F.col("t0") - F.lag("t1").over(w) <= gap_us)
    )
    group = group.withColumn("fresh", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1))
    group = group.withColumn("g", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = group.groupBy("kind", "subject", "spread", "g").agg(
        F.min_by("first_seq", F.struct("t0", "first_seq")).alias("first_seq"),
        F.min("t0").alias("t0"),
        F.max("t1").alias("t1"),
        F.sum("n").alias("n_events"),
    )
    return out.select(
        "kind",
        "subject",
        "first_seq",
        from_micros("t0").alias("session_start"),
        from_micros("t1").alias("session_end"),
        ((F.col("t1") - F.col("t0")) / 1_000_000).alias("duration_s"),
        "n_events",
    )
