"""Sessions, run bitmaps and event lines."""

import csv
import io
import random
from datetime import datetime, timedelta

import pytest

from wardloom.operators.intervals import periods_and_gaps
from wardloom.operators.sessions import sessionise
from wardloom.sources.event_lines import parse_event_lines

T0 = datetime(2026, 1, 5, 8)
EVENT = "seq long, event_ts timestamp_ntz, subject_kind string, subject string, n_events string"


@pytest.fixture
def partitions(spark):
    """Sets the number of shuffle partitions, uncoalesced, and puts it back."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield lambda n: spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.shuffle.partitions", old)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_sessions_equal_brute_force_at_any_partitioning(spark, partitions):
    rng, rows, t = random.Random(1), [], T0
    for i in range(4000):
        t += timedelta(seconds=rng.choice([0, 0, 60, 1800, 1801]))
        rows.append((i, t, rng.choice(["clinician", " Clinician", "patient"]), rng.choice(["HOT"] * 5 + ["a ", "A", "b"]), "x"))
    want = []
    for k in ("clinician", "patient"):
        for s in ("HOT", "A", "B"):
            last = None
            for seq, t, *_ in sorted((r for r in rows if r[2].strip().lower() == k and r[3].strip().upper() == s), key=lambda r: (r[1], r[0])):
                if last and (t - last[1]).total_seconds() <= 1800:
                    last[1], last[2] = t, last[2] + 1
                else:
                    last = [seq, t, 1]
                    want.append(last)
    for n in (1, 5, 40):
        partitions(n)
        got = sessionise(spark.createDataFrame(rows, EVENT)).select("first_seq", "n_events").collect()
        assert sorted(map(tuple, got)) == sorted((a, n) for a, _, n in want)


def test_sessions_edge_cases(spark):
    df = spark.createDataFrame([(1, T0, None, "a", ""), (2, T0, None, "a", ""), (3, T0, "p", None, ""), (4, None, "p", "a", ""), (5, T0, "p", " ", ""), (None, T0, "p", "a", "")], EVENT)
    rows = sessionise(df).collect()
    assert [(r.kind, r.subject, r.first_seq, r.n_events, r.duration_s) for r in rows] == [(None, "A", 1, 2, 0.0)]
    assert rows[0].session_start == T0
    assert sessionise(df.limit(0)).count() == 0


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_sessions_keep_wall_clocks_in_any_zone(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(1, T0, "p", "a", ""), (2, T0 + timedelta(hours=1), "p", "a", "")], EVENT)
        assert [r.session_start for r in sessionise(df).orderBy("first_seq").collect()] == [T0, T0 + timedelta(hours=1)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def spans(rows):
    out, by = [], {}
    for e, s, n in rows:
        if s is not None and n is not None and n >= 1:
            by.setdefault(e, []).append((s, s + n))
    for e, xs in by.items():
        merged = []
        for a, b in sorted(xs):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        out += [("period", e, a, b) for a, b in merged] + [("gap", e, x[1], y[0]) for x, y in zip(merged, merged[1:])]
    return sorted(out, key=str)


def test_periods_and_gaps_equal_brute_force(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(-200, 900, 7)]), rng.choice([None, 0, -3, 1, 2, 5, 59, 60, 61, 130, 400])) for _ in range(400)]
    rows += [("c", 10, 10**9), ("c", 5, 2), ("c", 10**9 + 10, 3), ("c", 2 * 10**9, 1), ("d", -61, 1), ("d", -60, 1), ("d", 59, 1), ("d", 60, 60)]
    df = spark.createDataFrame(rows, "who string, start_slot long, duration long").withColumnRenamed("who", "_g_who")
    got = periods_and_gaps(df, ["_g_who"], "start_slot", "duration").collect()
    assert sorted(map(tuple, got), key=str) == spans(rows)
    assert periods_and_gaps(df.limit(0), ["_g_who"], "start_slot", "duration").count() == 0


GOOD = "2025-03-16T10:12:48.705,CLINICIAN,CLN1,depart,7S/BED9,gate,0.5"
LINES = [
    (GOOD, None),
    ('"2025-03-21T08:46","patient","P1","hand ""x""","4N/BED4","gate, 19","1.0"', None),
    ('2025-03-16 10:12,patient ,P,a,"b,\nc",d,', None),
    ("2024-02-29T23:59:59+01:00, Patient,,,,, .88 ", None),
    ("2025-03-16T10:12:48Z,patient,P,a,b,c,9.1e-1\r\n", None),
    ("2025-03-16T10:12:48Z,patient,P,a,b,c,1.", None),
    (None, "column_count"),
    ("", "column_count"),
    ("a,b", "column_count"),
    (GOOD + ",x", "column_count"),
    (GOOD.replace(",depart", "\n,depart"), "column_count"),
    (GOOD.replace("7S/BED9", '7S/"BED9'), "broken_quoting"),
    (GOOD.replace("7S/BED9", '"7S" BED9'), "broken_quoting"),
    (GOOD.replace("7S/BED9", '"7S/BED9'), "broken_quoting"),
    (GOOD.replace("2025-03-16T10", "2025-02-29T10"), "invalid_timestamp"),
    (GOOD.replace("T10", "t10"), "invalid_timestamp"),
    (GOOD.replace("T10", "T24"), "invalid_timestamp"),
    (GOOD.replace(".705", ".7050001"), "invalid_timestamp"),
    (GOOD.replace(":48.705", ".705"), "invalid_timestamp"),
    (GOOD.replace(".705", "+24:00"), "invalid_timestamp"),
    (" " + GOOD, "invalid_timestamp"),
    ("timestamp,subject_kind,subject,activity,location,source,confidence", "invalid_timestamp"),
    (GOOD.replace("CLINICIAN", "clin"), "invalid_subject_kind"),
    (GOOD.replace("CLINICIAN", ""), "invalid_subject_kind"),
    *((GOOD.replace("0.5", c), "invalid_confidence") for c in ("1.01", "-0.1", "nan", "inf", "0;9", "1e3", "93%", " ")),
    (GOOD.replace("0.5", "x" * 200_000), "invalid_confidence"),
]


def test_event_lines(spark):
    rows = [(i, line, "extra") for i, (line, _) in enumerate(LINES)]
    df = spark.createDataFrame(rows, "line_id long, raw_line string, reason string")
    got = {r.line_id: r for r in parse_event_lines(df).collect()}
    assert {i: r.reason for i, r in got.items()} == {i: why for i, (_, why) in enumerate(LINES)}
    assert got[0].event_ts == datetime(2025, 3, 16, 10, 12, 48, 705000) and got[0].subject_kind == "clinician"
    assert got[1].activity == 'hand "x"' and got[1].source == "gate, 19"
    assert got[2].location == "b,\nc" and got[2].confidence == 1.0
    assert got[3].event_ts == datetime(2024, 2, 29, 22, 59, 59) and got[3].subject is None and got[3].confidence == 0.88
    assert got[22].failing_cell == "clin"
    assert parse_event_lines(df.limit(0)).count() == 0


def test_event_lines_read_what_a_csv_writer_writes(spark):
    rng, rows = random.Random(4), []
    for i in range(300):
        buf = io.StringIO()
        text = lambda: "".join(rng.choice('ab ",\n\'é患') for _ in range(rng.randint(0, 6)))
        cells = ["2025-03-16T10:12:48", "patient", *(text() for _ in range(4)), "0.25"]
        csv.writer(buf, lineterminator="").writerow(cells)
        rows.append((i, buf.getvalue(), cells))
    got = {r.line_id: r for r in parse_event_lines(spark.createDataFrame([r[:2] for r in rows], "line_id long, raw_line string")).collect()}
    for i, _, cells in rows:
        r = got[i]
        assert r.reason is None and [x or "" for x in (r.subject, r.activity, r.location, r.source)] == cells[2:6]


def test_batches_without_a_record_that_can_be_read():
    import pyarrow as pa

    from wardloom.sources.event_lines import classify

    got = classify(pa.array([1, 2], pa.int64()), pa.array(['"open', None]))
    assert got.column("reason").to_pylist() == ["broken_quoting", "column_count"]
    assert classify(pa.array([], pa.int64()), pa.array([], pa.string())).num_rows == 0
    numbers = ["1.", ".5", "+0.5", "1e-1", "-0", "0.5.", "1e", "2", "-.1", "", " 1 "]
    rows = [f"2026-01-05T08:00,patient,S,a,l,x,{c}" for c in numbers]
    got = classify(pa.array(range(len(rows)), pa.int64()), pa.array(rows))
    assert got.column("confidence").to_pylist() == [1.0, 0.5, 0.5, 0.1, 0.0, None, None, None, None, 1.0, 1.0]
    assert got.column("failing_cell").to_pylist() == [None] * 5 + ["0.5.", "1e", "2", "-.1"] + [None] * 2
