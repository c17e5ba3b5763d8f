import itertools
import random
from datetime import datetime, timedelta

from wardloom.llm.nearest import match_nearest, place_keys
from wardloom.llm.runs import apart, collapse_runs, segment

T0 = datetime(2026, 1, 5, 8)
EVENT = "seq long, event_ts timestamp_ntz, subject_kind string, subject string, activity string, location string, n_events int"


def cost(act, place, n, starts, p):
    total = 0.0
    for a, b in zip(starts, [*starts[1:], len(n)]):
        total += p[0]
        for vals, w in ((act, p[1]), (place, p[2])):
            count = {}
            for v, k in zip(vals[a:b], n[a:b]):
                count[v] = count.get(v, 0) + k
            total += w * (sum(n[a:b]) - max(count.values()))
    return total


def test_segmentation_is_optimal():
    rng = random.Random(3)
    for _ in range(150):
        m = rng.randint(1, 8)
        act, place = [rng.choice("ab") for _ in range(m)], [rng.choice("xyz") for _ in range(m)]
        n = [rng.randint(1, 4) for _ in range(m)]
        p = (1.0, rng.choice([0.2, 0.5, 1, 3]), rng.choice([0.2, 0.5, 1, 3]))
        got = segment(act, place, n, *p)
        best = min(cost(act, place, n, [0, *c], p) for k in range(m) for c in itertools.combinations(range(1, m), k))
        assert abs(cost(act, place, n, got, p) - best) < 1e-9


def test_weights_above_two_penalties_cut_at_every_change():
    rng = random.Random(4)
    for _ in range(100):
        act, n = [rng.choice("ab")], [1]
        for _ in range(9):
            act.append("b" if act[-1] == "a" else "a")
            n.append(rng.randint(1, 5))
        assert segment(act, ["x"] * 10, n, 1.0, 2.1, 2.1) == list(range(10))


def events(spark, n, partitions=None, seed=1):
    rng, t, rows = random.Random(seed), T0, []
    for i in range(n):
        t += timedelta(seconds=rng.choice([0, 1, 5, 90, 91]))
        rows.append((i, t, rng.choice(["clinician", " CLINICIAN "]), rng.choice(["C1", "c1 ", "C2"]), rng.choice(["Arrive", "arrive", "a-rrive", "ping", None]), rng.choice(["1A/BED03", "1a bed_3", "1A/BED4"]), 0))
    df = spark.createDataFrame(rows, EVENT)
    return rows, df.repartition(partitions) if partitions else df


def brute(rows):
    key = lambda v: v and v.lower().replace("-", "").replace("/", "").replace(" ", "").replace("_", "").replace("bed03", "bed3")
    out = []
    for s in ("C1", "C2"):
        last = None
        for seq, t, _, _, a, p, _ in sorted((r for r in rows if r[3].strip().upper() == s), key=lambda r: (r[1], r[0])):
            k = (key(a), key(p))
            if last and None not in k and k == last[2] and (t - last[1]).total_seconds() <= 90:
                last[1], last[3] = t, last[3] + 1
            else:
                last = [seq, t, k, 1]
                out.append(last)
    return sorted((r[0], r[3]) for r in out)


def test_runs_equal_brute_force_over_many_partitions(spark):
    rows, df = events(spark, 3000)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for parts in ("1", "7", "60"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = sorted((r.first_seq, r.n_events) for r in collapse_runs(df).collect())
            assert got == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_soft_weights_do_not_depend_on_partitions(spark):
    _, df = events(spark, 1500, seed=9)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = []
        for parts in ("1", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            r = collapse_runs(df, penalty=1.0, w_activity=0.4, w_place=0.6).collect()
            got.append(sorted((x.first_seq, x.n_events, x.activity or "", x.place) for x in r))
        assert got[0] == got[1]
        assert sum(x[1] for x in got[0]) == 1500
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_near_runs_equal_exhaustive_search(spark):
    """Every way to cut short sequences, in several partitions, at weights where strays merge."""
    from itertools import product as every

    rng, penalty, wa, wp = random.Random(21), 1.0, 0.4, 0.6
    rows, want, seq = [], [], 0
    for s in range(60):
        n = rng.randint(1, 9)
        ev, lead = [], rng.choice("ab")
        for i in range(n):
            seq += 1
            ev.append((seq, T0 + timedelta(seconds=s * 10_000 + i * 10), "clinician", f"C{s % 3}", lead if rng.random() < 0.7 else rng.choice("abc"), rng.choice("ppq"), 0))
        rows += ev
        cost = lambda part: wa * (len(part) - max(map([x[4] for x in part].count, "abc"))) + wp * (len(part) - max(map([x[5] for x in part].count, "pq"))) + penalty
        best = None
        for bits in every((0, 1), repeat=n - 1):
            at = [0, *(i + 1 for i, b in enumerate(bits) if b), n]
            c = round(sum(cost(ev[a:b]) for a, b in zip(at, at[1:])), 9)
            best = min(best or c, c)
        want.append((ev, best, cost))
    df = spark.createDataFrame(rows, EVENT)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for parts in ("1", "9", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = {r.first_seq: r.n_events for r in collapse_runs(df, penalty=penalty, w_activity=wa, w_place=wp).collect()}
            assert sum(got.values()) == len(rows)
            for ev, best, cost in want:
                at = [i for i, x in enumerate(ev) if x[0] in got] + [len(ev)]
                assert at[0] == 0 and round(sum(cost(ev[a:b]) for a, b in zip(at, at[1:])), 9) == best
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_heavy_neighbours_are_cut_at_once():
    """A subject without any pause: runs leave the scan as soon as two heavy atoms meet."""
    rng = random.Random(4)
    atoms = [[i, i, i, i, rng.choice([1, 1, 2, 8, 9]), rng.choice("ab"), rng.choice("pq")] for i in range(60)]
    atoms = [a for a, b in zip(atoms, [[None] * 7, *atoms]) if a[5:] != b[5:]]
    p = (1.0, 0.4, 0.6)
    starts = segment([a[5] for a in atoms], [a[6] for a in atoms], [a[4] for a in atoms], *p)
    cuts = [i for i in range(1, len(atoms)) if apart(atoms[i - 1], atoms[i], p)]
    assert cuts and set(cuts) <= set(starts)


def test_runs_edge_cases(spark):
    df = spark.createDataFrame(
        [
            (1, T0, None, "C1", "a", "p", 0),
            (2, T0, None, "C1", "a", "p", 0),
            (3, T0 + timedelta(seconds=90), None, "C1", "a", "p", 0),
            (4, T0 + timedelta(seconds=90), None, "C1", None, "p", 0),
            (5, T0 + timedelta(seconds=91), None, "C1", "a", " ", 0),
            (6, None, "x", "C1", "a", "p", 0),
            (7, T0, "x", " ", "a", "p", 0),
        ],
        EVENT,
    )
    assert sorted((r.first_seq, r.n_events, r.duration_s) for r in collapse_runs(df).collect()) == [(1, 3, 90.0), (4, 1, 0.0), (5, 1, 0.0)]
    assert collapse_runs(df.limit(0)).count() == 0


def test_nearest_equals_brute_force(spark):
    rng = random.Random(5)
    sec = lambda: T0 + timedelta(seconds=rng.randint(0, 4000))
    left = [(i, sec(), rng.choice(["C1", "c1 ", "C2", None]), rng.choice(["A/1", "a 01", None]), "l") for i in range(400)]
    right = [(i, sec(), rng.choice(["C1", "C2"]), rng.choice(["A/1", "B/1"]), "r") for i in range(300)]
    right += right[:20]
    key = lambda r: (r[2].strip().upper(), r[3].replace(" 0", "/").upper())
    want = []
    for r in left:
        if r[2] and r[3]:
            c = [(abs((x[1] - r[1]).total_seconds()), x[1], x[0]) for x in right if key(x) == key(r)]
            if c and min(c)[0] <= 120:
                want.append((r[0], min(c)[2]))
    schema = "id long, ts timestamp_ntz, subject string, location string, side string"
    for shard in (1800, 300):
        got = match_nearest(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), place_keys(), place_keys(), "id", "ts", "id", "ts", shard_s=shard)
        assert sorted((r.left_id, r.right_id) for r in got.collect()) == sorted(want)
    empty = spark.createDataFrame([], schema)
    assert match_nearest(empty, empty, place_keys(), place_keys(), "id", "ts", "id", "ts").count() == 0


def test_nearest_at_every_tolerance_up_to_the_shard_borders(spark):
    rng = random.Random(11)
    sec = lambda: T0 + timedelta(seconds=rng.choice([rng.randint(0, 30_000), 900 * rng.randint(0, 33)]))
    left = [(i, sec(), rng.choice(["C1", "C2"]), "A/1", "l") for i in range(150)]
    right = [(i, sec(), rng.choice(["C1", "C2"]), "A/1", "r") for i in range(12)]
    schema = "id long, ts timestamp_ntz, subject string, location string, side string"
    a, b = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    for tol in (0, 120, 899, 900, 901, 1799, 1800, 3600, 7200):
        want = []
        for r in left:
            c = [(abs((x[1] - r[1]).total_seconds()), x[1], x[0]) for x in right if x[2] == r[2]]
            if c and min(c)[0] <= tol:
                want.append((r[0], min(c)[2]))
        got = match_nearest(a, b, place_keys(), place_keys(), "id", "ts", "id", "ts", tolerance_s=tol)
        assert sorted((r.left_id, r.right_id) for r in got.collect()) == sorted(want), tol


def test_nearest_finds_a_record_in_the_middle_of_a_shard(spark):
    schema = "id long, ts timestamp_ntz, subject string, location string, side string"
    a = spark.createDataFrame([(1, T0.replace(minute=30), "C1", "A/1", "l")], schema)
    b = spark.createDataFrame([(2, T0.replace(minute=15), "C1", "A/1", "r")], schema)
    got = match_nearest(a, b, place_keys(), place_keys(), "id", "ts", "id", "ts", tolerance_s=900)
    assert [(r.left_id, r.right_id, r.lag_s) for r in got.collect()] == [(1, 2, -900.0)]
