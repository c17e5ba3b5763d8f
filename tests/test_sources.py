"""CSV, XES, corpus, usage, envelopes, streaming, the entry file."""

import json
import subprocess
import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest

from wardloom.operators import episodes as E
from wardloom.operators.evidence import STRATEGIES
from wardloom.sources import envelope as N
from wardloom.sources import events as S

ROOT = Path(__file__).resolve().parents[1]
T0 = datetime(2026, 1, 5, 8)


def test_csv_round_trip(spark, tmp_path):
    src = tmp_path / "in.csv"
    src.write_text('timestamp,subject_kind,subject,activity,location,source,confidence\n2026-01-05T08:00:00.5, Clinician ,C1,arrive,"4S, BED3",rfid,\n2026-01-05 07:00:00,patient,P1,"say ""x""",b,rfid,0.25\n')
    df = S.read_events_csv(spark, str(src))
    rows = df.orderBy("seq").collect()
    assert [(r.subject_kind, r.location, r.confidence) for r in rows] == [("clinician", "4S, BED3", 1.0), ("patient", "b", 0.25)]
    assert rows[0].event_ts == T0 + timedelta(milliseconds=500) and rows[1].activity == 'say "x"'
    S.write_events_csv(df.coalesce(1), str(tmp_path / "out"))
    again = S.read_events_csv(spark, str(tmp_path / "out")).orderBy("seq").collect()
    assert [r[1:] for r in again] == [r[1:] for r in rows]
    src.write_text("timestamp,subject_kind,subject,activity,location,source,confidence\nx,robot,a,b,c,d,1\n")
    with pytest.raises(Exception, match="unknown subject kind|not a timestamp"):
        S.read_events_csv(spark, str(src)).collect()
    r = S.read_events_csv(spark, str(src), strict=False).first()
    assert r.subject_kind is None and r.event_ts is None


def test_xes(spark, tmp_path):
    (tmp_path / "a.xes").write_text(
        '<log><trace><string key="concept:name" value="c1"/>'
        '<event><string key="concept:name" value="arrive"/><string key="org:resource" value="r"/><date key="time:timestamp" value="2026-01-05T08:00:00Z"/></event>'
        '<event><string key="concept:name" value="depart"/><date key="time:timestamp" value="2026-01-05T08:05:00Z"/></event></trace></log>'
    )
    rows = S.read_xes(spark, str(tmp_path / "a.xes")).orderBy("seq").collect()
    assert [(r.case_id, r.activity, r.resource) for r in rows] == [("c1", "arrive", "r"), ("c1", "depart", None)] and rows[1].event_ts == T0 + timedelta(minutes=5)


def test_corpus_guard(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "data").mkdir()
    (tmp_path / "docs/a.md").write_text("# a\nb")
    (tmp_path / "data/x.md").write_text("no")
    assert [r.text for r in S.read_corpus(spark, str(tmp_path), "*.md").collect()] == ["# a\nb"]
    with pytest.raises(S.CorpusSafety):
        S.read_corpus(spark, str(tmp_path / "data"))


def test_usage(spark, tmp_path):
    line = {"message": {"model": "m", "usage": {"input_tokens": 10, "cache_creation_input_tokens": 4, "cache_read_input_tokens": 10, "output_tokens": 2}}}
    (tmp_path / "s.jsonl").write_text(json.dumps(line) + "\n" + json.dumps(line)[:40] + "\n" + json.dumps(line) + "\n{}\n")
    r = S.read_usage(spark, str(tmp_path / "s.jsonl")).collect()
    assert [(x.model, x.input_tokens, x.billable) for x in r] == [("m", 20, 2 * (10 + 5 + 1 + 10))]


def test_envelopes(tmp_path):
    ok = N.Envelope("coverage", "1", "union", {s: [{"n": 1}] for s in STRATEGIES})
    N.write_json(ok, str(tmp_path / "e.json"))
    assert N.read_json(str(tmp_path / "e.json")) == ok and ok.with_strategy("referral").selected() == [{"n": 1}]
    with pytest.raises(N.UnknownStrategy):
        N.Envelope("k", "1", "best", ok.payload)
    with pytest.raises(N.MissingProvenance):
        N.Envelope("k", "1", "union", {"union": []})
    with pytest.raises(N.MissingProvenance):
        N.Envelope("k", "1", "union", ok.payload, available_strategies=("union",))
    with pytest.raises(N.MissingProvenance):
        N.Envelope.from_mapping({"kind": "x"})
    with pytest.raises(N.EmbeddingLeak):
        N.Envelope("k", "1", "union", {**ok.payload, "x": [{"deep": {"My_Embedding": 1}}]})


def test_claims_are_scored_anew_on_reading(spark, tmp_path):
    df = spark.createDataFrame([("p", "s", "union", 1.0, 0.85, None, 0.1)], "patient string, specialty string, strategy string, referral double, consult_note double, problem_list double, confidence double")
    N.write_claims(df, str(tmp_path / "c"))
    assert abs(N.read_claims(spark, str(tmp_path / "c")).first().confidence - 1.85 / 3) < 1e-12
    e = N.envelope_of(df.select("strategy", "patient"), "claims", "1", "union")
    assert e.selected() == [{"patient": "p"}]
    with pytest.raises(N.EmbeddingLeak):
        N.envelope_of(df.selectExpr("strategy", "named_struct('vector', 1) as x"), "claims", "1", "union")


def test_streamed_episodes_equal_the_batch(spark, tmp_path):
    from wardloom.streaming.episodes import stream_episodes

    ddl = "seq long, event_ts timestamp_ntz, subject_kind string, subject string, activity string, place string, confidence double"
    rows, i = [], 0
    for who in ("a", "b"):
        t = 0
        for place in "xyxzx":
            for k, act in enumerate(["arrive", "ping", "ping", "depart"]):
                rows.append((i, T0 + timedelta(seconds=t), "clinician", who, act, place, 1.0))
                i, t = i + 1, t + 50
            t += 100
    batch = spark.createDataFrame(rows, ddl)
    want = sorted((r.clinician, r.bed, r.start, r.end, r.n_events) for r in E.episodes(batch).collect())
    src = tmp_path / "in"
    for k in range(0, len(rows), 10):
        spark.createDataFrame(sorted(rows, key=lambda r: r[1])[k : k + 10], ddl).coalesce(1).write.mode("append").parquet(str(src))
    late = (10**6, T0 + timedelta(days=1), "clinician", "zz", "ping", "w", 1.0)
    spark.createDataFrame([late, (10**6 + 1, T0 + timedelta(days=3), "clinician", "zz", "ping", "w", 1.0)], ddl).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = stream_episodes(stream).writeStream.format("memory").queryName("eps_out").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = sorted((r.clinician, r.bed, r.start, r.end, r.n_events) for r in spark.table("eps_out").collect())
    assert got == want


def test_entry_lists_match():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert {f"p{n}_found" for n in (3, 5, 7)} <= set(e.queries())


def test_core_runs_without_the_llm_subpackage():
    code = "import sys; sys.modules['wardloom.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p7_found' in q and 'p1_found' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
    for p in ROOT.glob("wardloom/**/*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "wardloom.llm" not in p.read_text()
