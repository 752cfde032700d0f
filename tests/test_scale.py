"""What must not depend on how large the tables are: plans, the cut of batches, ties."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.operators import alignment, assembly, documents, face
from tidemark.plans import catalog, face_lane, observations, reports, surface
from tidemark.plans import visits as plan_visits
from tidemark.streaming import folds, ordered

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_face_frames_are_not_broadcast(spark, monkeypatch):
    """Written tables are small on disk and large in memory: neither frames nor bins may be sent through the driver."""
    if not os.path.isdir(SF_DIR):
        pytest.skip("no tables here")
    plans, write = [], face.materialize
    monkeypatch.setattr(face, "materialize", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(df))[1])
    frames = face_lane.face_frames(spark, SF_DIR)
    face.metrics(frames, face_lane.face_sessions(frames))
    joined = [p for p in plans[1:] if "Join" in p]
    assert joined and not any("BroadcastHashJoin" in p for p in joined)


@pytest.mark.parametrize("epochs", [1, 2])
def test_frames_of_a_batch_come_in_any_order(spark, tmp_path, epochs):
    """A batch whose newest rows come first, in frames of ten rows: none is late, none of an old epoch."""
    ddl, setting = "s string, t_ms double, value double, source string, epoch long", "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = [("ab"[t % 2], 10.0 * t, 1.0, "x", 1 + (t >= 60 and epochs == 2)) for t in reversed(range(120))]
    spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(str(tmp_path / "in"))
    fold, before = folds.Windows("t_ms", "value", "source", 300.0), spark.conf.get(setting)
    spark.conf.set(setting, "10")
    try:
        tagged = ordered.ordered(spark.readStream.schema(ddl).parquet(str(tmp_path / "in")), "s", "t_ms", fold, 50.0, epoch="epoch")
        found = ordered.run_to_end(tagged, str(tmp_path / "out"), str(tmp_path / "check"), "s", "t_ms", fold, epoch="epoch").collect()
    finally:
        spark.conf.set(setting, before)
    assert sorted((r.s, r.accepted, r.refused) for r in found if r.tag == "closed") == [("a", 60, 0), ("b", 60, 0)]
    assert [r["rows"] for r in found if r.tag == "result"] == [15] * 8


def test_window_metrics_of_events_in_any_order(spark, tmp_path):
    """Two sessions whose newest events come first, in frames of 500 rows: the metrics are those of events in order."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, e = spark.conf.get(setting), F.col("event_id")
    events = spark.range(12_000).select(F.col("id").alias("event_id"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(secs=F.col("id"))).alias("ts"), (F.col("id") * 7919 % 997 / 10.0).alias("value"))
    found = []
    spark.conf.set(setting, "500")
    try:
        for name, order in (("in-order", e), ("newest-first", e.desc())):
            events.coalesce(1).sortWithinPartitions(order).write.parquet(str(tmp_path / name / "events.parquet"))
            found.append(sorted(tuple(r) for r in catalog.QUERIES["stream_window_metrics"](spark, str(tmp_path / name)).collect()))
    finally:
        spark.conf.set(setting, before)
    assert len(found[0]) == 28 and found[0] == found[1]


@pytest.mark.parametrize("name", ["stream_window_metrics", "finalised_window_frames"])
def test_windows_lie_on_the_sessions_clock(spark, tmp_path, name):
    """Sessions that begin in the middle or late, are silent for longer than a window, or end with a window's first frame."""
    e = F.col("id")
    k, s = e % 6000, F.expr("id div 6000")
    there = F.when(s == 1, k >= 1500).when(s == 2, k >= 4700).when(s == 3, k <= 4000).when(s == 4, (k < 150) | (k >= 5400)).when(s == 5, k == 5000).when(s == 6, (k < 300) | (k == 4100)).otherwise(True)
    events = spark.range(42_000).filter(there).select(e.alias("event_id"), F.lit("2024-01-01").cast("timestamp").alias("ts"), (e * 7919 % 997 / 10.0).alias("value"))
    events.coalesce(1).sortWithinPartitions(F.col("event_id").desc()).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    expected = sorted(con.execute(catalog.ORACLE_SQL[name]).fetchall(), key=repr)
    assert expected and sorted(map(tuple, catalog.QUERIES[name](spark, str(tmp_path)).collect()), key=repr) == expected


needs_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables here")


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def written_plans(monkeypatch, module):
    """The plans of the tables that a module writes from now on."""
    plans, write = [], module.materialize
    monkeypatch.setattr(module, "materialize", lambda df: (plans.append(planned(df)), write(df))[1])
    return plans


@needs_tables
def test_an_audit_compares_visits_once(spark):
    """It holds written comparison rows against claims; it does not compare the visits again for each."""
    assert "lineitem.parquet" not in planned(catalog.QUERIES["visit_row_audit"](spark, SF_DIR))


@needs_tables
@pytest.mark.parametrize("name", ["durable_rules", "measurement_audit"])
def test_audits_gather_lines_once(spark, name):
    assert "lineitem.parquet" not in planned(catalog.QUERIES[name](spark, SF_DIR))


@needs_tables
@pytest.mark.parametrize("name", ["history_anchors", "history_flags"])
def test_anchors_and_flags_need_no_metrics(spark, monkeypatch, name):
    plans = written_plans(monkeypatch, alignment)
    plans.append(planned(catalog.QUERIES[name](spark, SF_DIR)))
    assert len(plans) > 1 and not any("lineitem.parquet" in p for p in plans)


@needs_tables
def test_a_run_places_orders_once(spark, monkeypatch):
    """Histories are made of orders that were put in their places once; metrics alone still look up their owners."""
    plans = written_plans(monkeypatch, alignment)
    observations.run_of(spark, SF_DIR)
    assert [p.count("orders.parquet") for p in plans if "orders.parquet" in p] == [1]


@needs_tables
def test_reported_rows_are_dealt_out_once(spark):
    """Neither by the few codes of metrics nor once more for their counts."""
    reported = reports.outcomes(spark, SF_DIR).select("session_id", "metric_code", F.lit("timing").alias("section"))
    found = assembly.section_errors(reported, spark.createDataFrame(reports.SECTIONS, "section string, metric_code string, position int"))
    assert planned(found).count("Exchange hashpartitioning") == 1


def test_eligible_windows_are_listed_once_a_document(spark):
    """What an array of windows is held against is bound outside of the step over windows."""
    o = reports.outcomes(spark, SF_DIR) if os.path.isdir(SF_DIR) else pytest.skip("no tables here")
    found = documents.windows_of(documents.session_documents(o, o.select("session_id", F.lit(1.0).alias("duration_ms")), o.select("session_id"), surface._PROTOCOL))
    assert "array_contains(lambda" in found._jdf.queryExecution().optimizedPlan().toString()


@needs_tables
@pytest.mark.parametrize("name", ["visit_comparison", "visit_cards", "visit_card_audit"])
def test_visits_are_not_dealt_out_by_metric(spark, monkeypatch, name):
    """A profile has a handful of metrics: shuffled by them, all rows would be in as few tasks."""
    plans = written_plans(monkeypatch, plan_visits)
    plans.append(planned(catalog.QUERIES[name](spark, SF_DIR)))
    assert not any(f"hashpartitioning({side}metric_code#" in p for p in plans for side in ("", "d_"))
    assert name != "visit_card_audit" or "lineitem.parquet" not in plans[-1]


@needs_tables
def test_tones_are_dealt_out(spark):
    """Their pitch is looked for in all tasks, however few the files are cut into."""
    assert "Exchange hashpartitioning(event_id" in planned(catalog.QUERIES["pitch_of_blocks"](spark, SF_DIR))


@needs_tables
def test_session_rules_move_lines_once(spark):
    """Lines are dealt out by order; neither their identities nor the distinct ones among them are shuffled."""
    plan = planned(catalog.QUERIES["session_rules"](spark, SF_DIR))
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and not any(name in line for line in exchanges for name in ("aggregate_id", "l_linenumber", "outcome_id")) and "Expand" not in plan


@needs_tables
def test_bins_are_summed_up_by_what_is_asked_for(spark):
    """One value alone is that of all, and the others' columns do not reach the workers."""
    frames = face_lane.face_frames(spark, SF_DIR)
    _, kept = face.accepted_frames(frames, face_lane.face_sessions(frames))
    keys = ["session_id", "bin"]
    alone, every = face.bin_values(kept, keys, ("eye_left",)), face.bin_values(kept, keys).filter("name = 'eye_left'")
    assert sorted(map(tuple, alone.collect())) == sorted(map(tuple, every.collect()))
    assert "movement" not in planned(catalog.QUERIES["face_eye_bins"](spark, SF_DIR))
