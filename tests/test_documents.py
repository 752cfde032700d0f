"""Documents of sessions, references of several kinds, and what SQL can call."""

import pandas as pd
from pyspark.sql import functions as F

from tidemark.functions import tables
from tidemark.operators import detect, documents, journal, provenance

OUTCOMES = "session_id string, metric_code string, modality string, status string, reason_code string, value double, technical_quality_score double, eligible_ms double, window_refs array<string>, processor_refs array<string>"
ROWS = [
    ("a", "m1", "voice", "measured", None, 1.5, 0.8, 100.0, ["voice:0:10", "voice:10:20"], ["p"]), ("a", "m2", "voice", "withheld", "few", None, None, 50.0, ["voice:10:20", "voice:20:30"], ["p"]),
    ("a", "m3", "face", "withheld", "dark", None, None, 0.0, [], []), ("b", "m1", "voice", "measured", None, 2.0, None, 7.0, None, None), ("b", "m1", "voice", "measured", None, 2.0, None, 7.0, None, None),
]


def documents_of(spark, rows):
    sessions = spark.createDataFrame([("a", 1000.0), ("c", 5.0)], "session_id string, duration_ms double")
    return documents.session_documents(spark.createDataFrame(rows, OUTCOMES), sessions, spark.createDataFrame([("b",)], "session_id string"), [("timing", "m2", 2), ("timing", "m1", 1), ("other", "m9", 1)])


def test_documents_hold_what_went_in(spark):
    d = documents_of(spark, ROWS)
    assert sorted(map(repr, (tuple(r) for r in documents.outcomes_of(d).collect()))) == sorted(map(repr, ROWS))
    by = {r.session_id: r for r in d.collect()}
    assert set(by) == {"a", "b"} and by["a"].duration_ms == 1000.0 and by["b"].duration_ms is None and by["b"].provenance_failed and by["b"].sections is None
    assert [(w.ref, w.start_ms, w.end_ms, w.status) for w in by["a"].windows] == [("voice:0:10", 0.0, 10.0, "eligible"), ("voice:10:20", 10.0, 20.0, "eligible"), ("voice:20:30", 20.0, 30.0, "withheld")]
    assert [(m.metric_code, m.value, len(m.window_ids)) for m in by["a"].measurements] == [("m1", 1.5, 2)]
    assert [tuple(x) for x in by["a"].lanes] == [("voice", "ready", 100.0, 0.8, ["few"]), ("face", "withheld", 0.0, None, ["dark"])]
    assert [(s.section, len(s.facts), s.metric_codes) for s in by["a"].sections] == [("capture-quality", 5, []), ("timing", 0, ["m1", "m2"]), ("other", 0, [])]
    assert {f.code: (f.number, f.text, f.unit) for f in by["a"].sections[0].facts} == {
        "session-duration": (1000.0, None, "milliseconds"), "voice-lane": (None, "ready", None), "face-lane": (None, "withheld", None), "eligible-windows": (2.0, None, "windows"), "withheld-windows": (1.0, None, "windows"),
    }
    assert documents_of(spark, []).count() == 0


def test_one_shuffle_makes_a_document(spark):
    plan = documents_of(spark, ROWS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_references_of_several_kinds(spark):
    targets = {
        "event": spark.createDataFrame([("e1", "s", 1), ("e2", "s", 5), ("e3", "t", 1), ("e4", "s", 1), ("e4", "s", 2)], "target_id string, session string, at int"),
        "document": spark.createDataFrame([(7, None, None)], "target_id int, session string, at int"),
    }
    refs = [("event", "e1"), ("event", "e2"), ("event", "e3"), ("event", "e4"), ("event", "e9"), ("event", None), ("note", "e1"), (None, "e1"), ("document", "7")]
    df = spark.createDataFrame([(k, t, "s", 5) for k, t in refs], "kind string, target_id string, session string, at int")
    found = {(r.kind, r.target_id): r.violations for r in provenance.resolve_typed_refs(df, targets, "session", "at").collect()}
    assert found == {
        ("event", "e1"): [], ("event", "e2"): ["recorded-later"], ("event", "e3"): ["crosses-scope"], ("event", "e4"): ["ambiguous-reference"], ("event", "e9"): ["dangling-reference"], ("event", None): ["dangling-reference"],
        ("note", "e1"): ["unknown-kind"], (None, "e1"): ["unknown-kind"], ("document", "7"): [],
    }


def test_evidence_stays_in_its_scope(spark):
    ddl = "s string, n int, id string, at int, protocol string, evidence array<struct<s: string, protocol: string>>"
    df = spark.createDataFrame([("a", 1, "x", 1, "p", [("a", "p")]), ("a", 2, "y", 2, "p", [("a", "p"), ("b", "p")]), ("a", 3, "z", 3, "p", [("a", None)]), ("a", 4, "w", 4, "p", None)], ddl)
    assert [r.problems for r in journal.sequence_audit(df, "s", "n", "id", "at", evidence="evidence").orderBy("n").collect()] == [[], ["evidence-crosses-scope"], ["evidence-crosses-scope"], []]


def test_table_functions(spark):
    tables.register(spark)
    wave = [0.3] * 5 + [0.2, 0.05, 0.05, 0.15, 0.3] + [0.3] * 5
    rows = pd.DataFrame({"session_id": "a", "t_ms": [k * 33.0 for k in range(len(wave))], "aperture": wave, "bin": 0, "reference": 0.3})
    spark.createDataFrame(pd.concat([rows, rows.assign(session_id="b")])).repartition(4).createOrReplaceTempView("frames_of_test")
    found = spark.sql("SELECT * FROM tidemark_blinks(TABLE(frames_of_test) PARTITION BY session_id)").toPandas()
    wanted = detect.blink_fold(rows)
    assert sorted(found["session_id"]) == ["a", "b"] and found["peak_ms"].tolist() == wanted["peak_ms"].tolist() * 2 and found["depth"].tolist() == wanted["depth"].tolist() * 2
    assert spark.sql("SELECT count(*) AS n FROM tidemark_blinks(TABLE(SELECT * FROM frames_of_test WHERE t_ms < 0) PARTITION BY session_id)").first().n == 0


def test_results_are_views(spark):
    views = tables.publish(spark, "", {"one": lambda s, _: s.range(3).withColumn("k", F.lit("x"))}, ["one"])
    assert views == ["tidemark_one"] and spark.sql("SELECT k, sum(id) AS n FROM tidemark_one GROUP BY k").first().n == 3
