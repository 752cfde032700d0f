"""Queries of single operators that no other query shows: readers, registries, calibration, cadence, scalar rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import assembly, face, gates, governance, ingest, journal, provenance, sessionize, signals
from ..sources import histories
from . import measures
from .catalog import query, table
from .face_lane import FACE_SQL, face_frames
from .observations import _LISTED

_text = lambda c: c.cast("string")
_array = lambda *x: F.array(*[F.lit(v) for v in x])


@query(
    "history_documents",
    """WITH m AS (SELECT o_custkey AS p, o_orderkey AS rev, l_linenumber AS n, l_extendedprice AS v FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey % 10 <> 3), o AS (SELECT o_custkey AS p, o_orderkey AS rev FROM orders WHERE o_custkey % 10 <> 3)
SELECT p AS participant, count(DISTINCT rev) AS observations, (SELECT count(*) FROM m WHERE m.p = o.p) AS metrics, (SELECT round(sum(v), 2) FROM m WHERE m.p = o.p) AS total FROM o GROUP BY p""",
)
def history_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as JSON snapshots of their customers, read back; each tenth customer's document is broken."""
    k = F.col("o_orderkey")
    metric = F.struct(F.concat(F.lit("m"), _text(F.col("l_linenumber"))).alias("metricCode"), F.col("l_extendedprice").alias("value"), F.lit("measured").alias("status"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(metric).alias("metrics"))
    observation = F.struct(
        _text(k).alias("observationId"), _text(k).alias("revisionId"), F.col("o_orderdate").cast("timestamp").alias("startedAt"),
        F.coalesce("metrics", F.array().cast("array<struct<metricCode: string, value: double, status: string>>")).alias("metrics")
    )
    owned = table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left").groupBy("o_custkey").agg(F.collect_list(observation).alias("observations"))
    scope = F.struct(F.lit("t").alias("tenantId"), F.lit("s").alias("studyId"), _text(F.col("o_custkey")).alias("participantId"))
    documents = owned.select("o_custkey", F.when(F.col("o_custkey") % 10 == 3, "{broken").otherwise(F.to_json(F.struct(scope.alias("scope"), "observations"))).alias("payload"))
    found = histories.snapshot_tables(documents, "payload")
    metrics = found["metrics"].groupBy("participantId").agg(F.count("*").alias("metrics"), F.round(F.sum("value"), 2).alias("total"))
    counted = found["observations"].groupBy("participantId").agg(F.countDistinct("revisionId").alias("observations"))
    return counted.join(metrics, "participantId", "left").select(F.col("participantId").cast("long").alias("participant"), "observations", F.coalesce("metrics", F.lit(0)).alias("metrics"), "total")


@query(
    "log_kinds",
    "SELECT CASE WHEN o_orderstatus = 'F' THEN 'session' WHEN o_orderstatus = 'O' THEN 'consent' ELSE 'other' END AS kind, count(*) AS n, CAST(sum(CASE o_orderstatus WHEN 'F' THEN o_orderkey WHEN 'O' THEN o_custkey END) AS BIGINT) AS total FROM orders GROUP BY ALL"
)
def log_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a log of two known kinds with JSON payloads, and others."""
    status = F.col("o_orderstatus")
    kind = F.when(status == "F", "session").when(status == "O", "consent").otherwise("annotation")
    payload = F.when(status == "F", F.to_json(F.struct(F.col("o_orderkey").alias("key")))).otherwise(F.to_json(F.struct(F.col("o_custkey").alias("owner"))))
    parts = histories.split_log(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), kind.alias("kind"), payload.alias("payload")), {"session": "key long", "consent": "owner long"})
    rows = parts["session"].select(F.lit("session").alias("kind"), F.col("key").alias("x")).unionByName(parts["consent"].select(F.lit("consent").alias("kind"), F.col("owner").alias("x"))).unionByName(parts["other"].select(
        F.lit("other").alias("kind"), F.lit(None).cast("long").alias("x")
    ))
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.sum("x").alias("total"))


@query(
    "face_calibrations",
    f"""WITH {FACE_SQL.replace(' WHERE NOT other)', ')')}, e AS (SELECT *, max(epoch) OVER (PARTITION BY session_id) AS newest, NOT poseless AND NOT blurred AND NOT coalesce(abs(yaw) > 15 OR abs(pitch) > 15 OR abs(roll) > 10, false) AS fine FROM f), l AS (SELECT * FROM e WHERE epoch = newest),
g AS (SELECT session_id, max(t) - min(t) AS duration_ms, count(*) AS frames, CAST(sum(fine::INT) AS BIGINT) AS usable_frames, quantile_cont(size / sqrt(360.0 * 384.0) * 384.0, 0.5) FILTER (WHERE fine) AS width, bool_or(fine) AS any_fine FROM l GROUP BY session_id)
SELECT session_id, duration_ms, frames, usable_frames, round(width, 4) AS baseline_width, CASE WHEN duration_ms >= 1500 AND usable_frames / frames >= 0.8 AND (frames - 1) / (duration_ms / 1000) >= 20 THEN 'strong' ELSE 'limited' END AS calibration FROM g""",
)
def face_calibrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = face.calibration(face_frames(spark, sf_dir))
    return found.select("session_id", "duration_ms", "frames", "usable_frames", F.round("baseline_box_width_pixels", 4).alias("baseline_width"), "calibration")


@query(
    "face_guidance",
    f"""WITH {FACE_SQL.replace(' WHERE NOT other)', ')')} SELECT session_id, CASE WHEN poseless THEN 'Move into view' WHEN abs(yaw) > 15 OR abs(pitch) > 15 OR abs(roll) > 10 THEN 'Face the camera' WHEN blurred THEN 'Hold still' ELSE 'Face ready' END AS guidance, count(*) AS frames FROM f GROUP BY ALL""",
)
def face_guidance(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = face_frames(spark, sf_dir)
    return face.calibrated(frames, face.calibration(frames)).groupBy("session_id", "guidance").agg(F.count("*").alias("frames"))


@query(
    "frame_cadence",
    """WITH e AS (SELECT event_id, event_id // 1000 AS stream, event_id % 1000 * 30 AS t, CASE WHEN event_id % 3 = 0 THEN 'processed' WHEN event_id % 7 = 1 THEN 'skipped' ELSE 'presented' END AS kind FROM events),
r AS (SELECT *, count(*) FILTER (WHERE kind = 'processed') OVER w AS n, max(CASE WHEN kind = 'processed' THEN t END) OVER w - min(CASE WHEN kind = 'processed' THEN t END) OVER w AS span, count(*) FILTER (WHERE kind = 'skipped') OVER w AS s, count(*) FILTER (WHERE kind = 'presented') OVER w AS p FROM e WINDOW w AS (PARTITION BY stream ORDER BY t RANGE BETWEEN 2000 PRECEDING AND CURRENT ROW))
SELECT event_id, round(CASE WHEN n < 2 THEN 0 ELSE (n - 1) * 1000.0 / greatest(span, 1) END, 6) AS cadence_hz, round(CASE WHEN p = 0 THEN 0 ELSE s / p END, 6) AS drop_fraction FROM r""",
)
def frame_cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        e, F.expr("event_id div 1000").alias("stream"), ((e % 1000) * 30.0).alias("at_ms"),
        F.when(e % 3 == 0, "processed").when(e % 7 == 1, "skipped").otherwise("presented").alias("kind")
    )
    found = signals.rolling_cadence(rows, ["stream"], ["at_ms", "event_id"], "at_ms", "kind")
    return found.select("event_id", F.round("cadence_hz", 6).alias("cadence_hz"), F.round("drop_fraction", 6).alias("drop_fraction"))


@query(
    "speech_flags",
    """WITH f AS (SELECT event_id AS e, event_id % 40 / 1000.0 AS rms, CASE WHEN event_id % 3 <> 0 THEN 120.0 END AS f0, 0.4 + event_id % 5 / 10.0 AS conf, event_id % 6 / 100.0 AS flux, 0.002 + event_id % 7 / 1000.0 AS floor FROM events), p AS (SELECT *, f0 IS NOT NULL AND conf >= 0.55 AS periodic FROM f)
SELECT e AS event_id, periodic, rms >= greatest(0.003, floor * 2.8) AND (periodic OR (flux > 0.02 AND rms >= floor * 4)) AS active, round(rms * (1 + least(2, flux * 20)), 9) AS score FROM p""",
)
def speech_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    f = table(spark, sf_dir, "events").select(
        e, (e % 40 / 1000.0).alias("rms"), F.when(e % 3 != 0, 120.0).alias("f0"), (0.4 + e % 5 / 10.0).alias("conf"), (e % 6 / 100.0).alias("flux"),
        (0.002 + e % 7 / 1000.0).alias("floor")
    )
    periodic = signals.periodic("f0", "conf", F.lit(0.9))
    return f.select("event_id", periodic.alias("periodic"), signals.speech_active("rms", periodic, "flux", "floor").alias("active"), F.round(signals.nucleus_score("rms", "flux"), 9).alias("score"))


@query(
    "audio_calibration_classes",
    """WITH g AS (SELECT user_id, sum((event_type = 'click')::INT) AS reliable, sum((value > 150)::INT) AS energy FROM events GROUP BY user_id) SELECT user_id, CASE WHEN reliable >= 8 THEN 'strong' WHEN energy > 0 THEN 'limited' ELSE 'unavailable' END AS class FROM g""",
)
def audio_calibration_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sum((F.col("event_type") == "click").cast("int")).alias("reliable"), F.sum((F.col("value") > 150).cast("int")).alias("energy"))
    return g.select("user_id", gates.audio_calibration_class(F.col("reliable"), F.col("energy")).alias("class"))


@query(
    "acquisition_frames",
    """SELECT event_id % 20 AS part, CAST(sum((value IS NOT NULL AND event_id % 3 <> 0 AND event_id % 7 <> 0 AND event_id % 11 <> 0 AND event_id % 13 <> 0 AND event_id % 17 <> 0 AND event_id % 19 <> 0)::INT) AS BIGINT) AS usable FROM events GROUP BY ALL""",
)
def acquisition_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, d = F.col("event_id"), F.lit
    odd = lambda n, a, b: F.when(e % n == 0, a).otherwise(b)
    frames = table(spark, sf_dir, "events").select(
        e, F.when(F.col("value").isNotNull(), 5.0).alias("acquired_at_ms"), odd(3, 0.00005, 0.01).alias("rms"), d(0.5).alias("f0_confidence"), d(0.5).alias("estimator_agreement"), odd(7, float("nan"), 0.01).alias("spectral_flux"), d(9.0).alias("cepstral_peak_prominence_db"), odd(11, 0.01, 0.0).alias("clipped_sample_fraction"),
        odd(13, 0.01, -0.001).alias("dc_offset"), odd(17, 50.0, 10.0).alias("block_gap_ms"), d(0.0).alias("lost_block_fraction"), d(48000.0).alias("sample_rate_hz"), d("p").alias("processor_ref"), d("t").alias("track_segment_id"),
        F.struct(d(False).alias("echo_cancellation"), (e % 19 == 0).alias("noise_suppression"), d(False).alias("auto_gain_control")).alias("browser_processing"),
    )
    return frames.groupBy((e % 20).alias("part")).agg(F.sum(gates.acquisition_usable().cast("long")).alias("usable"))


@query(
    "calibration_selection",
    """WITH c AS (SELECT user_id, event_id, event_id % 97 = 0 AS other, value % 10 AS off, 5 + value % 7 AS unc FROM events WHERE value > 20), g AS (SELECT user_id, count(DISTINCT other) AS sources, max(off - unc) AS lo, min(off + unc) AS hi, min_by(event_id, struct_pack(a := unc, b := event_id)) AS best FROM c GROUP BY user_id), u AS (SELECT DISTINCT user_id FROM events)
SELECT user_id, CASE WHEN sources = 1 AND lo <= hi THEN best END AS best_event, CASE WHEN sources IS NULL THEN 'none-valid' WHEN sources > 1 THEN 'several-sources' WHEN lo > hi THEN 'inconsistent' END AS error FROM u LEFT JOIN g USING (user_id)""",
)
def calibration_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as clock calibrations that hold while their value exceeds 20."""
    v, e = F.col("value"), F.col("event_id")
    found = S.selected_calibration(F.when(e % 97 == 0, "b").otherwise("a"), v % 10, 5 + v % 7, v, F.lit(20.0), "event_id")
    c = table(spark, sf_dir, "events").groupBy("user_id").agg(found.alias("c"))
    return c.select("user_id", F.col("c.id").alias("best_event"), F.col("c.error").alias("error"))


@query(
    "clock_probes",
    """WITH p AS (SELECT event_id AS e, 1000.0 + event_id % 50 AS r, 1000.0 + event_id % 50 + event_id % 9 - 1 AS s, 0.0 AS a, event_id % 60 * 1.0 AS b, (event_id % 60) + CASE WHEN event_id % 31 = 0 THEN 20 ELSE 0 END * 1.0 AS el, CASE WHEN event_id % 37 = 0 THEN NULL ELSE 1.5 END AS own, CASE WHEN event_id % 41 = 0 THEN 900.0 ELSE 1e9 END AS until FROM events),
c AS (SELECT *, (r - a + s - b) / 2 AS off, ceil(greatest(el, b - a) / 2 + own + 8) AS unc FROM p), x AS (SELECT *, least(b + 60000, until - off - unc) AS ex FROM c),
j AS (SELECT *, CASE WHEN own IS NULL THEN 'invalid-probe' WHEN abs(b - a - el) > 10 THEN 'local-clock-discontinuity' WHEN s < r OR s - r > el + 2 THEN 'invalid-round-trip' WHEN ex <= b THEN 'source-expired' END AS error FROM x)
SELECT e AS event_id, error, CASE WHEN error IS NULL THEN off END AS offset_ms, CASE WHEN error IS NULL THEN unc END AS uncertainty_ms FROM j""",
)
def clock_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    received = 1000.0 + e % 50
    probe = S.clock_calibration(
        received, received + e % 9 - 1, F.lit(0.0), (e % 60).cast("double"), (e % 60 + F.when(e % 31 == 0, 20).otherwise(0)).cast("double"),
        F.when(e % 37 != 0, 1.5), F.when(e % 41 == 0, 900.0).otherwise(1e9)
    )
    return table(spark, sf_dir, "events").select(e, probe.alias("p")).select("event_id", "p.error", "p.offset_ms", "p.uncertainty_ms")


@query(
    "coding_labels",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN 's|' || o_orderpriority WHEN o_orderkey % 5 <> 0 THEN 't|x' ELSE '' END AS label, CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 11 > 0 THEN o_orderkey % 11 END AS dose FROM orders",
)
def coding_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    coding = lambda system, code: F.struct(system.alias("system"), code.alias("code"))
    codings = F.array(coding(F.when(k % 3 != 0, "s").otherwise(""), F.col("o_orderpriority")), coding(F.lit("t"), F.when(k % 5 != 0, "x").otherwise("")))
    dose = S.positive_dose((k % 11).cast("double"), F.when(k % 7 != 0, "U").otherwise(""))
    return table(spark, sf_dir, "orders").select(k, S.coding_label(codings).alias("label"), dose["value"].alias("dose"))


@query(
    "source_orders",
    """WITH v AS (SELECT o_orderkey AS k, (o_orderkey % 7)::VARCHAR AS a, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN (o_orderkey % 5)::VARCHAR ELSE 'x' END AS b, o_orderkey % 3 AS ua, o_orderkey % 2 AS ub FROM orders)
SELECT k AS o_orderkey, CASE WHEN b IS NOT NULL AND NOT CASE WHEN b <> 'x' THEN a::INT > b::INT ELSE ua > ub END THEN 'source-order' END AS refusal FROM v""",
)
def source_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    current = F.when(k % 4 == 0, None).when(k % 4 == 1, _text(k % 5)).otherwise("x")
    return table(spark, sf_dir, "orders").select(k, ingest.source_order_reason(_text(k % 7), k % 3, current, k % 2).alias("refusal"))


@query("rate_audit", "SELECT l_orderkey % 100 AS part, count(*) AS n, CAST(sum((l_orderkey % 13 <> 0 AND l_quantity > 0 AND l_linenumber <> 5)::INT) AS BIGINT) AS held FROM lineitem GROUP BY ALL")
def rate_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price a unit as a rate: shifted where the order's key is a multiple of 13, over nothing for line 5."""
    count, over = F.col("l_extendedprice"), F.when(F.col("l_linenumber") == 5, 0.0).otherwise(F.col("l_quantity"))
    told = F.coalesce(F.try_divide(count, over), F.lit(0.0)) * F.when(F.col("l_orderkey") % 13 == 0, 1 + 1e-12).otherwise(1.0)
    return table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 100).alias("part")).agg(F.count("*").alias("n"), F.sum(provenance.rate_holds(told, count, over).cast("long")).alias("held"))


@query(
    "window_claim_audit",
    f"""WITH w AS (SELECT l_orderkey AS k, l_linenumber AS n, min(l_partkey % 50) * 1.0 AS s, bool_or(l_returnflag <> 'R') AS good FROM lineitem GROUP BY ALL), x AS (SELECT *, s + 20 AS e FROM w WHERE good), o AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM x),
h AS (SELECT k, sum(greatest(0, e - greatest(s, coalesce(before, s)))) AS u, max(e) - min(s) AS span FROM o GROUP BY k), g AS (SELECT DISTINCT w.k AS k, coalesce(u, 0) AS u, coalesce(span, 0) AS span FROM w LEFT JOIN h ON h.k = w.k)
SELECT k AS session_id, {_LISTED(
    ('k % 3 = 0', 'repeated-window'), ('k % 5 = 0', 'window-count'), ('40 > u OR k % 11 = 0', 'duration-exceeds-windows'), ('k % 2 = 0 AND (k % 4 = 0 OR 45 > span)', 'span-exceeds-windows'), ('k % 2 = 0 AND span < 30', 'span-below-minimum'),
    ('k % 7 = 0 AND 35 > u', 'exposure-exceeds-windows'), ('k % 7 = 0 AND u < 25', 'exposure-below-minimum')
)} AS violations FROM g""",
)
def window_claim_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as windows, eligible unless all were returned; each order claims amounts, some ask for a span or an exposure, some name a window that is not there."""
    one = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg((F.min(F.col("l_partkey") % 50) * 1.0).alias("s"), F.max((F.col("l_returnflag") != "R").cast("int")).alias("good"))
    windows = one.select(
        F.concat_ws("-", _text(F.col("l_orderkey")), _text(F.col("l_linenumber"))).alias("window_id"), F.col("l_orderkey").alias("session_id"), "s", (F.col("s") + 20).alias("e"), F.when(F.col("good") == 1, "eligible").otherwise("withheld").alias("status")
    )
    k = F.col("session_id")
    lost = (k % 11 == 0).cast("long")
    claims = windows.groupBy("session_id").agg(F.count("*").alias("n")).select("session_id", (F.col("n") + lost + (k % 5 == 0).cast("long")).alias("window_count"), F.lit(40.0).alias("claimed_duration"),
        F.when(k % 2 == 0, 30.0).alias("minimum_span"), F.when(k % 4 != 0, 45.0).alias("claimed_span"), F.when(k % 7 == 0, 25.0).alias("minimum_exposure"), F.lit(35.0).alias("claimed_exposure"))
    refs = windows.select("session_id", "window_id")
    gone = claims.filter("session_id % 11 = 0").select("session_id", F.concat(F.lit("gone-"), _text(k)).alias("window_id"))
    refs = refs.unionByName(refs.filter("session_id % 3 = 0")).unionByName(gone)
    found = provenance.window_claims(claims, refs, windows.drop("session_id"), ["session_id"], "window_id", "s", "e")
    return found.select("session_id", F.array_join("violations", ",").alias("violations"))


@query(
    "definition_audit",
    f"""WITH o AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey % 31 = 0 AS unit, l_partkey % 37 = 0 AS context FROM lineitem) SELECT n, {_LISTED(('n > 4', 'unregistered-metric'), ('n <= 4 AND unit', 'unit-mismatch'), ('n <= 4 AND context', 'context-mismatch'))} AS violations, count(*) AS rows FROM o GROUP BY ALL""",
)
def definition_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = histories.definition_table(spark, [(str(n), "u", None) for n in range(1, 5)], "metric_code string, unit string, context string").drop("digest", "place")
    p = F.col("l_partkey")
    outcomes = table(spark, sf_dir, "lineitem").select(
        _text(F.col("l_linenumber")).alias("metric_code"), F.when(p % 31 == 0, "v").otherwise("u").alias("unit"), F.when(p % 37 == 0, "c").alias("context")
    )
    found = provenance.definition_errors(outcomes, registry, "metric_code", ["unit", "context"])
    return found.groupBy(F.col("metric_code").cast("long").alias("n"), F.array_join("violations", ",").alias("violations")).agg(F.count("*").alias("rows"))


@query(
    "registered_reasons",
    "SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'lane-down' WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'r' || o_orderkey % 4 END AS reason_code, count(*) AS n, CAST(sum((o_orderkey % 5 <> 0 AND o_orderkey % 3 <> 0 AND o_orderkey % 4 = 3)::INT) AS BIGINT) AS unregistered FROM orders GROUP BY ALL"
)
def registered_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    reason = F.when(k % 3 != 0, F.concat(F.lit("r"), _text(k % 4)))
    chosen = assembly.registered_reason(reason, _array("lane-down", "r0", "r1", "r2"), k % 5 != 0, F.lit("lane-down"))
    rows = table(spark, sf_dir, "orders").select(chosen.alias("c"))
    return rows.groupBy("c.reason_code").agg(F.count("*").alias("n"), F.sum(F.col("c.problem").isNotNull().cast("long")).alias("unregistered"))


@query(
    "disallowed_stages",
    "SELECT conv_id, turn FROM conversations WHERE NOT (turn % 2 = 0 AND role IN ({stages}))".replace("{stages}", ", ".join(f"'{s}'" for s in ("user", "system"))),
)
def disallowed_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns by parity as event types: even ones belong to two roles, odd ones to none."""
    allowed = spark.createDataFrame([("even", "user"), ("even", "system")], "type string, stage string")
    turns = table(spark, sf_dir, "conversations").filter("role is not null").select(
        "conv_id", "turn", F.when(F.col("turn") % 2 == 0, "even").otherwise("odd").alias("type"), F.col("role").alias("stage")
    )
    return journal.disallowed(turns, "type", "stage", allowed).select("conv_id", "turn")


@query(
    "block_continuity",
    f"{measures.BLOCKS_SQL} SELECT c.user_id, event_id, ok AS accepted, lost AS lost_before, gap AS gap_ms, jump AS discontinuous, back AS time_back, restart AS restart_no FROM c JOIN e USING (user_id, k)",
)
def block_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sessionize.block_continuity(measures.audio_blocks(spark, sf_dir), ["user_id"], ["event_id"], "seq", "idx", "len", "at_ms", "rate")
    return found.select("user_id", "event_id", "accepted", "lost_before", "gap_ms", "discontinuous", "time_back", "restart_no")


@query("permitted_orders", "SELECT o_orderkey FROM orders WHERE o_custkey % 9 IN (SELECT c_custkey % 9 FROM customer WHERE c_custkey % 9 < 3)")
def permitted_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    grants = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 9).alias("study")).filter("study < 3")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 9).alias("study"))
    return governance.permitted_scope(rows, grants, ["study"]).select("o_orderkey")
