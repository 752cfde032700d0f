"""Queries through spark.sql: detectors as table functions, results as views; documents, digests and references of several kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import canonical, tables
from ..operators import assembly, documents, journal, provenance
from ..sources import registry
from . import reports, streams, voice_lane
from .catalog import QUERIES, query, table


@query("sql_blinks", streams._BLINKS_SQL)
def sql_blinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables.register(spark)
    streams.blink_frames(table(spark, sf_dir, "events")).createOrReplaceTempView("tidemark_frames")
    return spark.sql(
        "SELECT session_id, offset_ms, offset_ms - (frame_count - 1) * 40.0D AS shut_ms, round(lid_minimum, 4) AS lid_minimum FROM tidemark_blinks(TABLE(tidemark_frames) PARTITION BY session_id)"
    )


@query("sql_noise_floors", streams._NOISE_SQL)
def sql_noise_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables.register(spark)
    streams._noise_frames(table(spark, sf_dir, "events")).createOrReplaceTempView("tidemark_noise_frames")
    return spark.sql("SELECT session_id, at_ms, round(noise_floor_rms, 9) AS noise_floor_rms, duration_ms FROM tidemark_noise_floors(TABLE(tidemark_noise_frames) PARTITION BY session_id)")


@query("sql_withheld_metrics", f"SELECT metric_code, coalesce(reason_code, 'measured') AS result, count(*) AS sessions FROM ({voice_lane.METRICS_SQL}) m GROUP BY ALL")
def sql_withheld_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registered query's result as a view, counted in SQL."""
    (view,) = tables.publish(spark, sf_dir, QUERIES, ["voice_metrics"])
    return spark.sql(f"SELECT metric_code, coalesce(reason_code, 'measured') AS result, count(*) AS sessions FROM {view} GROUP BY metric_code, reason_code")


_REASONS_SQL = ", ".join(f"('{code}', {[*registry.ANY_REASONS, *registry.MODALITY_REASONS[modality], *registry.OWN_REASONS.get(code, [])]})" for code, modality, *_ in registry.METRICS)


@query(
    "metric_reason_audit",
    f"""WITH a AS (SELECT * FROM (VALUES {_REASONS_SQL}) t(metric_code, allowed)), o AS (SELECT l_linenumber, l_suppkey % 6 AS lane, l_discount > 0.05 AS there, list_extract(['insufficient-duration', 'insufficient-events', 'multiple-faces', 'insufficient-nuclei', 'unheard-of'], CAST(1 + l_partkey % 5 AS INT)) AS reason,
  (SELECT list(metric_code ORDER BY metric_code) FROM a)[1 + l_orderkey % 27] AS metric_code FROM lineitem),
c AS (SELECT metric_code, CASE WHEN there THEN reason ELSE 'modality-unavailable' END AS reason FROM o) SELECT metric_code, reason AS reason_code, CASE WHEN NOT list_contains(allowed, reason) THEN 'reason-not-registered' END AS problem, count(*) AS n FROM c JOIN a USING (metric_code) GROUP BY ALL""",
)
def metric_reason_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as withheld outcomes of all registered metrics, each with a reason that its metric may have or not."""
    codes = sorted(m[0] for m in registry.METRICS)
    given = F.array(*[F.lit(r) for r in ("insufficient-duration", "insufficient-events", "multiple-faces", "insufficient-nuclei", "unheard-of")])
    lines = table(spark, sf_dir, "lineitem").select(
        F.get(F.array(*[F.lit(c) for c in codes]), (F.col("l_orderkey") % len(codes)).cast("int")).alias("metric_code"), F.get(given, (F.col("l_partkey") % 5).cast("int")).alias("reason"), (F.col("l_discount") > 0.05).alias("there")
    )
    judged = lines.join(registry.allowed_reasons(spark), "metric_code").withColumn("judged", assembly.registered_reason(F.col("reason"), F.col("allowed_reasons"), F.col("there"), F.lit("modality-unavailable")))
    return judged.groupBy("metric_code", F.col("judged.reason_code").alias("reason_code"), F.col("judged.problem").alias("problem")).agg(F.count("*").alias("n"))


@query(
    "nested_digests",
    """WITH l AS (SELECT l_orderkey, string_agg('{"flag":"' || l_returnflag || '","no":' || l_linenumber || ',"quantity":' || regexp_replace(l_quantity::DOUBLE::VARCHAR, '\\.0$', '') || '}', ',' ORDER BY l_linenumber, l_returnflag, l_quantity) AS lines FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, sha256('{"key":' || o_orderkey || ',"lines":' || coalesce('[' || lines || ']', 'null') || ',"total":{"price":' || regexp_replace(o_totalprice::DOUBLE::VARCHAR, '\\.0$', '') || ',"priority":"' || o_orderpriority || '"}}') AS digest FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""",
)
def nested_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their lines and total, without what changes each time they are recorded, at any depth."""
    line = F.struct(F.col("l_linenumber").cast("int").alias("no"), F.col("l_returnflag").alias("flag"), F.col("l_quantity").cast("double").alias("quantity"), F.col("l_shipdate").cast("string").alias("recordedAt"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    total = F.struct(F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").cast("double").alias("price"), F.current_timestamp().alias("recordedAt"))
    nested = table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left").select(total.alias("total"), "lines", F.col("o_orderkey").alias("key"), F.lit("now").alias("recordedAt"))
    return nested.select(F.col("key").alias("o_orderkey"), canonical.row_digest(nested, without=["recordedAt"]).alias("digest"))


@query(
    "typed_reference_audit",
    """WITH c AS (SELECT conv_id, turn FROM conversations),
r AS (SELECT conv_id, turn, 'turn' AS kind, (conv_id + CASE WHEN (conv_id + turn) % 7 = 0 THEN 1 ELSE 0 END)::VARCHAR || ':' || (turn + CASE WHEN (conv_id + turn) % 5 = 0 THEN 1 ELSE -1 END) AS target_id FROM c WHERE turn > 0
  UNION ALL SELECT conv_id, turn, CASE WHEN turn % 11 = 3 THEN 'note' ELSE 'label' END, (conv_id * 3 + turn)::VARCHAR FROM c),
t AS (SELECT 'turn' AS kind, conv_id || ':' || turn AS target_id, conv_id AS s, turn AS p FROM c UNION ALL SELECT 'label', doc_id::VARCHAR, NULL, NULL FROM labels),
g AS (SELECT kind, target_id, count(*) AS n, max(s) AS s, max(p) AS p FROM t GROUP BY kind, target_id),
v AS (SELECT r.kind, CASE WHEN r.kind = 'note' THEN 'unknown-kind' WHEN n IS NULL THEN 'dangling-reference' WHEN n > 1 THEN 'ambiguous-reference' WHEN s <> conv_id THEN 'crosses-scope' WHEN p >= turn THEN 'recorded-later' ELSE '' END AS violations
  FROM r LEFT JOIN g ON g.kind = r.kind AND g.target_id = r.target_id) SELECT kind, violations, count(*) AS n FROM v GROUP BY ALL""",
)
def typed_reference_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that refer to turns (some later, some of another conversation), to labels (some missing), and to a kind that nobody knows."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    both = F.col("conv_id") + F.col("turn")
    name = lambda conv, turn: F.concat_ws(":", conv.cast("string"), turn.cast("string")).alias("target_id")
    to_turn = c.filter("turn > 0").select("conv_id", "turn", F.lit("turn").alias("kind"), name(F.col("conv_id") + (both % 7 == 0).cast("long"), F.col("turn") + F.when(both % 5 == 0, 1).otherwise(-1)))
    to_label = c.select("conv_id", "turn", F.when(F.col("turn") % 11 == 3, "note").otherwise("label").alias("kind"), (F.col("conv_id") * 3 + F.col("turn")).cast("string").alias("target_id"))
    none = F.lit(None).cast("long")
    targets = {"turn": c.select("conv_id", "turn", name(F.col("conv_id"), F.col("turn"))), "label": table(spark, sf_dir, "labels").select(F.col("doc_id").alias("target_id"), none.alias("conv_id"), none.alias("turn"))}
    judged = provenance.resolve_typed_refs(to_turn.unionByName(to_label), targets, "conv_id", "turn")
    return judged.groupBy("kind", F.array_join("violations", ",").alias("violations")).agg(F.count("*").alias("n"))


@query(
    "evidence_scope_audit",
    """SELECT conv_id, turn FROM conversations c WHERE (turn % 3 = 1 AND turn % 2 = 0) OR (turn % 4 = 2 AND role IS NOT NULL)""",
)
def evidence_scope_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns whose evidence is of another conversation, or of another role than theirs."""
    ref = lambda conv, role: F.struct(conv.alias("conv_id"), role.alias("role"))
    foreign = F.col("conv_id") + ((F.col("turn") % 3 == 1) & (F.col("turn") % 2 == 0)).cast("long")
    other = F.when(F.col("turn") % 4 == 2, F.lit(None).cast("string")).otherwise(F.col("role"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.concat_ws(":", "conv_id", "turn").alias("event_id"), F.array(ref(foreign, F.col("role")), ref(F.col("conv_id"), other)).alias("evidence"))
    judged = journal.sequence_audit(turns, "conv_id", "turn", "event_id", "turn", first=0, evidence="evidence")
    return judged.filter(F.array_contains("problems", "evidence-crosses-scope")).select("conv_id", "turn")


_PROTOCOL = [("timing", "1", 1), ("timing", "2", 2), ("motion", "4", 1), ("motion", "3", 2)]
_DOCUMENTS_SQL = f"""WITH {reports.OUTCOMES}, d AS (SELECT session_id, bool_or(m) FILTER (WHERE modality = 'voice') AS voice, bool_or(m) FILTER (WHERE modality = 'face') AS face, bool_or(mixed) AS failed FROM o GROUP BY session_id),
w AS (SELECT session_id, ref, bool_or(m) AS good FROM o GROUP BY ALL), n AS (SELECT session_id, count(*) FILTER (good) AS good, count(*) FILTER (NOT good) AS bad FROM w GROUP BY session_id)"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = reports.outcomes(spark, sf_dir)
    sessions = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"), (F.col("o_totalprice") * 10).alias("duration_ms"))
    return documents.session_documents(o, sessions, o.filter(F.size("processor_refs") > 1).select("session_id"), _PROTOCOL)


@query(
    "document_round_trip",
    f"WITH {reports.OUTCOMES} SELECT session_id, metric_code, modality, CASE WHEN m THEN 'measured' ELSE 'withheld' END AS status, reason AS reason_code, CASE WHEN m THEN v END AS value, e AS eligible_ms, ref AS window_ref, CASE WHEN mixed THEN 2 ELSE 1 END AS processors FROM o",
)
def document_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents taken apart again: the rows that went in."""
    rows = documents.outcomes_of(_documents(spark, sf_dir))
    return rows.select("session_id", "metric_code", "modality", "status", "reason_code", "value", "eligible_ms", F.get("window_refs", F.lit(0)).alias("window_ref"), F.size("processor_refs").alias("processors"))


@query(
    "document_quality_facts",
    f"""{_DOCUMENTS_SQL}, f AS (SELECT d.session_id, round(o_totalprice * 10, 4) AS duration, CASE WHEN voice THEN 'ready' WHEN voice IS NULL THEN 'absent' ELSE 'withheld' END AS v, CASE WHEN face THEN 'ready' WHEN face IS NULL THEN 'absent' ELSE 'withheld' END AS c, good, bad
  FROM d JOIN n USING (session_id) LEFT JOIN orders ON o_orderkey = session_id WHERE NOT failed)
SELECT session_id, 'session-duration' AS code, duration AS number, NULL AS text, 'milliseconds' AS unit FROM f UNION ALL SELECT session_id, 'voice-lane', NULL, v, NULL FROM f UNION ALL SELECT session_id, 'face-lane', NULL, c, NULL FROM f
UNION ALL SELECT session_id, 'eligible-windows', good, NULL, 'windows' FROM f UNION ALL SELECT session_id, 'withheld-windows', bad, NULL, 'windows' FROM f""",
)
def document_quality_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five facts of each report's section on capture quality; sessions whose provenance fails have no report."""
    return documents.facts_of(_documents(spark, sf_dir)).select("session_id", "code", F.round("number", 4).alias("number"), "text", "unit")


@query(
    "document_sections",
    f"""{_DOCUMENTS_SQL}, s AS (SELECT * FROM (VALUES {', '.join(map(str, _PROTOCOL))}) t(section, metric_code, position)), x AS (SELECT session_id, section FROM d CROSS JOIN (SELECT DISTINCT section FROM s UNION ALL SELECT 'capture-quality') y WHERE NOT failed)
SELECT x.session_id, x.section, CASE WHEN x.section = 'capture-quality' THEN 5 ELSE 0 END AS facts, coalesce(string_agg(o.metric_code, ',' ORDER BY position), '') AS codes FROM x LEFT JOIN s ON s.section = x.section LEFT JOIN o ON o.session_id = x.session_id AND o.metric_code = s.metric_code GROUP BY ALL""",
)
def document_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.section_rows(_documents(spark, sf_dir)).select("session_id", "section", F.size("facts").alias("facts"), F.array_join("metric_codes", ",").alias("codes"))


@query(
    "document_windows",
    f"{_DOCUMENTS_SQL} SELECT session_id, 'window-' || substr(sha256(ref), 1, 24) AS window_id, split_part(ref, ':', 4)::DOUBLE AS start_ms, split_part(ref, ':', 5)::DOUBLE AS end_ms, CASE WHEN good THEN 'eligible' ELSE 'withheld' END AS status FROM w",
)
def document_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.windows_of(_documents(spark, sf_dir)).drop("ref")


@query(
    "document_lanes",
    f"""WITH {reports.OUTCOMES}, x AS (SELECT * FROM (SELECT DISTINCT session_id FROM o) CROSS JOIN (SELECT unnest(['voice', 'face']) AS modality))
SELECT x.session_id, x.modality, CASE WHEN bool_or(m) THEN 'ready' WHEN count(m) > 0 THEN 'withheld' ELSE 'absent' END AS state, coalesce(max(e), 0)::DOUBLE AS eligible_ms, round(avg(q::DOUBLE) FILTER (WHERE m), 6) AS technical_quality_score, coalesce(string_agg(DISTINCT reason, ',' ORDER BY reason), '') AS reason_codes
  FROM x LEFT JOIN o ON o.session_id = x.session_id AND o.modality = x.modality GROUP BY x.session_id, x.modality""",
)
def document_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.lanes_of(_documents(spark, sf_dir)).withColumns({"technical_quality_score": F.round("technical_quality_score", 6), "reason_codes": F.array_join("reason_codes", ",")})
