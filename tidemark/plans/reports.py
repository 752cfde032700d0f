"""Queries over lineitem as outcomes of sessions: windows, metric rows, lane summaries, report sections, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assembly
from .catalog import query, table


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order a session, its lines the outcomes: discount decides the status, tax is the quality, quantity the eligible time."""
    measured = F.col("l_discount") > 0.02
    quantity = F.col("l_quantity").cast("long")
    ref = F.concat_ws(":", F.lit("face"), F.lit("1"), F.lit("t"), (F.col("l_partkey") % 5).cast("string"), (F.col("l_partkey") % 5 + quantity % 3).cast("string"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").cast("string").alias("metric_code"), F.when(F.col("l_returnflag") == "R", "voice").otherwise("face").alias("modality"), F.when(measured, "measured").otherwise("withheld").alias("status"),
        F.when(
            ~measured, F.concat(F.lit("reason-"), (F.col("l_suppkey") % 4).cast("string"))
        ).alias("reason_code"), F.when(measured, F.col("l_extendedprice")).alias("value"), F.when(measured, F.col("l_tax")).alias("technical_quality_score"), F.col("l_quantity").alias("eligible_ms"),
        F.array(ref).alias("window_refs"), F.when(F.col("l_suppkey") % 9 == 0, F.array(F.lit("p1"), F.lit("p2"))).otherwise(F.array(F.lit("p1"))).alias("processor_refs"),
    )


OUTCOMES = """o AS (SELECT l_orderkey AS session_id, l_linenumber::VARCHAR AS metric_code, CASE WHEN l_returnflag = 'R' THEN 'voice' ELSE 'face' END AS modality, l_discount > 0.02 AS m, CASE WHEN l_discount > 0.02 THEN NULL ELSE 'reason-' || (l_suppkey % 4) END AS reason,
  l_tax AS q, l_quantity AS e, l_extendedprice AS v, 'face:1:t:' || (l_partkey % 5) || ':' || (l_partkey % 5 + l_quantity::BIGINT % 3) AS ref, l_suppkey % 9 = 0 AS mixed FROM lineitem)"""


@query(
    "lane_summaries",
    f"""WITH {OUTCOMES} SELECT session_id, modality, CASE WHEN bool_or(m) THEN 'ready' ELSE 'withheld' END AS state, max(e) AS eligible_ms, round(avg(q) FILTER (WHERE m), 6) AS technical_quality_score, coalesce(string_agg(DISTINCT reason, ',' ORDER BY reason), '') AS reason_codes FROM o GROUP BY session_id, modality""",
)
def lane_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.lane_summaries(outcomes(spark, sf_dir)).select(
        "session_id", "modality", "state", "eligible_ms", F.round("technical_quality_score", 6).alias("technical_quality_score"),
        F.array_join("reason_codes", ",").alias("reason_codes")
    )


@query(
    "source_windows",
    f"""WITH {OUTCOMES}, r AS (SELECT DISTINCT session_id, ref, split_part(ref, ':', 4)::DOUBLE AS s, split_part(ref, ':', 5)::DOUBLE AS e FROM o)
SELECT session_id, 'window-' || substr(sha256(ref), 1, 24) AS window_id, s AS start_ms, e AS end_ms, CASE WHEN e <= s THEN 'window-bounds' ELSE '' END AS violations FROM r""",
)
def source_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.source_windows(outcomes(spark, sf_dir)).select("session_id", "window_id", "start_ms", "end_ms", F.array_join("violations", ",").alias("violations"))


@query(
    "demoted_outcomes",
    f"""WITH {OUTCOMES}, d AS (SELECT CASE WHEN NOT m THEN reason WHEN mixed THEN 'quality-threshold-failed' WHEN modality <> 'face' THEN 'processor-unavailable' WHEN session_id % 10 = 0 THEN 'asset-integrity-failed' END AS reason_code FROM o)
SELECT coalesce(reason_code, 'measured') AS result, count(*) AS n FROM d GROUP BY ALL""",
)
def demoted_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    processors = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session_id")).distinct().select(
        "session_id", F.lit("p1").alias("processor_ref"), F.lit("face").alias("processor_modality"), (F.col("session_id") % 10 != 0).alias("integrity_verified")
    )
    return assembly.demoted(outcomes(spark, sf_dir), processors).groupBy(F.when(F.col("status") == "measured", "measured").otherwise(F.col("reason_code")).alias("result")).agg(F.count("*").alias("n"))


@query(
    "durable_observations",
    f"WITH {OUTCOMES} SELECT session_id, count(*) AS metrics, count(DISTINCT ref) AS windows, sha256(CASE WHEN bool_or(mixed) THEN 'p1|p2' ELSE 'p1' END) AS processor_fingerprint FROM o GROUP BY session_id"
)
def durable_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = assembly.durable_observations(outcomes(spark, sf_dir))
    return d.select("session_id", F.size("metrics").cast("long").alias("metrics"), F.size("windows").cast("long").alias("windows"), "processor_fingerprint")


SECTIONS = [("timing", "1", 1), ("timing", "2", 2), ("motion", "3", 1), ("motion", "4", 2)]


@query(
    "report_sections",
    f"""WITH {OUTCOMES}, s AS (SELECT * FROM (VALUES {', '.join(map(str, SECTIONS))}) t(section, metric_code, position)), bad AS (SELECT DISTINCT session_id FROM o WHERE mixed)
SELECT session_id, section, count(*) AS n, string_agg(metric_code, ',' ORDER BY position) AS codes FROM o JOIN s USING (metric_code) WHERE session_id NOT IN (SELECT session_id FROM bad) GROUP BY session_id, section""",
)
def report_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = outcomes(spark, sf_dir)
    sections = spark.createDataFrame(SECTIONS, "section string, metric_code string, position int")
    r = assembly.report_sections(o, sections, o.filter(F.size("processor_refs") > 1))
    return r.select("session_id", "section", "n", F.array_join("outcomes.metric_code", ",").alias("codes"))


@query(
    "section_audit",
    f"""WITH {OUTCOMES}, s AS (SELECT * FROM (VALUES {', '.join(map(str, SECTIONS))}) t(own, metric_code, position)), t AS (SELECT session_id, metric_code, count(*) AS k FROM o GROUP BY ALL),
v AS (SELECT concat_ws(',', CASE WHEN own IS NULL THEN 'unregistered-metric' END, CASE WHEN own <> 'timing' THEN 'wrong-section' END, CASE WHEN k > 1 THEN 'repeated-metric' END) AS violations FROM o LEFT JOIN s USING (metric_code) JOIN t USING (session_id, metric_code))
SELECT violations, count(*) AS n FROM v GROUP BY violations""",
)
def section_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line reported as timing, whatever its metric."""
    reported = outcomes(spark, sf_dir).select("session_id", F.lit("timing").alias("section"), "metric_code")
    sections = spark.createDataFrame(SECTIONS, "section string, metric_code string, position int")
    return assembly.section_errors(reported, sections).groupBy(F.array_join("violations", ",").alias("violations")).agg(F.count("*").alias("n"))


@query(
    "summary_audit",
    f"""WITH {OUTCOMES}, g AS (SELECT session_id, modality, bool_or(m) AS ready, count(DISTINCT reason) AS reasons FROM o GROUP BY session_id, modality)
SELECT CASE WHEN NOT ready THEN concat_ws(',', 'ready-without-measurement', CASE WHEN reasons > 0 THEN 'reason-omitted' END) ELSE concat_ws(',', CASE WHEN reasons > 0 THEN 'reason-omitted' END) END AS violations, count(*) AS n FROM g GROUP BY ALL""",
)
def summary_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries that claim every lane ready and no reasons."""
    o = outcomes(spark, sf_dir)
    claimed = assembly.lane_summaries(o).withColumn("state", F.lit("ready")).withColumn("reason_codes", F.array().cast("array<string>"))
    return assembly.summary_errors(claimed, o).groupBy(F.array_join("violations", ",").alias("violations")).agg(F.count("*").alias("n"))
