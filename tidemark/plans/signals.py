"""Queries over events: sessions, robust statistics, runs, rolling sums, gates and bins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import robust, sessionize
from .catalog import query, table

HOUR = 3_600_000_000
DAY = 24 * HOUR


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, event_type, value, and us in microseconds."""
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessionize.gap_sessions(events(spark, sf_dir), ["user_id"], ["us", "event_id"], "us", 12 * HOUR)


SESSIONS = f"""e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS us FROM events),
g AS (SELECT *, CASE WHEN us - lag(us) OVER w > {12 * HOUR} OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS opens FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
s AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no FROM g)"""


@query(
    "robust_session_value",
    f"""WITH {SESSIONS},
m AS (SELECT user_id, session_no, count(*) AS n, (max(us) - min(us)) / {HOUR}.0 AS span_h, quantile_cont(value, 0.5) AS med, quantile_cont(value, 0.9) AS p90 FROM s GROUP BY user_id, session_no),
d AS (SELECT s.user_id, s.session_no, quantile_cont(abs(s.value - m.med), 0.5) AS mad FROM s JOIN m USING (user_id, session_no) GROUP BY s.user_id, s.session_no),
r AS (SELECT *, CASE WHEN n < 5 THEN 'insufficient-events' WHEN span_h < 12 THEN 'insufficient-duration' END AS reason_code FROM m JOIN d USING (user_id, session_no))
SELECT user_id, session_no, n, round(span_h, 6) AS span_h, CASE WHEN reason_code IS NULL THEN 'measured' ELSE 'withheld' END AS status, reason_code,
  CASE WHEN reason_code IS NULL THEN round(med, 6) END AS median_value, CASE WHEN reason_code IS NULL THEN round(mad, 6) END AS mad_value, CASE WHEN reason_code IS NULL THEN round(p90, 6) END AS p90_value FROM r""",
)
def robust_session_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = robust.median_and_mad(
        user_sessions(spark, sf_dir), ["user_id", "session_no"], "value",
        F.count("*").alias("n"), ((F.max("us") - F.min("us")) / float(HOUR)).alias("span_h"), robust.percentile("value", 0.9).alias("p90_value"),
    )
    reason = S.first_reason([(F.col("n") < 5, "insufficient-events"), (F.col("span_h") < 12, "insufficient-duration")])
    measured = lambda c: F.when(reason.isNull(), F.round(c, 6)).alias(c)
    return stats.select(
        "user_id", "session_no", "n", F.round("span_h", 6).alias("span_h"), F.when(reason.isNull(), "measured").otherwise("withheld").alias("status"), reason.alias("reason_code"),
        measured("median_value"), measured("mad_value"), measured("p90_value"),
    )


@query(
    "mean_sd_by_type",
    "SELECT user_id, event_type, count(*) AS n, round(avg(value), 6) AS mean_value, round(CASE WHEN count(*) < 2 THEN 0 ELSE stddev_pop(value) END, 6) AS sd_value FROM events GROUP BY user_id, event_type",
)
def mean_sd_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("user_id", "event_type").agg(
        F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"), F.round(robust.population_sd("value"), 6).alias("sd_value")
    )


@query(
    "nominal_step_by_user",
    f"""WITH e AS (SELECT user_id, epoch_us(ts) AS us, event_id FROM events), d AS (SELECT user_id, us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS step FROM e)
SELECT user_id, round(coalesce(quantile_cont(CAST(step AS DOUBLE), 0.5) FILTER (WHERE step > 0 AND step <= {6 * HOUR}), {HOUR}.0) / {HOUR}.0, 6) AS nominal_h FROM d GROUP BY user_id""",
)
def nominal_step_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    stepped = robust.steps(events(spark, sf_dir), ["user_id"], ["us", "event_id"], "us")
    return stepped.groupBy("user_id").agg(F.round(robust.nominal_step("step_before", 6 * HOUR, float(HOUR)) / float(HOUR), 6).alias("nominal_h"))


@query(
    "timed_percentile_by_bin",
    f"""WITH e AS (SELECT user_id, event_id, value, epoch_us(ts) AS us FROM events), b AS (SELECT *, CAST(floor((us - epoch_us(TIMESTAMP '2024-01-01')) / {5 * DAY}.0) AS BIGINT) AS bin FROM e),
d AS (SELECT *, us - lag(us) OVER w AS before, lead(us) OVER w - us AS after FROM b WINDOW w AS (PARTITION BY user_id, bin ORDER BY us, event_id)),
n AS (SELECT user_id, bin, coalesce(quantile_cont(CAST(before AS DOUBLE), 0.5) FILTER (WHERE before > 0 AND before <= {DAY}), {HOUR}.0) AS nominal FROM d GROUP BY user_id, bin),
w AS (SELECT d.user_id, d.bin, d.event_id, d.value, CASE WHEN after IS NULL THEN nominal ELSE least({DAY}.0, greatest(0.0, CAST(after AS DOUBLE))) END AS weight FROM d JOIN n USING (user_id, bin)),
c AS (SELECT *, sum(weight) OVER (PARTITION BY user_id, bin ORDER BY value, event_id ROWS UNBOUNDED PRECEDING) AS running, sum(weight) OVER (PARTITION BY user_id, bin) AS whole FROM w)
SELECT user_id, bin, count(*) AS n, round(min(value) FILTER (WHERE running >= 0.9 * whole), 6) AS p90_timed FROM c GROUP BY user_id, bin""",
)
def timed_percentile_by_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    binned = events(spark, sf_dir).withColumn("bin", F.floor((F.col("us") - start) / float(5 * DAY)))
    weighted = robust.frame_weights(binned, ["user_id", "bin"], ["us", "event_id"], "us", float(DAY), float(HOUR))
    timed = robust.timed_percentile(weighted, ["user_id", "bin"], "value", "weight_ms", 0.9, ["event_id"])
    counted = binned.groupBy("user_id", "bin").agg(F.count("*").alias("n"))
    return counted.join(timed, ["user_id", "bin"]).select("user_id", "bin", "n", F.round("timed_percentile", 6).alias("p90_timed"))


@query(
    "type_runs",
    """WITH e AS (SELECT user_id, event_id, event_type, value, epoch_us(ts) AS us FROM events),
c AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS opens FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
r AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run_no FROM c),
g AS (SELECT user_id, run_no, min(event_type) AS event_type, count(*) AS n, max(us) - min(us) AS length_us, max(value) AS peak, min(value) AS floor FROM r GROUP BY user_id, run_no),
k AS (SELECT *, run_no = 1 OR run_no = max(run_no) OVER (PARTITION BY user_id) AS edge FROM g)
SELECT user_id, run_no, event_type, n, length_us, CASE WHEN edge THEN 'truncated' WHEN n >= 2 AND floor > 0 AND peak >= 2.5 * floor THEN 'breath' ELSE 'hesitation' END AS kind FROM k""",
)
def type_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = sessionize.runs(events(spark, sf_dir), ["user_id"], ["us", "event_id"], "event_type")
    grouped = numbered.groupBy("user_id", "run_no").agg(
        F.min("event_type").alias("event_type"), F.count("*").alias("n"), (F.max("us") - F.min("us")).alias("length_us"), F.max("value").alias("peak"),
        F.min("value").alias("floor")
    )
    edge = (F.col("run_no") == 1) | (F.col("run_no") == F.max("run_no").over(Window.partitionBy("user_id")))
    kind = S.first_reason([(edge, "truncated"), ((F.col("n") >= 2) & (F.col("floor") > 0) & (F.col("peak") >= 2.5 * F.col("floor")), "breath")], F.lit("hesitation"))
    return grouped.withColumn("kind", kind).drop("peak", "floor")


@query(
    "rolling_day_value",
    f"""WITH e AS (SELECT user_id, event_id, value, epoch_us(ts) AS us FROM events)
SELECT event_id, user_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW), 4) AS day_value FROM e""",
)
def rolling_day_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", "user_id", F.round(sessionize.rolling_sum(["user_id"], F.col("us"), "value", DAY), 4).alias("day_value"))


@query(
    "shipping_interval_union",
    """WITH l AS (SELECT l_orderkey, epoch_us(l_shipdate) // 86400000000 AS s, epoch_us(l_shipdate) // 86400000000 + CAST(l_quantity AS BIGINT) AS e FROM lineitem),
o AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS opens FROM l),
i AS (SELECT *, sum(opens) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM o),
g AS (SELECT l_orderkey, island, min(s) AS low, max(e) AS high FROM i GROUP BY l_orderkey, island)
SELECT l_orderkey, CAST(sum(high - low) AS BIGINT) AS union_days, count(*) AS islands, CAST(max(high) - min(low) AS BIGINT) AS span_days, sum(high - low) = max(high) - min(low) AS continuous FROM g GROUP BY l_orderkey""",
)
def shipping_interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.unix_date(F.col("l_shipdate").cast("date")).cast("long")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", day.alias("start_day"), (day + F.col("l_quantity").cast("long")).alias("end_day"))
    span = F.col("cover_end") - F.col("cover_start")
    return robust.interval_union(lines, ["l_orderkey"], "start_day", "end_day").select(
        "l_orderkey", F.col("union_length").alias("union_days"), "islands", span.alias("span_days"), (F.col("union_length") == span).alias("continuous")
    )
