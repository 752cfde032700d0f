"""Queries over orders, lineitem and conversations: revision chains, alignment, comparison, admission, replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import compare, history, ingest, journal
from .catalog import query, table

DAY = history.DAY_US


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as observations of customers: us is the order date in microseconds, prev the customer's order before."""
    w = Window.partitionBy("o_custkey").orderBy("us", "o_orderkey")
    o = table(spark, sf_dir, "orders").withColumn("us", F.unix_micros(F.col("o_orderdate").cast("timestamp"))).drop("o_orderdate")
    return o.withColumn("prev", F.lag("o_orderkey").over(w))


ORDERS = "o AS (SELECT *, epoch_us(o_orderdate) AS us, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM orders)"


@query(
    "latest_order_by_customer",
    f"WITH {ORDERS}, r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY us DESC, o_orderkey DESC) AS k FROM o) SELECT o_custkey, o_orderkey, us, o_totalprice FROM r WHERE k = 1"
)
def latest_order_by_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.latest_version(orders(spark, sf_dir), ["o_custkey"], ["us", "o_orderkey"]).select("o_custkey", "o_orderkey", "us", "o_totalprice")


@query(
    "revision_chain_audit",
    f"""WITH {ORDERS}, b AS (SELECT o_custkey, o_orderkey, us, CASE WHEN o_orderkey % 97 = 0 THEN -1 WHEN o_orderkey % 89 = 0 THEN NULL ELSE prev END AS prev FROM o),
l AS (SELECT b.*, p.o_orderkey IS NOT NULL AND p.us <= b.us AS sound FROM b LEFT JOIN b p ON p.o_custkey = b.o_custkey AND p.o_orderkey = b.prev),
s AS (SELECT o_custkey, prev AS o_orderkey, count(*) AS succ FROM l WHERE sound GROUP BY ALL),
g AS (SELECT l.o_custkey, count(*) AS n, sum((l.prev IS NULL)::INT) AS roots, sum((succ IS NULL)::INT) AS leaves, sum(sound::INT) AS links, max(coalesce(succ, 0)) > 1 AS forked, max(CASE WHEN succ IS NULL THEN l.o_orderkey END) AS leaf
  FROM l LEFT JOIN s ON s.o_custkey = l.o_custkey AND s.o_orderkey = l.o_orderkey GROUP BY l.o_custkey),
p AS (SELECT *, concat_ws(',', CASE WHEN roots <> 1 THEN 'no-single-root' END, CASE WHEN leaves <> 1 THEN 'no-single-leaf' END, CASE WHEN forked THEN 'revision-fork' END, CASE WHEN links <> n - roots THEN 'invalid-link' END) AS problems FROM g)
SELECT o_custkey, n, CASE WHEN problems = '' THEN leaf END AS leaf, problems FROM p""",
)
def revision_chain_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of which some revisions name a missing predecessor and some none."""
    broken = orders(spark, sf_dir).withColumn(
        "prev", F.when(F.col("o_orderkey") % 97 == 0, F.lit(-1)).when(F.col("o_orderkey") % 89 == 0, None).otherwise(F.col("prev"))
    ).withColumn("chain", F.col("o_custkey"))
    return history.chain_audit(broken, ["o_custkey"], "chain", "o_orderkey", "prev", "us").select("o_custkey", "n", "leaf", F.array_join("problems", ",").alias("problems"))


CUTS = ["1994-06-30", "1996-12-31", "1998-08-02"]


@query(
    "as_of_snapshots",
    f"""WITH {ORDERS}, a AS (SELECT unnest([{', '.join(f"TIMESTAMP '{c}'" for c in CUTS)}]) AS cut), k AS (SELECT o.*, epoch_us(cut) AS as_of FROM o JOIN a ON o.us <= epoch_us(cut)),
r AS (SELECT *, count(*) OVER (PARTITION BY o_custkey, as_of) AS known, row_number() OVER (PARTITION BY o_custkey, as_of ORDER BY us DESC, o_orderkey DESC) AS k FROM k)
SELECT o_custkey, as_of, known, o_orderkey AS current_order FROM r WHERE k = 1""",
)
def as_of_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = orders(spark, sf_dir)
    cuts = F.array(*[F.unix_micros(F.lit(c).cast("timestamp")) for c in CUTS])
    snapshots = o.select("o_custkey").distinct().withColumn("as_of", F.explode(cuts))
    known = history.known_at(o, snapshots, ["o_custkey"], "us", "as_of")
    return known.groupBy("o_custkey", "as_of").agg(F.count("*").alias("known"), F.max_by("o_orderkey", F.struct("us", "o_orderkey")).alias("current_order"))


PHASES = [("early", 0.0, 90.0, 2), ("middle", 90.0, 365.0, 2), ("late", 365.0, 731.0, 3)]
ALIGNED = f"""{ORDERS},
a AS (SELECT o_custkey, us AS anchor_us, o_orderkey AS anchor_key FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY us, o_orderkey) AS k FROM o WHERE o_orderstatus = 'F') WHERE k = 1),
c AS (SELECT o_custkey, min(us) AS change_us FROM (SELECT o.o_custkey, o.us FROM o JOIN a USING (o_custkey) WHERE o.us > a.anchor_us AND o_orderpriority = '1-URGENT') GROUP BY o_custkey),
d AS (SELECT o.o_custkey, o.o_orderkey, o.us, o_totalprice, o_orderpriority, (o.us - anchor_us - 3600000000) / {DAY}.0 AS first_day, (o.us - anchor_us + 3600000000) / {DAY}.0 AS last_day, change_us FROM o JOIN a USING (o_custkey) LEFT JOIN c USING (o_custkey) WHERE o.o_orderkey <> anchor_key),
p AS (SELECT *, CASE WHEN last_day < 0 AND first_day >= -365 AND last_day <= 0 THEN 'baseline' WHEN first_day >= 0 AND last_day <= 730 THEN 'followup' WHEN first_day < 0 AND last_day >= 0 THEN 'treatment-time-overlap' ELSE 'outside-analysis-window' END AS period FROM d),
x AS (SELECT *, concat_ws(',', CASE WHEN o_totalprice < 20000 THEN 'metric-withheld' END, CASE WHEN period IN ('treatment-time-overlap', 'outside-analysis-window') THEN period END,
  CASE WHEN period <> 'baseline' AND us + 3600000000 >= change_us THEN 'concurrent-treatment-change' END) AS reasons FROM p),
ok AS (SELECT * FROM x WHERE reasons = ''),
e AS (SELECT o_custkey, us, count(*) AS n, quantile_cont(o_totalprice, 0.5) AS m FROM ok WHERE period = 'baseline' GROUP BY o_custkey, us),
b AS (SELECT o_custkey, CAST(sum(n) AS BIGINT) AS baseline_n, count(*) AS baseline_encounters, quantile_cont(m, 0.5) AS m FROM e GROUP BY o_custkey)"""


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders around each customer's first finished one, an hour of clock uncertainty either way; urgent orders are changes after which nothing is compared."""
    o = orders(spark, sf_dir)
    anchors = o.filter("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.min(F.struct("us", "o_orderkey")).alias("a")).select(
        "o_custkey", F.col("a.us").alias("anchor_us"), F.col("a.o_orderkey").alias("anchor_key")
    )
    with_anchor = o.join(anchors, "o_custkey")
    urgent = with_anchor.filter((F.col("us") > F.col("anchor_us")) & (F.col("o_orderpriority") == "1-URGENT"))
    changes = history.first_change(urgent, ["o_custkey"], "us")
    first, last = history.day_bounds(F.col("us"), F.col("us"), F.lit(3_600_000_000), F.col("anchor_us"), F.col("anchor_us"))
    placed = with_anchor.filter("o_orderkey <> anchor_key").join(changes, "o_custkey", "left").withColumns({"first_day": first, "last_day": last})
    placed = placed.withColumn("period", history.period(F.col("first_day"), F.col("last_day"), -365, 0, 730))
    late = (F.col("period") != "baseline") & (F.col("us") + 3_600_000_000 >= F.col("first_change"))
    listed = S.reasons([
        (F.col("o_totalprice") < 20000, "metric-withheld"), (F.col("period") == "treatment-time-overlap", "treatment-time-overlap"),
        (F.col("period") == "outside-analysis-window", "outside-analysis-window"), (late, "concurrent-treatment-change")
    ])
    return placed.withColumn("reasons", listed)


def baselines(points: DataFrame) -> DataFrame:
    return history.baseline(points.filter("period = 'baseline'"), ["o_custkey"], "us", "o_totalprice", 2, 2)


@query("alignment_exclusions", f"WITH {ALIGNED} SELECT o_custkey, o_orderkey, period, reasons FROM x WHERE reasons <> ''")
def alignment_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(spark, sf_dir).filter(F.size("reasons") > 0).select("o_custkey", "o_orderkey", "period", F.array_join(S.in_listed_order("reasons", history.EXCLUSION_REASONS), ",").alias("reasons"))


@query(
    "alignment_baselines",
    f"""WITH {ALIGNED} SELECT o_custkey, baseline_n, baseline_encounters, CASE WHEN baseline_n < 2 THEN 'insufficient-baseline-observations' WHEN baseline_encounters < 2 THEN 'insufficient-baseline-encounters' END AS baseline_reason,
CASE WHEN baseline_n >= 2 AND baseline_encounters >= 2 THEN round(m, 4) END AS baseline_value FROM b""",
)
def alignment_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baselines(aligned(spark, sf_dir).filter(F.size("reasons") == 0)).withColumn("baseline_value", F.round("baseline_value", 4))


@query(
    "alignment_points",
    f"""WITH {ALIGNED} SELECT ok.o_custkey, o_orderkey, period, round(first_day, 6) AS first_day, round(last_day, 6) AS last_day, round(o_totalprice, 4) AS value,
CASE WHEN baseline_n >= 2 AND baseline_encounters >= 2 THEN round(o_totalprice - m, 4) END AS delta FROM ok LEFT JOIN b USING (o_custkey)""",
)
def alignment_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = aligned(spark, sf_dir).filter(F.size("reasons") == 0)
    joined = points.join(baselines(points), "o_custkey", "left")
    r = lambda c, n: F.round(c, n)
    return joined.select(
        "o_custkey", "o_orderkey", "period", r("first_day", 6).alias("first_day"), r("last_day", 6).alias("last_day"), r("o_totalprice", 4).alias("value"),
        r(F.col("o_totalprice") - F.col("baseline_value"), 4).alias("delta")
    )


_PHASES_SQL = ", ".join(f"('{p}', {a}, {b}, {n})" for p, a, b, n in PHASES)


@query(
    "phase_coverage",
    f"""WITH {ALIGNED}, ph AS (SELECT * FROM (VALUES {_PHASES_SQL}) AS t(phase_id, start_day, end_day, minimum_count)),
h AS (SELECT o_custkey, phase_id, count(DISTINCT us) AS n FROM ok JOIN ph ON first_day >= start_day AND last_day < end_day WHERE period = 'followup' GROUP BY o_custkey, phase_id)
SELECT a.o_custkey, phase_id, coalesce(n, 0) AS encounters, CASE WHEN coalesce(n, 0) = 0 THEN 'missing' WHEN n < minimum_count THEN 'sparse' ELSE 'sufficient' END AS status FROM a CROSS JOIN ph LEFT JOIN h USING (o_custkey, phase_id)""",
)
def phase_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    phases = spark.createDataFrame(PHASES, "phase_id string, start_day double, end_day double, minimum_count int")
    points = aligned(spark, sf_dir).filter((F.size("reasons") == 0) & (F.col("period") == "followup"))
    rows = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select("o_custkey").distinct()
    return history.phase_coverage(points, rows, phases, ["o_custkey"], "us", "first_day", "last_day").drop("minimum_count")


@query(
    "alignment_status",
    f"""WITH {ALIGNED}, n AS (SELECT o_custkey, count(*) AS points, sum((period = 'followup')::INT) AS followups FROM ok GROUP BY o_custkey)
SELECT a.o_custkey, CAST(coalesce(points, 0) AS BIGINT) AS points, CASE WHEN coalesce(points, 0) = 0 THEN 'no-comparable-data' WHEN baseline_n IS NULL OR baseline_n < 2 OR baseline_encounters < 2 THEN 'insufficient-baseline'
  WHEN followups > 0 THEN 'observed' ELSE 'insufficient-followup' END AS status FROM a LEFT JOIN n USING (o_custkey) LEFT JOIN b USING (o_custkey)""",
)
def alignment_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = aligned(spark, sf_dir).filter(F.size("reasons") == 0)
    counted = points.groupBy("o_custkey").agg(F.count("*").alias("points"), F.sum((F.col("period") == "followup").cast("long")).alias("followups"))
    rows = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select("o_custkey").distinct()
    joined = rows.join(counted, "o_custkey", "left").join(baselines(points), "o_custkey", "left").fillna(0, ["points", "followups"])
    return joined.select("o_custkey", "points", history.row_status(F.col("points"), F.col("baseline_value"), F.col("followups")).alias("status"))


@query(
    "previous_order_comparison",
    f"""WITH {ORDERS}, w AS (SELECT *, lag(o_totalprice) OVER v AS pp, lag(o_orderstatus) OVER v AS ps, lag(o_orderpriority) OVER v AS pr, lag(us) OVER v AS pu FROM o WINDOW v AS (PARTITION BY o_custkey ORDER BY us, o_orderkey)),
r AS (SELECT *, concat_ws(',', CASE WHEN o_orderpriority IS DISTINCT FROM pr THEN 'priority-mismatch' END, CASE WHEN pu >= us THEN 'reference-not-before-current' END) AS reasons FROM w WHERE pu IS NOT NULL),
s AS (SELECT *, CASE WHEN reasons <> '' THEN 'incompatible' WHEN ps = 'O' OR o_orderstatus = 'O' THEN 'withheld' ELSE 'measured' END AS status FROM r)
SELECT o_custkey, o_orderkey, status, reasons, CASE WHEN status = 'measured' THEN round(o_totalprice - pp, 4) END AS delta, CASE WHEN status = 'measured' THEN round(pp, 4) END AS reference_value FROM s""",
)
def previous_order_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = orders(spark, sf_dir).withColumn("state", F.when(F.col("o_orderstatus") == "O", "withheld").otherwise("measured"))
    pairs = compare.with_previous(o, ["o_custkey"], ["us", "o_orderkey"], ["o_totalprice", "state", "o_orderpriority", "us"]).filter("prev_us is not null")
    reasons = S.reasons([*compare.mismatch_reasons([("o_orderpriority", "priority-mismatch")]), (F.col("prev_us") >= F.col("us"), "reference-not-before-current")])
    status, delta, listed = compare.comparison(reasons, F.col("prev_state"), F.col("state"), F.col("prev_o_totalprice"), F.col("o_totalprice"))
    return pairs.select(
        "o_custkey", "o_orderkey", status.alias("status"), F.array_join(listed, ",").alias("reasons"), F.round(delta, 4).alias("delta"),
        F.round(compare.redacted(["prev_o_totalprice"], status)["prev_o_totalprice"], 4).alias("reference_value")
    )


@query(
    "idempotent_admission",
    """WITH l AS (SELECT *, md5(concat_ws('|', l_partkey, l_suppkey, l_returnflag, l_linestatus)) AS h FROM lineitem),
r AS (SELECT *, first_value(h) OVER w AS fh, row_number() OVER w AS turn FROM l WINDOW w AS (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax, h))
SELECT l_orderkey, CAST(sum((turn = 1)::INT) AS BIGINT) AS new_rows, CAST(sum((turn > 1 AND h = fh)::INT) AS BIGINT) AS duplicates, CAST(sum((turn > 1 AND h <> fh)::INT) AS BIGINT) AS conflicts FROM r GROUP BY l_orderkey""",
)
def idempotent_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in ("l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")]))
    batch = table(spark, sf_dir, "lineitem").withColumn("content_hash", content)
    judged = ingest.classify_batch(
        batch, batch.limit(0), ["l_orderkey", "l_linenumber"], "content_hash",
        ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax", "content_hash"]
    )
    count = lambda kind: F.sum((F.col("admission") == kind).cast("long"))
    return judged.groupBy("l_orderkey").agg(count("new").alias("new_rows"), count("duplicate").alias("duplicates"), count("conflict").alias("conflicts"))


@query(
    "conversation_audit",
    """WITH c AS (SELECT *, conv_id || ':' || turn AS event_id FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, event_id) - 1 AS k, row_number() OVER (PARTITION BY conv_id, event_id ORDER BY turn) AS d, lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn, event_id) AS before FROM c),
p AS (SELECT *, concat_ws(',', CASE WHEN turn <> k THEN 'sequence-not-contiguous' END, CASE WHEN d > 1 THEN 'duplicate-event-id' END, CASE WHEN length(text) < before THEN 'timestamp-regressed' END) AS problems FROM r)
SELECT conv_id, turn, problems FROM p WHERE problems <> ''""",
)
def conversation_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as a journal, with text length in place of time."""
    turns = table(spark, sf_dir, "conversations").withColumns({"event_id": F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")), "at": F.length("text")})
    return journal.sequence_audit(turns, "conv_id", "turn", "event_id", "at", first=0).filter(F.size("problems") > 0).select("conv_id", "turn", F.array_join("problems", ",").alias("problems"))


@query(
    "conversation_replay",
    """SELECT conv_id, count(*) AS event_count, max(turn) AS last_sequence, max_by(role, turn) AS stage, count(DISTINCT role) AS roles, coalesce(string_agg(DISTINCT role, ',' ORDER BY role), '') AS role_list FROM conversations GROUP BY conv_id""",
)
def conversation_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.col("role").alias("stage"), F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("event_id"),
        F.lit("measurement.recorded").alias("kind"), F.col("role").alias("metric"), F.lit(None).cast("string").alias("observation"),
        F.lit(None).cast("string").alias("report")
    )
    state = journal.replay(turns, "conv_id", "turn", "stage", "event_id", "kind", "metric", "observation", "report")
    return state.select("conv_id", "event_count", "last_sequence", "stage", F.size("recorded_metric_codes").cast("long").alias("roles"), F.array_join("recorded_metric_codes", ",").alias("role_list"))
