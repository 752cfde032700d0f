"""Queries over orders and customers: corrections, access to snapshots, evidence status, reviews, contexts, rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import governance, ingest, provenance
from .catalog import query, table
from .histories import ORDERS, orders

CUT = "1996-01-01"


@query(
    "correction_admission",
    f"""WITH {ORDERS}, c AS (SELECT o_custkey, max_by(o_orderkey, struct_pack(a := us, b := o_orderkey)) AS cur FROM o WHERE o_orderdate < TIMESTAMP '{CUT}' GROUP BY o_custkey)
SELECT CASE WHEN prev IS NOT DISTINCT FROM cur THEN 'admitted' ELSE 'correction-conflict' END AS correction, count(*) AS n FROM o LEFT JOIN c USING (o_custkey) WHERE o_orderdate >= TIMESTAMP '{CUT}' GROUP BY ALL""",
)
def correction_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later orders as corrections of the customer's last order before the cut."""
    o = orders(spark, sf_dir)
    cut = F.unix_micros(F.lit(CUT).cast("timestamp"))
    current = o.filter(F.col("us") < cut).groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("us", "o_orderkey")).alias("record_id"))
    return ingest.correction_admission(o.filter(F.col("us") >= cut), current, ["o_custkey"], "prev", "record_id").groupBy("correction").agg(F.count("*").alias("n"))


@query(
    "correction_chain_reasons",
    f"""WITH {ORDERS}, c AS (SELECT o_custkey, max_by(o_orderkey, struct_pack(a := us, b := o_orderkey)) AS cur, max(us) AS cus, max_by(o_orderstatus, struct_pack(a := us, b := o_orderkey)) AS cst FROM o WHERE o_orderdate < TIMESTAMP '{CUT}' GROUP BY o_custkey),
r AS (SELECT concat_ws(',', CASE WHEN cur IS NULL AND prev IS NOT NULL THEN 'correction-parent-missing' END, CASE WHEN cur <> o_orderkey AND prev IS DISTINCT FROM cur THEN 'correction-chain' END, CASE WHEN cur <> o_orderkey AND us < cus THEN 'correction-chronology' END, CASE WHEN cur IS NOT NULL AND o_orderstatus <> cst THEN 'record-class-change' END) AS reasons FROM o LEFT JOIN c USING (o_custkey))
SELECT reasons, count(*) AS n FROM r GROUP BY reasons""",
)
def correction_chain_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = orders(spark, sf_dir)
    last = F.struct("us", "o_orderkey")
    current = o.filter(F.col("us") < F.unix_micros(F.lit(CUT).cast("timestamp"))).groupBy("o_custkey").agg(
        F.max_by("o_orderkey", last).alias("current_revision"), F.max("us").alias("current_recorded"), F.max_by("o_orderstatus", last).alias("current_class")
    )
    reasons = ingest.correction_chain_reasons(F.col("prev"), F.col("o_orderkey"), F.col("us"), F.col("o_orderstatus"))
    return o.join(current, "o_custkey", "left").groupBy(F.array_join(reasons, ",").alias("reasons")).agg(F.count("*").alias("n"))


@query(
    "accessible_snapshots",
    "WITH s AS (SELECT o_orderkey, o_totalprice > 5000 AS permitted FROM orders WHERE o_orderkey % 50 <> 0) SELECT o_custkey AS snapshot_id, bool_and(coalesce(permitted, false)) AS accessible FROM orders LEFT JOIN s USING (o_orderkey) GROUP BY o_custkey",
)
def accessible_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    sources = o.filter("o_orderkey % 50 <> 0").select(F.col("o_orderkey").alias("revision_id"), (F.col("o_totalprice") > 5000).alias("permitted"))
    return governance.accessible_snapshots(o.select(F.col("o_custkey").alias("snapshot_id"), F.col("o_orderkey").alias("revision_id")), sources)


@query(
    "evidence_status",
    """WITH e AS (SELECT c_custkey, c_custkey % 4 AS revision, c_custkey % 3 <> 0 AS captured, c_custkey % 5 <> 0 AS consented FROM customer), s AS (SELECT o_custkey, o_orderkey % 4 AS revision, max(o_orderkey) AS snapshot_id FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL),
j AS (SELECT o_custkey, o_orderkey % 4 AS revision, max_by(o_orderstatus, o_orderkey) AS st FROM orders GROUP BY ALL), r AS (SELECT o_custkey, count(DISTINCT l_orderkey * 10 + l_linenumber) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' AND l_returnflag = 'A' GROUP BY o_custkey),
x AS (SELECT e.*, CASE WHEN s.o_custkey IS NOT NULL THEN 'ready' WHEN j.st = 'P' THEN 'failed' WHEN j.st IS NOT NULL THEN 'pending' ELSE 'empty' END AS st, snapshot_id, coalesce(n, 0) AS n, captured AND NOT consented AS refused
  FROM e LEFT JOIN s ON s.o_custkey = c_custkey AND s.revision = e.revision LEFT JOIN j ON j.o_custkey = c_custkey AND j.revision = e.revision LEFT JOIN r ON r.o_custkey = c_custkey)
SELECT c_custkey AS episode_id, CASE WHEN NOT refused THEN st END AS status, CASE WHEN NOT refused THEN snapshot_id END AS snapshot_id, CASE WHEN refused THEN 'analysis-consent-inactive' END AS refusal, CASE WHEN NOT refused THEN n END AS reviews FROM x""",
)
def evidence_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as episodes, some with captured data and without consent; orders as snapshots and jobs, lines as reviews."""
    o = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("episode_id"), (F.col("o_orderkey") % 4).alias("input_revision"), (F.col("o_orderstatus") == "F").alias("accessible"), F.col("o_orderkey").alias("snapshot_id"),
        F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderstatus") == "P", "failed").otherwise("running").alias("job_status")
    )
    k = F.col("c_custkey")
    episodes = table(spark, sf_dir, "customer").select(k.alias("episode_id"), (k % 4).alias("revision"), (k % 3 != 0).alias("has_capture"), (k % 5 != 0).alias("consented"))
    reviews = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("snapshot_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("review_id"))
    found = governance.evidence_status(episodes, o, o, reviews)
    return found.select("episode_id", "status", "snapshot_id", "refusal", F.when(F.col("visible_reviews").isNotNull(), F.size("visible_reviews").cast("long")).alias("reviews"))


@query(
    "latest_reviews",
    """WITH r AS (SELECT l_orderkey, l_shipdate, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'R' THEN 'acknowledged' WHEN l_returnflag = 'A' THEN 'disputed' ELSE 'noted' END AS d FROM lineitem WHERE l_linenumber % 3 = o_digest(l_orderkey)),
x AS (SELECT l_orderkey, max_by(d, struct_pack(a := l_shipdate, b := l_linenumber * 10000000 + l_partkey)) AS d FROM r GROUP BY l_orderkey)
SELECT CASE WHEN o_orderkey % 31 = 0 THEN 'superseded' WHEN d = 'acknowledged' THEN 'reviewed' ELSE coalesce(d, 'generated') END AS status, count(*) AS n FROM orders LEFT JOIN x ON l_orderkey = o_orderkey GROUP BY ALL""".replace("o_digest(l_orderkey)", "l_orderkey % 3"),
)
def latest_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs, lines as reviews; a line belongs to the run's exact content where its number modulo 3 is the run's."""
    runs = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("run_id"), (F.col("o_orderkey") % 3).alias("digest"),
        F.when(F.col("o_orderkey") % 31 == 0, F.col("o_orderkey") + 1).alias("superseded_by")
    )
    disposition = F.when(F.col("l_returnflag") == "R", "acknowledged").when(F.col("l_returnflag") == "A", "disputed").otherwise("noted")
    reviews = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), (F.col("l_linenumber") % 3).cast("long").alias("digest"), disposition.alias("disposition"),
        F.col("l_shipdate").alias("recorded_at"), (F.col("l_linenumber") * F.lit(10_000_000).cast("long") + F.col("l_partkey")).alias("review_id")
    )
    return governance.latest_review(runs, reviews).groupBy("status").agg(F.count("*").alias("n"))


@query(
    "capture_contexts",
    """WITH c AS (SELECT c_custkey % 40 AS scope, c_custkey, c_custkey % 700 AS granted, c_custkey % 3 = 0 AS capture, CASE WHEN c_custkey % 5 = 0 THEN 400 END AS withdrawn FROM customer), p AS (SELECT scope, min_by(c_custkey, struct_pack(a := -granted, b := c_custkey)) AS consent_id FROM c WHERE capture AND granted <= 500 AND (withdrawn IS NULL OR withdrawn > 500) GROUP BY scope),
b AS (SELECT o_custkey % 50 AS scope, o_orderkey % 6 AS encounter_id, min(o_orderkey) AS binding_id FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 7 <> 0 GROUP BY ALL) SELECT scope, encounter_id, binding_id, consent_id FROM b JOIN p USING (scope)""",
)
def capture_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, t = F.col("c_custkey"), F.lit(True)
    consents = table(spark, sf_dir, "customer").select(
        (k % 40).alias("scope"), k.alias("consent_id"), (k % 700).alias("granted_at"), (k % 3 == 0).alias("capture"), t.alias("derived_analysis"),
        t.alias("derived_retention"), F.lit(None).cast("long").alias("expires_at"), F.when(k % 5 == 0, 400).alias("withdrawn_at")
    )
    bindings = table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 50).alias("scope"), (F.col("o_orderkey") % 6).alias("encounter_id"), F.col("o_orderkey").alias("binding_id"),
        F.when(F.col("o_orderstatus") == "F", "verified").otherwise("pending").alias("status"), F.when(F.col("o_orderkey") % 7 == 0, 1).alias("revoked_at")
    )
    return governance.capture_context(consents, bindings, ["scope"], F.lit(500))


@query(
    "metric_rules",
    """WITH m AS (SELECT l_returnflag AS f, l_discount AS d, l_tax AS q, l_quantity AS v FROM lineitem), s AS (SELECT *, CASE f WHEN 'R' THEN 'measured' WHEN 'A' THEN 'withheld' ELSE 'other' END AS st, CASE WHEN d > 0.05 THEN v END AS val, d > 0.03 AS reason FROM m)
SELECT concat_ws(',', CASE WHEN st = 'other' THEN 'unknown-status' END, CASE WHEN st = 'measured' AND val IS NULL THEN 'measured-without-value' END, CASE WHEN st = 'measured' AND reason THEN 'measured-with-reason' END, CASE WHEN st = 'withheld' AND val IS NOT NULL THEN 'withheld-with-value' END,
  CASE WHEN st = 'withheld' AND NOT reason THEN 'withheld-without-reason' END, CASE WHEN q * 20 > 1 THEN 'quality-out-of-range' END) AS violations, count(*) AS n FROM s GROUP BY ALL""",
)
def metric_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("l_discount")
    rows = table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_returnflag") == "R", "measured").when(F.col("l_returnflag") == "A", "withheld").otherwise("other").alias("status"), F.when(d > 0.05, F.col("l_quantity")).alias("value"),
        F.when(d > 0.03, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("reason_codes"), (F.col("l_tax") * 20).alias("technical_quality_score"),
    )
    return rows.groupBy(F.array_join(provenance.metric_rules(), ",").alias("violations")).agg(F.count("*").alias("n"))


@query("order_digests", "SELECT o_orderkey % 100 <> 0 AS verified, count(*) AS n FROM orders GROUP BY ALL")
def order_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content digests of orders, verified against themselves with one field changed in every hundredth."""
    fields = {"key": "o_orderkey", "status": "o_orderstatus", "price": "o_totalprice"}
    sealed = table(spark, sf_dir, "orders").withColumn("sealed", S.digest(fields))
    changed = sealed.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 100 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return changed.groupBy(S.digest_verified(fields, "sealed").alias("verified")).agg(F.count("*").alias("n"))
