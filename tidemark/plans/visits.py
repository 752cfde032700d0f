"""Queries over orders and lineitem as visits: comparison with the visit before, cards, and the audits of both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import visits
from ..sources.scratch import materialize
from .catalog import query, table
from .observations import _LISTED

CODES = ["m1", "m2", "m3", "m4"]
PROFILE = [("m1", 1, "First", "primary"), ("m3", 2, "Third", "primary"), ("m2", 3, "Second", "experimental")]
KEYS = ["reference_id", "current_id"]


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumn("us", F.unix_micros(F.col("o_orderdate").cast("timestamp")))


def visit_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = lambda n, a, b: F.when(F.col("o_orderkey") % n == 0, a).otherwise(b)
    return orders(spark, sf_dir).select(
        F.col("o_orderkey").alias("observation_id"), F.col("o_custkey").alias("subject"), (F.col("o_custkey") + odd(101, 1, 0)).alias("observed_subject"), odd(103, "q", "p").alias("profile_id"), odd(47, "v2", "v1").alias("profile_version"), odd(53, "x", "y").alias("profile_digest"), odd(59, "left", "right").alias("side"),
        F.lit("pack").alias("protocol_id"), F.lit("pack").alias("observed_protocol_id"), odd(61, "2", "1").alias("protocol_version"), odd(67, "2", "1").alias("observed_protocol_version"), F.lit("d").alias("protocol_digest"), odd(69, "e", "d").alias("observed_protocol_digest"),
        odd(71, "b", "a").alias("adapter_id"), odd(73, "2", "1").alias("adapter_version"), F.col("us").alias("started_at"), (F.col("us") + 300_000_000).alias("ended_at"), (F.col("us") + odd(79, 400 * 86_400_000_000, 400_000_000)).alias("accepted_at"),
    )


def pair_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("us", "o_orderkey")
    return orders(spark, sf_dir).select(F.lag("o_orderkey").over(w).alias("reference_id"), F.col("o_orderkey").alias("current_id")).filter("reference_id is not null")


def outcome_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.max(F.struct("l_extendedprice", "l_discount", "l_tax", "l_quantity", "l_partkey")).alias("l")
    one = table(spark, sf_dir, "lineitem").filter("l_linenumber <= 4").groupBy("l_orderkey", "l_linenumber").agg(line).select("l_orderkey", "l_linenumber", "l.*")
    p, n, held = F.col("l_partkey"), F.col("l_linenumber"), F.col("l_discount") <= 0.02
    voice = n == 3
    return one.select(
        F.col("l_orderkey").alias("observation_id"), F.concat(F.lit("m"), n.cast("string")).alias("metric_code"), F.when(p % 97 == 0, "c2").otherwise("c").alias("context"), F.when(voice, "voice").otherwise("face").alias("modality"), F.when(p % 67 == 0, "v").otherwise("u").alias("unit"),
        F.when(p % 71 == 0, "2").otherwise("1").alias("algorithm_version"), F.when(voice != (p % 29 == 0), "p2").otherwise("p1").alias("processor_ref"), F.when(held, "withheld").otherwise("measured").alias("status"),
        F.when(~held, F.when(p % 31 == 0, float("inf")).otherwise(F.col("l_extendedprice"))).alias("value"), F.when(~held, F.col("l_tax") * 10).alias("quality"),
    )


def processor_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p1 of every order, twice for some; p2 of most."""
    refs = F.array_compact(F.array(F.lit("p1"), F.when(F.col("o_orderkey") % 37 == 0, "p1"), F.when(F.col("o_orderkey") % 5 != 0, "p2")))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey"), F.explode(refs).alias("processor_ref"))
    return o.select(
        F.col("o_orderkey").alias("observation_id"), "processor_ref", F.when(F.col("processor_ref") == "p1", "face").otherwise("voice").alias("modality"), F.when(F.col("o_orderkey") % 41 == 0, "wasm").otherwise("js").alias("runtime"), F.when(F.col("o_orderkey") % 43 == 0, "2").otherwise("1").alias("runtime_version"),
        F.when(F.col("o_orderkey") % 83 != 0, "/asset").alias("asset_path"), F.when(F.col("o_orderkey") % 89 == 0, "b").otherwise("a").alias("asset_sha256"), (F.col("o_orderkey") % 91 != 0).alias("integrity_verified"),
    )


def definition_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, "c", "voice" if c == "m3" else "face", "u", "1") for c in CODES], "metric_code string, context string, modality string, unit string, algorithm_version string")


def profile_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROFILE, "metric_code string, place int, label string, role string")


def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visits.compare(pair_table(spark, sf_dir), visit_table(spark, sf_dir), outcome_table(spark, sf_dir), processor_table(spark, sf_dir), definition_table(spark), CODES)


def _unlike(n: int) -> str:
    return f"(rk % {n} = 0) <> (ck % {n} = 0)"


_PAIRED = lambda a, b: f"(rk % {a} = 0) <> (rk % {b} = 0) OR (ck % {a} = 0) <> (ck % {b} = 0) OR {_unlike(a)}"
VISITS_SQL = f"""pr AS (SELECT * FROM (SELECT lag(o_orderkey) OVER w AS rk, o_orderkey AS ck, lag(epoch_us(o_orderdate)) OVER w AS ru, epoch_us(o_orderdate) AS cu FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) WHERE rk IS NOT NULL),
oc AS (SELECT l_orderkey AS k, l_linenumber AS n, l.e % 97 = 0 AS ctx, l.e % 67 = 0 AS unit, l.e % 71 = 0 AS alg, (l_linenumber = 3) <> (l.e % 29 = 0) AS p2, l_linenumber = 3 AS voice, l.b <= 0.02 AS held, CASE WHEN l.e % 31 = 0 THEN 'inf'::DOUBLE ELSE l.a END AS v, l.c * 10 AS q
  FROM (SELECT l_orderkey, l_linenumber, max(struct_pack(a := l_extendedprice, b := l_discount, c := l_tax, d := l_quantity, e := l_partkey)) AS l FROM lineitem WHERE l_linenumber <= 4 GROUP BY ALL)),
os AS (SELECT *, CASE WHEN p2 THEN CASE WHEN k % 5 <> 0 THEN 1 ELSE 0 END ELSE CASE WHEN k % 37 = 0 THEN 2 ELSE 1 END END AS found FROM oc),
ev AS (SELECT pr.*, unnest([1, 2, 3, 4]) AS n FROM pr),
jo AS (SELECT ev.rk, ev.ck, ev.ru, ev.cu, ev.n, r.k IS NOT NULL AND c.k IS NOT NULL AS two, r.k IS NOT NULL AS hasr, c.k IS NOT NULL AS hasc, r.ctx AS rctx, c.ctx AS cctx, r.unit AS runit, c.unit AS cunit, r.alg AS ralg, c.alg AS calg, r.p2 AS rp2, c.p2 AS cp2, r.found AS rf, c.found AS cf, r.held AS rh, c.held AS chd,
  CASE WHEN NOT r.held THEN r.v END AS rv, CASE WHEN NOT c.held THEN c.v END AS cv, CASE WHEN NOT r.held THEN r.q END AS rq, CASE WHEN NOT c.held THEN c.q END AS cq FROM ev LEFT JOIN os r ON r.k = ev.rk AND r.n = ev.n LEFT JOIN os c ON c.k = ev.ck AND c.n = ev.n),
ji AS (SELECT *, two AND rf = 1 AND cf = 1 AS known, (hasr AND rf = 1 AND rp2 <> (n = 3)) OR (hasc AND cf = 1 AND cp2 <> (n = 3)) AS wrong_lane FROM jo),
jr AS (SELECT *, {_LISTED(
    ('rk % 101 = 0 OR ck % 101 = 0', 'subject-mismatch'), (_unlike(103), 'profile-id-mismatch'), (_unlike(47), 'profile-version-mismatch'), (_unlike(53), 'profile-digest-mismatch'), (_unlike(59), 'asserted-side-mismatch'), (_PAIRED(61, 67), 'protocol-version-mismatch'), ('rk % 69 = 0 OR ck % 69 = 0', 'protocol-digest-mismatch'),
    ('NOT two', 'metric-missing'), ('two AND (rctx OR cctx OR runit OR cunit OR ralg OR calg)', 'metric-definition-mismatch'), ('wrong_lane', 'modality-mismatch'), ('two AND rctx <> cctx', 'context-mismatch'), ('two AND runit <> cunit', 'unit-mismatch'), ('two AND ralg <> calg', 'algorithm-version-mismatch'),
    ('known AND rp2 <> cp2', 'processor-ref-mismatch'), ('(hasr AND rf = 0) OR (hasc AND cf = 0)', 'processor-provenance-missing'), ('(hasr AND rf > 1) OR (hasc AND cf > 1)', 'processor-provenance-ambiguous'), (f'known AND ({_unlike(41)})', 'processor-runtime-mismatch'), (f'known AND ({_unlike(43)})', 'processor-runtime-version-mismatch'),
    (f'known AND ({_unlike(83)})', 'processor-asset-path-mismatch'), (f'known AND ({_unlike(89)})', 'processor-asset-digest-mismatch'), ('known AND (rk % 91 = 0 OR ck % 91 = 0 OR rk % 83 = 0 OR ck % 83 = 0)', 'processor-asset-integrity-mismatch'), (_unlike(71), 'capture-adapter-id-mismatch'), (_unlike(73), 'capture-adapter-version-mismatch'),
    ('ru + 300000000 >= cu OR ru + CASE WHEN rk % 79 = 0 THEN 34560000000000 ELSE 400000000 END >= cu', 'reference-not-before-current'))} AS listed FROM ji),
jw AS (SELECT *, {_LISTED(('rh', 'reference-withheld'), ('chd', 'current-withheld'))} AS held FROM jr), js AS (SELECT *, listed = '' AND held = '' AND NOT isfinite(cv - rv) AS wild FROM jw),
cm AS (SELECT rk AS reference_id, ck AS current_id, n - 1 AS position, 'm' || n AS metric_code, CASE WHEN listed <> '' OR wild THEN 'incompatible' WHEN held <> '' THEN 'withheld' ELSE 'measured' END AS status, CASE WHEN listed <> '' THEN listed WHEN wild THEN 'non-finite-delta' ELSE held END AS reasons,
  CASE WHEN NOT hasr AND NOT hasc THEN NULL WHEN two AND runit = cunit THEN CASE WHEN runit THEN 'v' ELSE 'u' END END AS native_unit, cv - rv AS delta, rv, cv, rq, cq FROM js)"""


@query(
    "visit_comparison",
    f"WITH {VISITS_SQL} SELECT reference_id, current_id, CAST(position AS INT) AS position, metric_code, status, reasons, native_unit, CASE WHEN status = 'measured' THEN round(delta, 4) END AS delta, CASE WHEN status = 'measured' THEN rv END AS reference_value, CASE WHEN status = 'measured' THEN cv END AS current_value FROM cm"
)
def visit_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(spark, sf_dir).select(
        *KEYS, "position", "metric_code", "status", F.array_join("reasons", ",").alias("reasons"), "native_unit", F.round("delta", 4).alias("delta"),
        "reference_value", "current_value"
    )


@query(
    "visit_summaries",
    f"""WITH {VISITS_SQL} SELECT reference_id, current_id, {", ".join(f"CAST(sum((status = '{s}')::INT) AS BIGINT) AS {s}" for s in ("measured", "withheld", "incompatible"))}, round(min(rq) FILTER (WHERE status = 'measured'), 6) AS reference_least_quality, round(min(cq) FILTER (WHERE status = 'measured'), 6) AS current_least_quality FROM cm GROUP BY ALL""",
)
def visit_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = visits.summary(compared(spark, sf_dir), KEYS)
    return s.withColumns({c: F.round(c, 6) for c in ("reference_least_quality", "current_least_quality")})


@query(
    "visit_cards",
    f"WITH {VISITS_SQL} SELECT reference_id, current_id, CASE metric_code WHEN 'm1' THEN 1 WHEN 'm3' THEN 2 ELSE 3 END AS place, CASE metric_code WHEN 'm1' THEN 'First' WHEN 'm3' THEN 'Third' ELSE 'Second' END AS label, metric_code, status FROM cm WHERE metric_code <> 'm4'"
)
def visit_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visits.card_rows(compared(spark, sf_dir), profile_table(spark), KEYS).select(*KEYS, "place", "label", "metric_code", "status")


@query(
    "visit_row_audit",
    f"""WITH {VISITS_SQL}, k AS (SELECT *, current_id % 7 = 0 AS shifted, current_id % 11 = 0 AS unreasoned, current_id % 13 = 0 AND metric_code = 'm4' AS dropped FROM cm)
SELECT reference_id, current_id, metric_code, CASE WHEN dropped THEN 'row-missing' ELSE {_LISTED(("status = 'measured' AND shifted", 'delta-mismatch'), ("status <> 'measured' AND unreasoned", 'excluded-without-reason'), ("status = 'withheld' AND unreasoned", 'withheld-without-withheld-source'), ("unreasoned AND reasons <> ''", 'compatibility-not-recomputed'))} END AS violations FROM k""",
)
def visit_row_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparison rows of which some have another delta, some no reasons, and some are missing, against those recomputed."""
    rows = materialize(compared(spark, sf_dir))
    claimed = rows.filter(~((F.col("current_id") % 13 == 0) & (F.col("metric_code") == "m4"))).withColumns({
        "delta": F.when(F.col("current_id") % 7 == 0, F.col("delta") + 1).otherwise(F.col("delta")), "reasons": F.when(
            F.col("current_id") % 11 == 0, F.array().cast("array<string>")
        ).otherwise(F.col("reasons")),
    })
    found = visits.recomputed_violations(claimed, rows, [*KEYS, "metric_code"])
    return found.select(*KEYS, "metric_code", F.array_join("violations", ",").alias("violations"))


@query(
    "visit_card_audit",
    f"""WITH {VISITS_SQL}, g AS (SELECT reference_id, current_id, bool_or(status <> 'measured') AS any_excluded, bool_or(status = 'measured') AS any_measured FROM cm WHERE metric_code <> 'm4' GROUP BY ALL)
SELECT reference_id, current_id, {_LISTED(('current_id % 5 = 0', 'generated-before-comparison'), ('current_id % 7 = 0', 'profile-order'), ('current_id % 11 = 0 AND any_measured', 'row-altered'), ('current_id % 13 = 0', 'summary-not-derived'), ('current_id % 3 = 0 AND current_id % 2 = 0', 'reviewed-before-generation'))} AS violations FROM g""",
)
def visit_card_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards with planted faults: times, places, deltas, counts, reviews."""
    rows, profile, k = materialize(compared(spark, sf_dir)), profile_table(spark), F.col("current_id")
    own = visits.card_rows(rows, profile, KEYS)
    claimed = own.withColumns({"place": F.when(k % 7 == 0, F.col("place") % 3 + 1).otherwise(F.col("place")), "delta": F.when(k % 11 == 0, F.col("delta") + 1).otherwise(F.col("delta"))})
    sums = visits.summary(own, KEYS).withColumn("measured", F.col("measured") + F.when(k % 13 == 0, 1).otherwise(0))
    cards = sums.withColumns({
        "compared_at": F.lit(100), "generated_at": F.when(k % 5 == 0, 99).otherwise(100),
        "review_status": F.when(k % 2 == 0, "acknowledged").otherwise("pending"), "reviewed_at": F.when(k % 3 == 0, 50).otherwise(200)
    })
    found = visits.card_violations(cards, claimed, rows, profile, KEYS)
    return found.select(*KEYS, F.array_join("violations", ",").alias("violations"))


@query(
    "reference_rules",
    """WITH h AS (SELECT l_orderkey AS k, list_sort(list(DISTINCT 'm' || l_linenumber)) AS held FROM lineitem WHERE l_linenumber <= 4 GROUP BY ALL)
SELECT o_orderkey AS reference_id, concat_ws(',', CASE WHEN o_orderkey % 101 = 0 THEN 'subject-mismatch' END, CASE WHEN (o_orderkey % 61 = 0) <> (o_orderkey % 67 = 0) THEN 'protocol-mismatch' END, CASE WHEN o_orderkey % 77 = 0 THEN 'accepted-before-completion' END,
  CASE WHEN NOT list_contains(coalesce(held, []), 'm1') THEN 'missing:m1' END, CASE WHEN NOT list_contains(coalesce(held, []), 'm2') THEN 'missing:m2' END, CASE WHEN NOT list_contains(coalesce(held, []), 'm3') THEN 'missing:m3' END, CASE WHEN NOT list_contains(coalesce(held, []), 'm4') THEN 'missing:m4' END) AS violations FROM orders LEFT JOIN h ON k = o_orderkey""",
)
def reference_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = visit_table(spark, sf_dir)
    references = v.select(
        F.col("observation_id").alias("reference_id"), "subject", "protocol_version",
        F.when(F.col("observation_id") % 77 == 0, F.col("started_at")).otherwise(F.col("ended_at")).alias("accepted_at")
    )
    found = visits.reference_violations(references, v, outcome_table(spark, sf_dir), CODES)
    return found.select("reference_id", F.array_join("violations", ",").alias("violations"))
