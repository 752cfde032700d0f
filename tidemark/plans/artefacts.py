"""Queries over orders and lineitem as artefacts whose parts must agree: durable and session observations, measurements, protocol packs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import artefacts, assembly, provenance
from ..sources.scratch import dealt, materialize
from .catalog import query, table
from .observations import _LISTED

_DEAR = "max(struct_pack(a := l_extendedprice, b := l_discount, c := l_tax, d := l_quantity, e := l_partkey))"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line for each order and line number: k, n, price, discount, tax, quantity and part. An order's lines are in one partition, so that steps by order move them no more."""
    line = F.max(F.struct("l_extendedprice", "l_discount", "l_tax", "l_quantity", "l_partkey")).alias("l")
    dealt_out = dealt(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax", "l_quantity", "l_partkey"), "l_orderkey")
    return dealt_out.groupBy("l_orderkey", "l_linenumber").agg(line).select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l.l_extendedprice").alias("price"), F.col("l.l_discount").alias("discount"),
        F.col("l.l_tax").alias("tax"), F.col("l.l_quantity").cast("long").alias("quantity"), F.col("l.l_partkey").alias("part")
    )


LINES = f"li AS (SELECT k, n, l.a AS price, l.b AS discount, l.c AS tax, CAST(l.d AS BIGINT) AS quantity, l.e AS part FROM (SELECT l_orderkey AS k, l_linenumber AS n, {_DEAR} AS l FROM lineitem GROUP BY ALL))"
_text = lambda c: c.cast("string")


@query(
    "durable_rules",
    f"""WITH {LINES}, o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 71 = 0 THEN -5.0 ELSE 10000.0 END AS len, o_orderkey % 73 = 0 AS late, o_orderkey % 79 = 0 AS selfish FROM orders),
w AS (SELECT li.*, len, n * 1000.0 AS s, n * 1000.0 + CASE WHEN part % 37 = 0 THEN 0 WHEN part % 41 = 0 THEN 20000 ELSE quantity * 30.0 END AS e, discount > 0.01 AS eligible, part % 7 = 0 AS unreasoned FROM li JOIN o USING (k)),
bw AS (SELECT k, bool_or(e <= s OR e > len OR (NOT eligible AND unreasoned)) AS bad FROM w GROUP BY k),
m AS (SELECT k, len, n, tax > 0.02 AS measured, quantity * 40.0 AS usable, part % 53 = 0 AS twice, part % 59 = 0 AS gone, discount > 0.01 AS own_ok FROM w),
x AS (SELECT m.*, nx.k IS NOT NULL AS has_next, coalesce(nx.eligible, false) AS next_ok, w.s AS s0, w.e AS e0, nx.s AS s1, nx.e AS e1 FROM m JOIN w USING (k, n) LEFT JOIN w nx ON nx.k = m.k AND nx.n = m.n + 1),
u AS (SELECT *, CASE WHEN own_ok AND e0 >= s0 THEN e0 - s0 ELSE 0 END AS a, CASE WHEN has_next AND next_ok AND e1 >= s1 THEN e1 - s1 ELSE 0 END AS b, CASE WHEN own_ok AND has_next AND next_ok AND e0 >= s0 AND e1 >= s1 THEN greatest(0, least(e0, e1) - s1) ELSE 0 END AS shared FROM x),
g AS (SELECT k, bool_or(twice OR gone OR usable > len OR (measured AND (NOT own_ok OR (has_next AND NOT next_ok)))) AS bad_metric, bool_or(measured AND usable > a + b - shared) AS beyond FROM u GROUP BY k),
sa AS (SELECT *, s0 AS t0, s0 + 1500.0 AS t1, CASE WHEN own_ok THEN CASE WHEN has_next AND next_ok AND s1 <= greatest(s0, e0) THEN greatest(s0, e0, e1) ELSE CASE WHEN has_next AND next_ok THEN greatest(s0, e0) ELSE e0 END END WHEN has_next AND next_ok THEN s0 END AS reach FROM u WHERE n % 2 = 1),
sg AS (SELECT k, bool_or(NOT measured OR coalesce(reach < t1, true)) AS bad_sample FROM sa GROUP BY k)
SELECT o.k AS revision_id, {_LISTED(('len < 0 OR late', 'chronology'), ('bw.bad', 'window-bounds-or-reasons'), ('bad_metric', 'metric-attribution'), ('beyond', 'usable-exceeds-windows'), ('bad_sample', 'sample-coverage'), ('selfish', 'supersedes-itself'))} AS violations FROM o LEFT JOIN bw USING (k) LEFT JOIN g USING (k) LEFT JOIN sg USING (k)""",
)
def durable_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line a window, and a metric that rests on its own and the next one; samples of every other metric."""
    k = F.col("o_orderkey")
    end = F.when(k % 71 == 0, -5.0).otherwise(10_000.0)
    observations = table(spark, sf_dir, "orders").select(
        k.alias("revision_id"), F.when(k % 79 == 0, k).alias("supersedes_revision_id"), F.lit(0.0).alias("started_at_ms"), end.alias("ended_at_ms"),
        F.when(k % 73 == 0, end - 1).otherwise(end).alias("recorded_at_ms")
    )
    li, part = materialize(lines(spark, sf_dir)), F.col("part")
    start = F.col("n") * 1000.0
    length = F.when(part % 37 == 0, 0).when(part % 41 == 0, 20_000).otherwise(F.col("quantity") * 30.0)
    eligible = F.col("discount") > 0.01
    windows = li.select(
        F.col("k").alias("revision_id"), F.concat(F.lit("w"), _text(F.col("n"))).alias("window_id"), start.alias("start_ms"), (start + length).alias("end_ms"),
        F.when(eligible, "eligible").otherwise("withheld").alias("status"),
        F.when(part % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("x"))).alias("reason_codes")
    )
    numbered = li.withColumn("numbers", F.collect_set("n").over(Window.partitionBy("k")))
    name = lambda n: F.concat(F.lit("w"), _text(n))
    ids = F.array_compact(F.array(
        name(F.col("n")), F.when(F.array_contains("numbers", F.col("n") + 1), name(F.col("n") + 1)), F.when(part % 53 == 0, name(F.col("n"))),
        F.when(part % 59 == 0, "lost")
    ))
    metrics = materialize(numbered.select(
        F.col("k").alias("revision_id"), F.concat(F.lit("m"), _text(F.col("n"))).alias("metric_code"),
        F.when(F.col("tax") > 0.02, "measured").otherwise("withheld").alias("status"), (F.col("quantity") * 40.0).alias("usable_ms"), ids.alias("window_ids"),
        start.alias("s"), (F.col("n") % 2 == 1).alias("sampled")
    ))
    plain = F.array_distinct(F.filter("window_ids", lambda x: x != "lost"))
    samples = metrics.filter("sampled").select(
        "revision_id", "metric_code", F.lit("s1").alias("sample_id"), F.col("s").alias("start_ms"), (F.col("s") + 1500.0).alias("end_ms"),
        plain.alias("window_ids")
    )
    found = artefacts.durable_violations(observations, windows, metrics.drop("s", "sampled"), samples)
    return found.select("revision_id", F.array_join("violations", ",").alias("violations"))


_IDENTITY = {"protocol_id": "pack", "protocol_version": "1", "context": "c", "unit": "u", "algorithm_version": "1", "track_segment_id": "t"}
_SQL_ID = lambda session, code, proc: "'aggregate-' || substr(sha256(" + " || '|' || ".join(f"octet_length(encode({x})) || ':' || {x}" for x in (
    "'pack'", "'1'", session, code, "'c'", "'u'", "'1'", proc, "'t'"
)) + "), 1, 24)"


@query(
    "session_rules",
    f"""WITH {LINES}, o AS (SELECT o_orderkey AS k FROM orders), c AS (SELECT k, count(*) AS n, count(*) FILTER (WHERE discount > 0.01) AS ok, bool_or(n * 1000 > 6000) AS beyond, bool_or(part % 83 = 0) AS foreign_w, bool_or(part % 89 = 0) AS odd_o, bool_or(part % 97 = 0 AND n > 1) AS odd_m, bool_or(part % 101 = 0) AS odd_a FROM li GROUP BY k)
SELECT o.k AS observation_id, {_LISTED(('o.k % 43 = 0', 'ends-before-start'), ('o.k % 43 <> 0 AND o.k % 47 = 0', 'duration-mismatch'), ('o.k % 53 = 0', 'consent-session'), ('o.k % 59 = 0', 'consent-after-start'), ('o.k % 61 = 0', 'source-session'), ('o.k % 67 = 0 AND c.n > 0', 'window-counts'), ('beyond OR foreign_w', 'window-outside-session'),
  ('odd_o', 'outcome-identity'), ('odd_a', 'measurement-aggregate-identity'), ('odd_m', 'measurement-identity'))} AS violations FROM o LEFT JOIN c USING (k)""",
)
def session_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, part = F.col("o_orderkey"), F.col("part")
    li = lines(spark, sf_dir)
    counts = li.groupBy("k").agg(F.count("*").alias("all"), F.sum((F.col("discount") > 0.01).cast("long")).alias("ok"))
    start, length = F.lit(100_000.0), F.when(k % 47 == 0, 3000.0).otherwise(6000.0)
    o = table(spark, sf_dir, "orders").join(counts, k == F.col("k"), "left").fillna(0, ["all", "ok"])
    odd = lambda n, a, b: F.when(k % n == 0, a).otherwise(b)
    observations = o.select(
        k.alias("observation_id"), _text(k).alias("session_id"), F.lit("pack").alias("protocol_id"), F.lit("1").alias("protocol_version"), start.alias("started_at_ms"), odd(43, start - 1, start + length).alias("ended_at_ms"), F.lit(6000.0).alias("duration_ms"), odd(53, F.lit("x"), _text(k)).alias("consent_session"),
        odd(59, start + 1, start).alias("consent_recorded_at_ms"), odd(61, F.lit("x"), _text(k)).alias("source_session"), (F.col("all") + F.when((k % 67 == 0) & (F.col("all") > 0), 1).otherwise(0)).alias("total_windows"), F.col("ok").alias("eligible_windows"), (F.col("all") - F.col("ok")).alias("withheld_windows"),
    )
    windows = li.select(
        F.col("k").alias("observation_id"), F.concat(F.lit("w"), _text(F.col("n"))).alias("window_id"),
        F.when(part % 83 == 0, "x").otherwise(_text(F.col("k"))).alias("session_id"), (F.col("n") * 1000.0).alias("end_ms"),
        F.when(F.col("discount") > 0.01, "eligible").otherwise("withheld").alias("status")
    )
    bare = li.select(
        F.col("k").alias("observation_id"), F.col("n").alias("n"), "part", _text(F.col("k")).alias("session_id"),
        F.concat(F.lit("m"), _text(F.col("n"))).alias("metric_code"), F.lit("p").alias("processor_ref"), *[F.lit(v).alias(c) for c, v in _IDENTITY.items()]
    )
    own = artefacts.aggregate_id()
    outcomes = bare.withColumns({"aggregate_id": F.when(part % 89 == 0, F.concat(F.lit("x"), own)).otherwise(own), "outcome_id": F.concat(F.lit("o"), _text(F.col("n")))})
    window = F.concat(F.lit("w"), _text(F.col("n")))
    measurements = bare.withColumns({
        "aggregate_id": F.when(part % 101 == 0, F.concat(F.lit("x"), own)).otherwise(own), "source_window_ids": F.array(window), "ordinal": F.lit(0),
        "measurement_id": F.when((part % 97 == 0) & (F.col("n") > 1), F.concat(F.lit("y"), _text(F.col("n")))).otherwise(artefacts.measurement_id(own, window, F.lit(0))),
    })
    found = artefacts.session_violations(observations, windows, measurements.drop("n", "part"), outcomes.drop("n", "part"))
    return found.select("observation_id", F.array_join("violations", ",").alias("violations"))


@query("aggregate_identities", f"WITH {LINES} SELECT k AS session, n AS line, {_SQL_ID('CAST(k AS VARCHAR)', chr(39) + 'm' + chr(39) + ' || n', chr(39) + 'p' + chr(39))} AS aggregate_id FROM li")
def aggregate_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = lines(spark, sf_dir).select(
        "k", "n", _text(F.col("k")).alias("session_id"), F.concat(F.lit("m"), _text(F.col("n"))).alias("metric_code"), F.lit("p").alias("processor_ref"),
        *[F.lit(v).alias(c) for c, v in _IDENTITY.items()]
    )
    return bare.select(F.col("k").alias("session"), F.col("n").alias("line"), artefacts.aggregate_id().alias("aggregate_id"))


@query(
    "measurement_audit",
    f"""WITH {LINES} SELECT k AS session_id, 'x' || n AS measurement_id, {_LISTED(('part % 31 = 0', 'not-referenced'), ('part % 37 = 0 OR part % 41 = 0 OR discount <= 0.01', 'aggregate-mismatch'), ('part % 43 = 0 OR part % 47 = 0 OR tax <= 0.01', 'source-window-mismatch'))} AS violations FROM li""",
)
def measurement_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, part = materialize(lines(spark, sf_dir)), F.col("part")
    same = lambda **odd: [odd.get(c, F.lit(c)).alias(c) for c in ("label", "modality", "context", "unit", "algorithm_version", "processor_ref", "track_segment_id")]
    number = lambda p: F.concat(F.lit(p), _text(F.col("n")))
    measurements = li.select(
        F.col("k").alias("session_id"), number("x").alias("measurement_id"), number("a").alias("aggregate_id"),
        F.array(F.when(part % 43 == 0, "lost").otherwise(number("w"))).alias("source_window_ids"), number("m").alias("metric_code"), *same()
    )
    outcomes = li.filter("part % 41 <> 0").select(
        F.col("k").alias("session_id"), number("a").alias("aggregate_id"), F.when(F.col("discount") > 0.01, "measured").otherwise("withheld").alias("status"),
        number("m").alias("metric_code"), *same(unit=F.when(part % 37 == 0, "other").otherwise("unit"))
    )
    windows = li.select(
        F.col("k").alias("session_id"), number("w").alias("window_id"), F.when(F.col("tax") > 0.01, "eligible").otherwise("withheld").alias("status"),
        *[x for x in same(context=F.when(part % 47 == 0, "other").otherwise("context"))]
    )
    refs = li.filter("part % 31 <> 0").select(F.col("k").alias("session_id"), number("x").alias("measurement_id"))
    found = artefacts.measurement_violations(measurements, outcomes, windows, refs)
    return found.select("session_id", "measurement_id", F.array_join("violations", ",").alias("violations"))


@query(
    "source_evidence_audit",
    f"""WITH {LINES} SELECT k AS session_id, 'm' || n AS metric_code, {_LISTED(('part % 31 = 0', 'repeated-measurement-ref'), ('part % 37 = 0', 'repeated-source-window'), ('part % 41 = 0', 'source-window-missing'), ('tax <= 0.01', 'source-window-withheld'), ('part % 41 = 0 OR part % 43 = 0', 'source-window-not-in-evidence'), ('part % 41 = 0 OR part % 43 = 0 OR part % 47 = 0', 'windows-not-covered'))} AS violations
FROM li WHERE discount > 0.01""",
)
def source_evidence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, part = lines(spark, sf_dir), F.col("part")
    number = lambda p: F.concat(F.lit(p), _text(F.col("n")))
    extra = lambda n, value: F.when(part % n == 0, value)
    outcomes = li.select(
        F.col("k").alias("session_id"), number("m").alias("metric_code"), F.when(F.col("discount") > 0.01, "measured").otherwise("withheld").alias("status"), F.array_compact(F.array(
            F.when(part % 43 != 0, number("w")), extra(47, F.lit("more"))
        )).alias("window_ids"),
        F.array_compact(F.array(number("x"), extra(31, number("x")))).alias("measurement_ids"),
    )
    measurements = li.select(
        F.col("k").alias("session_id"), number("x").alias("measurement_id"),
        F.array_compact(F.array(number("w"), extra(37, number("w")), extra(41, F.lit("lost")))).alias("source_window_ids")
    )
    windows = li.select(F.col("k").alias("session_id"), number("w").alias("window_id"), F.when(F.col("tax") > 0.01, "eligible").otherwise("withheld").alias("status"))
    found = artefacts.source_evidence_violations(outcomes, measurements, windows)
    return found.select("session_id", "metric_code", F.array_join("violations", ",").alias("violations"))


@query(
    "source_binding_audit",
    """WITH l AS (SELECT l_orderkey AS k, l_linenumber % 5 AS n, l_partkey % 31 = 0 AS odd FROM lineitem WHERE l_linenumber % 5 IN (1, 2)), g AS (SELECT k, n, count(*) AS c, bool_or(odd) AS odd FROM l GROUP BY ALL)
SELECT k AS session_id, 'm' || n AS metric_code, CASE WHEN c > 1 THEN 'several-outcomes' WHEN odd THEN 'evidence-count' ELSE '' END AS violations FROM g""",
)
def source_binding_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("session_id"), F.concat(F.lit("m"), _text(F.col("l_linenumber") % 5)).alias("metric_code"), F.array(F.lit("w1"), F.lit("w2")).alias("window_ids"), F.array(F.lit("x1")).alias("measurement_ids"), F.when(F.col("l_partkey") % 31 == 0, 3).otherwise(2).alias("window_count"), F.lit(1).alias("measurement_count")
    )
    found = artefacts.binding_violations(outcomes, ["m1", "m2"])
    return found.select("session_id", "metric_code", F.array_join("violations", ",").alias("violations"))


@query(
    "pack_rules",
    """WITH l AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey % 3 AS place FROM lineitem), g AS (SELECT k, count(*) AS c, count(DISTINCT n) AS codes, count(DISTINCT place) AS places FROM l GROUP BY k)
SELECT k AS pack_id, concat_ws(',', CASE WHEN c <> codes THEN 'repeated-metric' END, CASE WHEN c <> places THEN 'repeated-report-order' END, CASE WHEN k % 7 = 0 THEN 'digest-mismatch' END) AS violations FROM g""",
)
def pack_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("pack_id"), F.concat(F.lit("m"), _text(F.col("l_linenumber"))).alias("metric_code"), F.lit("pitch").alias("report_section"),
        (F.col("l_partkey") % 3).alias("report_order"), _text(F.col("l_suppkey")).alias("definition")
    )
    packs = metrics.groupBy("pack_id").agg(artefacts.pack_digest().alias("sealed")).select("pack_id", F.when(F.col("pack_id") % 7 == 0, "0").otherwise(F.col("sealed")).alias("content_sha256"))
    return artefacts.pack_violations(packs, metrics, ["pack_id"]).select("pack_id", F.array_join("violations", ",").alias("violations"))


@query(
    "effective_time_rules",
    """WITH t AS (SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 'instant' WHEN 1 THEN 'day' ELSE 'unknown' END AS p, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 50 END AS a, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 50 + o_orderkey % 4 - 1 END AS b FROM orders)
SELECT k AS o_orderkey, concat_ws(',', CASE WHEN p = 'unknown' AND (a IS NOT NULL OR b IS NOT NULL) THEN 'unknown-with-bounds' END, CASE WHEN p <> 'unknown' AND (a IS NULL OR b IS NULL) THEN 'known-without-bounds' END, CASE WHEN a > b THEN 'bounds-reversed' END, CASE WHEN p = 'instant' AND a <> b THEN 'instant-with-range' END,
  CASE WHEN p = 'day' AND a = b THEN 'day-without-range' END) AS violations FROM t""",
)
def effective_time_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    precision = F.when(k % 3 == 0, "instant").when(k % 3 == 1, "day").otherwise("unknown")
    found = provenance.effective_time_rules(F.when(k % 7 != 0, k % 50), F.when(k % 11 != 0, k % 50 + k % 4 - 1), precision)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(found, ",").alias("violations"))


@query(
    "consent_and_binding_rules",
    """SELECT c_custkey, concat_ws(',', CASE WHEN c_custkey % 5 <= 1 THEN 'expires-before-grant' END, CASE WHEN c_custkey % 7 = 0 THEN 'withdrawn-before-grant' END, CASE WHEN c_custkey % 11 = 0 THEN 'modalities' END) AS consent, concat_ws(',', CASE WHEN c_custkey % 3 = 1 AND c_custkey % 13 = 0 THEN 'verified-without-method' END, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 17 = 0 THEN 'revoked-without-time' END,
CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 17 <> 0 AND c_custkey % 19 = 0 THEN 'time-without-revocation' END, CASE WHEN c_custkey % 17 <> 0 AND (c_custkey % 3 = 0 OR c_custkey % 19 = 0) AND c_custkey % 2 = 0 THEN 'revoked-before-record' END) AS binding FROM customer""",
)
def consent_and_binding_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    both = F.array(F.lit("face"), F.lit("voice"))
    rows = table(spark, sf_dir, "customer").select(
        k, (k % 5 + 9).alias("expires_at"), F.lit(10).alias("granted_at"), F.when(k % 7 == 0, 9).alias("withdrawn_at"), F.lit(True).alias("capture"), F.when(k % 22 == 0, F.array().cast("array<string>")).when(k % 11 == 0, F.array(F.lit("face"), F.lit("face"))).otherwise(both).alias("modalities"),
        F.when(k % 3 == 0, "revoked").when(k % 3 == 1, "verified").otherwise("unverified").alias("status"), F.when(k % 13 == 0, "unverified").otherwise("portal").alias("verification_method"), F.when(
            (k % 17 != 0) & ((k % 3 == 0) | (k % 19 == 0)), F.when(k % 2 == 0, 4).otherwise(6)
        ).alias("revoked_at"), F.lit(5).alias("recorded_at"),
    )
    return rows.select(
        "c_custkey", F.array_join(F.concat(provenance.consent_rules(), provenance.modality_rules()), ",").alias("consent"),
        F.array_join(provenance.binding_rules(), ",").alias("binding")
    )


@query(
    "phase_rules",
    """WITH p AS (SELECT l_orderkey AS k, l_linenumber * 10 AS s, l_linenumber * 10 + l_quantity::BIGINT % 13 AS e FROM lineitem), w AS (SELECT *, lag(e) OVER (PARTITION BY k ORDER BY s, e) AS before FROM p)
SELECT k AS l_orderkey, s AS start_day, e AS end_day, concat_ws(',', CASE WHEN e <= s THEN 'not-forward' END, CASE WHEN before > s THEN 'overlaps-previous' END, CASE WHEN e > 60 THEN 'outside-followup' END) AS violations FROM w""",
)
def phase_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("l_linenumber").cast("long") * 10
    phases = table(spark, sf_dir, "lineitem").select("l_orderkey", start.alias("start_day"), (start + F.col("l_quantity").cast("long") % 13).alias("end_day"), F.lit(60).alias("followup"))
    return provenance.phase_rules(phases, ["l_orderkey"], "followup").select("l_orderkey", "start_day", "end_day", F.array_join("violations", ",").alias("violations"))


@query(
    "scope_rules",
    """WITH o AS (SELECT o_custkey AS s, o_orderkey AS k, o_orderkey // 4 AS id, CASE WHEN o_orderkey % 23 = 0 THEN o_custkey + 1 ELSE o_custkey END AS p FROM orders), r AS (SELECT *, count(*) OVER (PARTITION BY s, id) AS n FROM o)
SELECT s AS snapshot, k AS o_orderkey, concat_ws(',', CASE WHEN p <> s THEN 'scope-crossed' END, CASE WHEN n > 1 THEN 'repeated-record' END) AS violations FROM r""",
)
def scope_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    records = table(spark, sf_dir, "orders").select(c.alias("snapshot"), k, F.expr("o_orderkey div 4").alias("record"), F.when(k % 23 == 0, c + 1).otherwise(c).alias("participant"))
    expected = records.select("snapshot", F.col("snapshot").alias("participant")).distinct()
    return provenance.scope_violations(records, ["participant"], expected, ["snapshot"], "record").select("snapshot", "o_orderkey", F.array_join("violations", ",").alias("violations"))


@query("metric_event_counts", f"WITH {LINES} SELECT k, n, CASE n WHEN 1 THEN quantity WHEN 2 THEN part % 5 ELSE 0 END AS events FROM li WHERE n <= 3")
def metric_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines 1 to 3 as a blink rate, an expression rate and a metric without events."""
    code = F.when(F.col("n") == 1, "ambient.face.blink_rate.bilateral").when(F.col("n") == 2, "ambient.face.spontaneous_event_rate").otherwise("ambient.face.mouth_width")
    rows = lines(spark, sf_dir).filter("n <= 3").select(
        "k", "n", code.alias("metric_code"), F.col("quantity").alias("blink_count"), (F.col("part") % 5).alias("expression_event_count"),
        *[F.lit(None).cast("long").alias(c) for c in assembly.EVENT_COUNTERS if c not in ("blink_count", "expression_event_count")]
    )
    return rows.select("k", "n", assembly.relevant_event_count(F.col("metric_code")).cast("long").alias("events"))
