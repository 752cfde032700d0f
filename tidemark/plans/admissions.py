"""Queries over events, orders and customers as frames, packets, records and requests that are admitted or refused."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import admission
from .catalog import query, table

_first = lambda *pairs: "CASE " + " ".join(f"WHEN {c} THEN '{r}'" for c, r in pairs) + " END"
_strings = lambda *x: F.array(*[F.lit(v) for v in x])
FRAME_LIMIT = 500


@query(
    "frame_admission",
    f"""WITH f AS (SELECT event_id AS e, event_id // 2000 AS enc, event_id % 2000 * 160.0 AS t, CASE WHEN event_id % 211 = 0 THEN NULL ELSE CASE WHEN event_id % 107 = 0 THEN 5.0 WHEN event_id % 109 = 0 THEN 0.5 ELSE 0.0 END END AS off FROM events),
j AS (SELECT *, {_first(('enc % 4 = 3', 'not-authorised'), ('e % 101 = 0', 'wrong-subject'), ('e % 103 = 0', 'wrong-participant'), ('enc % 3 = 0 AND e % 2 = 0', 'modality-not-authorised'), ('off IS NULL OR off > 1 OR t > 300000', 'invalid-time'))} AS r FROM f),
p AS (SELECT *, sum((r IS NULL)::INT) OVER (PARTITION BY enc ORDER BY t ROWS UNBOUNDED PRECEDING) AS place FROM j)
SELECT enc AS encounter, coalesce(CASE WHEN r IS NULL AND place > {FRAME_LIMIT} THEN 'window-full' ELSE r END, 'admitted') AS refusal, count(*) AS n FROM p GROUP BY ALL""",
)
def frame_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    enc, t = F.expr("event_id div 2000"), (e % 2000) * 160.0
    off = F.when(e % 211 != 0, F.when(e % 107 == 0, 5.0).when(e % 109 == 0, 0.5).otherwise(0.0))
    name = lambda p, bad, odd: F.when(e % bad == 0, odd).otherwise(F.concat(F.lit(p), enc.cast("string")))
    frames = table(spark, sf_dir, "events").select(
        enc.alias("encounter"), name("s", 101, "x").alias("subject_ref"), name("p", 103, "y").alias("platform_participant_id"), F.when(e % 2 == 0, "face").otherwise("voice").alias("modality"), (enc * 1000.0 + t + off).alias("acquired_at_ms"), t.alias("t_ms")
    )
    x = F.col("encounter")
    known = frames.select("encounter").distinct().filter(x % 4 != 3)
    authorisations = known.select(
        "encounter", F.concat(F.lit("s"), x.cast("string")).alias("participant_id"), F.concat(F.lit("p"), x.cast("string")).alias("platform_participant_id"), F.when(x % 3 == 0, _strings("voice")).otherwise(_strings("face", "voice")).alias("modalities"), (x * 1000.0).alias("started_at_ms")
    )
    judged = admission.frame_refusals(frames, authorisations, ["encounter"], FRAME_LIMIT)
    return judged.groupBy("encounter", F.coalesce("refusal", F.lit("admitted")).alias("refusal")).agg(F.count("*").alias("n"))


@query(
    "packet_admission",
    f"""WITH p AS (SELECT event_id AS e, event_id // 500 AS st, 10000.0 + event_id % 500 * 100 AS r, event_id % 500 AS seq, CASE WHEN event_id % 2 = 0 THEN 'face' ELSE 'voice' END AS modality FROM events),
a AS (SELECT *, CASE WHEN e % 17 = 0 THEN r - 2500 WHEN e % 113 = 0 THEN r + 1500 ELSE r - e % 5 * 50 END AS acq FROM p), l AS (SELECT *, max(acq) OVER (PARTITION BY st, modality ORDER BY r, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM a),
j AS (SELECT st, {_first(
    ('st % 13 = 12', 'capture-stopped'), ('st % 7 = 6', 'encounter-inactive'), ('st % 11 = 5 OR st % 11 = 6', 'participant-unresolved'), ('st % 5 = 4 OR (st % 9 = 8 AND r >= 30000) OR (st % 8 = 7 AND st % 4 = 3)', 'consent-required'), ('e % 127 = 0', 'wrong-encounter'), ('e % 131 = 0', 'attribution-ambiguous'),
    ('e % 137 = 0', 'wrong-participant'), ("st % 3 = 2 AND modality = 'face'", 'modality-unavailable'), ('e % 139 = 0 OR e % 149 = 0', 'invalid-packet'), ('acq < 9000 OR r - acq > 2000 OR acq > r + 1000 OR coalesce(acq <= last, false)', 'stale-packet'))} AS refusal FROM l)
SELECT st AS stream, coalesce(refusal, 'admitted') AS refusal, count(*) AS n FROM j GROUP BY ALL""",
)
def packet_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    stream, received = F.expr("event_id div 500"), 10_000.0 + (e % 500) * 100
    acquired = F.when(e % 17 == 0, received - 2500).when(e % 113 == 0, received + 1500).otherwise(received - e % 5 * 50)
    packets = table(spark, sf_dir, "events").select(
        stream.alias("stream"), F.when(e % 127 == 0, -1).otherwise(stream).alias("packet_encounter_id"), F.when(e % 131 == 0, "mixed").otherwise("individual-track").alias("attribution"), F.when(e % 137 == 0, "q").otherwise("p").alias("platform_participant_id"),
        F.when(e % 2 == 0, "face").otherwise("voice").alias("modality"), F.when(e % 139 == 0, "").otherwise("t").alias("track_id"), F.when(e % 149 == 0, -1).otherwise(e % 500).alias("sequence"), acquired.alias("acquired_at_ms"), received.alias("received_at"), (e % 500).alias("arrival"),
    )
    x, yes, both = F.col("stream"), F.lit(True), _strings("face", "voice")
    none = F.lit(None).cast("double")
    authorisations = packets.select("stream").distinct().filter(x % 13 != 12).select(
        "stream", (x % 7 != 6).alias("encounter_active"), x.alias("encounter_id"), F.when(x % 11 == 5, "pending").otherwise("verified").alias("b_status"), F.lit("clinic-enrollment").alias("b_verification_method"), none.alias("b_revoked_at"), F.lit(100.0).alias("b_recorded_at"),
        F.when(x % 11 == 6, -2).otherwise(x).alias("b_encounter_id"), F.lit("s").alias("b_scope"), (x % 5 != 4).alias("c_capture"), yes.alias("c_derived_analysis"), none.alias("c_withdrawn_at"), F.lit(8000.0).alias("c_granted_at"), F.when(x % 9 == 8, 30_000.0).alias("c_expires_at"), F.lit("s").alias("c_scope"),
        F.when(x % 8 == 7, _strings("voice")).otherwise(both).alias("c_modalities"), F.when((x % 8 == 7) & (x % 4 != 3), _strings("voice")).otherwise(both).alias("modalities"), F.when(x % 3 == 2, _strings("voice")).otherwise(both).alias("available"), F.lit(9000.0).alias("started_at_ms"), F.lit("p").alias("platform_participant_id"),
    )
    judged = admission.packet_refusals(packets, authorisations, ["stream"], "received_at")
    return judged.groupBy("stream", F.coalesce("refusal", F.lit("admitted")).alias("refusal")).agg(F.count("*").alias("n"))


@query(
    "consent_admission",
    f"""WITH c AS (SELECT c_custkey AS k, c_custkey % 200 AS g, CASE WHEN c_custkey % 7 = 0 THEN c_custkey % 200 + 10 END AS w, CASE WHEN c_custkey % 11 = 0 THEN c_custkey % 200 + c_custkey % 3 - 1 END AS x FROM customer)
SELECT k AS consent_id, {_first(('g > 190 OR x <= g OR w < g OR w > 190', 'consent-chronology'), ('k % 2 = 0 AND k % 5 = 0 AND w IS DISTINCT FROM g + 5', 'consent-withdrawal-immutable'), ('k % 2 = 0 AND k % 13 = 0', 'consent-grant-immutable'))} AS refusal FROM c""",
)
def consent_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    g = k % 200
    one = lambda *more: table(spark, sf_dir, "customer").select(k.alias("consent_id"), g.alias("granted_at"), *more)
    consents = one(F.when(k % 7 == 0, g + 10).alias("withdrawn_at"), F.when(k % 11 == 0, g + k % 3 - 1).alias("expires_at"), F.lit("a").alias("permissions"))
    current = one(
        F.when(k % 5 == 0, g + 5).alias("withdrawn_at"), F.when(k % 11 == 0, g + k % 3 - 1).alias("expires_at"),
        F.when(k % 13 == 0, "b").otherwise("a").alias("permissions")
    ).filter("consent_id % 2 = 0")
    return admission.consent_refusals(consents, current, ["consent_id"], ["granted_at", "expires_at", "permissions"], F.lit(190)).select("consent_id", "refusal")


@query(
    "binding_admission",
    f"""WITH b AS (SELECT o_orderkey AS k, o_orderkey % 300 AS r, CASE WHEN o_orderkey % 3 = 0 THEN 'revoked' WHEN o_orderkey % 7 = 0 THEN 'unverified' ELSE 'verified' END AS st, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0 THEN o_orderkey % 300 + o_orderkey % 4 - 1 WHEN o_orderkey % 31 = 0 THEN 5 END AS rv FROM orders)
SELECT coalesce({_first(('r > 290', 'binding-chronology'), ("st = 'verified' AND k % 17 = 0", 'binding-verification'), ("CASE WHEN st = 'revoked' THEN NOT coalesce(rv >= r AND rv <= 290, false) ELSE rv IS NOT NULL END", 'binding-revocation'), ('k % 2 = 0 AND k % 19 = 0', 'binding-identity-immutable'),
    ("k % 2 = 0 AND st <> 'revoked' AND st <> CASE WHEN k % 11 = 0 THEN 'revoked' ELSE 'verified' END", 'binding-transition'), ('k % 2 = 0 AND k % 11 = 0 AND rv IS DISTINCT FROM r', 'binding-revocation-immutable'))}, 'admitted') AS refusal, count(*) AS n FROM b GROUP BY ALL""",
)
def binding_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    r = k % 300
    status = F.when(k % 3 == 0, "revoked").when(k % 7 == 0, "unverified").otherwise("verified")
    one = lambda *more: table(spark, sf_dir, "orders").select(k.alias("binding_id"), r.alias("recorded_at"), *more)
    revoked = F.when((k % 3 == 0) & (k % 5 != 0), r + k % 4 - 1).when(k % 31 == 0, 5)
    method = F.when(k % 17 == 0, "unverified").otherwise("clinic-enrollment").alias("verification_method")
    bindings = one(status.alias("status"), revoked.alias("revoked_at"), method, F.lit("p").alias("platform_participant_id"))
    current = one(
        F.when(k % 11 == 0, "revoked").otherwise("verified").alias("status"), F.when(k % 11 == 0, r).alias("revoked_at"), method,
        F.when(k % 19 == 0, "q").otherwise("p").alias("platform_participant_id")
    ).filter("binding_id % 2 = 0")
    judged = admission.binding_refusals(bindings, current, ["binding_id"], ["recorded_at", "verification_method", "platform_participant_id"], F.lit(290))
    return judged.groupBy(F.coalesce("refusal", F.lit("admitted")).alias("refusal")).agg(F.count("*").alias("n"))


@query(
    "review_admission",
    f"""WITH r AS (SELECT o_orderkey AS k, o_custkey AS ep, o_orderkey % 3 AS rev, o_custkey % 3 AS cur FROM orders), j AS (SELECT *, k % 7 = 0 AS known, ep % 10 = 9 AS absent FROM r)
SELECT coalesce({_first(('absent', 'episode-not-found'), ('known AND k % 2 = 0', 'idempotency-conflict'), ('NOT known AND (rev <> cur OR k % 13 = 0)', 'stale-evidence'), ('NOT known AND k % 17 = 0', 'review-run-mismatch'))}, 'admitted') AS refusal, known AND k % 2 <> 0 AS duplicate, count(*) AS n FROM j GROUP BY ALL""",
)
def review_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, ep = F.col("o_orderkey"), F.col("o_custkey")
    o = table(spark, sf_dir, "orders")
    text = lambda c: c.cast("string")
    reviews = o.select(
        ep.alias("episode_id"), k.alias("idempotency_key"), F.lit("h").alias("content_hash"), text(k).alias("snapshot_id"), (k % 3).alias("input_revision"),
        text(k).alias("run_id"), F.when(k % 17 == 0, "x").otherwise("d").alias("run_digest")
    )
    episodes = o.select(ep.alias("episode_id"), (ep % 3).alias("revision")).distinct().filter("episode_id % 10 <> 9")
    snapshots = o.filter("o_orderkey % 13 <> 0").select(text(k).alias("snapshot_id"), ep.alias("episode_id"), (k % 3).alias("input_revision"), text(k).alias("run_id"), F.lit("d").alias("run_digest"))
    earlier = o.filter("o_orderkey % 7 = 0").select(ep.alias("episode_id"), k.alias("idempotency_key"), text(k).alias("snapshot_id"), F.when(k % 2 == 0, "other").otherwise("h").alias("content_hash"))
    judged = admission.review_refusals(reviews, episodes, snapshots, earlier)
    return judged.groupBy(F.coalesce("refusal", F.lit("admitted")).alias("refusal"), "duplicate").agg(F.count("*").alias("n"))


@query(
    "annotation_admission",
    f"""WITH c AS (SELECT DISTINCT c_custkey % 50 AS s FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 50 < 20), a AS (SELECT o_orderkey AS k, o_custkey % 50 AS s, CASE o_orderkey % 3 WHEN 0 THEN 'care' WHEN 1 THEN 'blind' ELSE 'other' END AS kind FROM orders)
SELECT coalesce({_first(("kind = 'care' AND k % 5 = 0", 'clinical-authority'), ("kind = 'blind' AND (c.s IS NULL OR k % 7 = 0)", 'clip-consent-required'), ("kind = 'blind' AND k % 11 = 0", 'clip-access-denied'))}, 'admitted') AS refusal, count(*) AS n FROM a LEFT JOIN c USING (s) GROUP BY ALL""",
)
def annotation_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("o_orderkey"), F.col("o_custkey") % 50
    kind = F.when(k % 3 == 0, "routine-care-reference").when(k % 3 == 1, "blinded-clip-annotation").otherwise("note")
    a = table(spark, sf_dir, "orders").select(
        s.alias("scope"), kind.alias("kind"), F.when(k % 5 == 0, "patient").otherwise("clinician").alias("role"), k.alias("encounter_id"),
        F.when(k % 7 != 0, k).alias("clip_ref")
    )
    consents = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 50).alias("scope"), (F.col("c_custkey") % 2 == 0).alias("research_clips"), (F.col("c_custkey") % 50).alias("place"))
    clips = a.filter("clip_ref % 11 <> 0").select("scope", "encounter_id", "clip_ref")
    judged = admission.annotation_refusals(a, consents, clips, ["scope"], F.col("place") < 20)
    return judged.groupBy(F.coalesce("refusal", F.lit("admitted")).alias("refusal")).agg(F.count("*").alias("n"))


def _episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    odd = lambda n, a, b: F.when(k % n == 0, a).otherwise(b)
    episodes = table(spark, sf_dir, "customer").select(
        k.alias("episode_id"), F.lit("t").alias("tenant"), odd(13, "s9", "s1").alias("study"), k.alias("participant"), odd(11, "u", "t").alias("session_tenant"), _strings("s1", "s2").alias("session_studies"), F.lit("t").alias("spec_tenant"), odd(13, "s9", "s1").alias("spec_study"), odd(17, k + 1, k).alias("spec_participant"),
        odd(19, "p9", F.concat(F.lit("p"), (k % 4).cast("string"))).alias("protocol_id"), odd(23, "2", "1").alias("protocol_version"), F.concat(F.lit("d"), (k % 4).cast("string")).alias("protocol_digest"), (k % 29 != 0).alias("spec_verified"),
    )
    protocols = spark.createDataFrame([(f"p{n}", "1", f"d{n}", n != 3) for n in range(4)], "protocol_id string, version string, digest string, verified boolean")
    return admission.episode_refusals(episodes, protocols, protocols.filter("protocol_id <> 'p2'").select("digest"))


_EPISODES = f"""SELECT c_custkey AS k, {_first(('c_custkey % 11 = 0 OR c_custkey % 13 = 0', 'scope-mismatch'), ('c_custkey % 17 = 0', 'specification-scope'), ('c_custkey % 19 = 0 OR c_custkey % 4 = 3 OR c_custkey % 29 = 0', 'artifact-integrity'), ('c_custkey % 23 = 0', 'protocol-mismatch'), ('c_custkey % 4 = 2', 'protocol-not-registered'))} AS refusal FROM customer"""


@query("episode_admission", f"WITH e AS ({_EPISODES}) SELECT k AS episode_id, refusal FROM e")
def episode_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _episodes(spark, sf_dir).select("episode_id", "refusal")


@query(
    "access_audit",
    f"WITH e AS ({_EPISODES}) SELECT CASE WHEN refusal IS NULL THEN 'allowed' ELSE 'denied' END AS result, coalesce(refusal, '') AS reason, count(*) AS n, count(DISTINCT k) AS ids FROM e GROUP BY ALL"
)
def access_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = admission.access_audit(_episodes(spark, sf_dir).withColumn("recorded_at", F.lit(7)), "participant", "episode-create", "recorded_at", "episode_id")
    return rows.groupBy("result", F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count("*").alias("n"), F.countDistinct("audit_id").alias("ids"))


@query(
    "source_counts",
    "SELECT o_custkey, CAST(sum((o_orderstatus = 'F')::INT) AS BIGINT) AS f, CAST(sum((o_orderstatus = 'O')::INT) AS BIGINT) AS o, CAST(sum((o_orderstatus = 'x-y')::INT) AS BIGINT) AS x_y FROM orders GROUP BY o_custkey"
)
def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admission.source_counts(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", ["F", "O", "x-y"]).select("o_custkey", F.col("F").alias("f"), F.col("O").alias("o"), "x_y")
