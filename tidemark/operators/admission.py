"""Admission of frames, packets, records, reviews and episodes: every row is kept with the reason that refuses it, null if none does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

# Fixed values of admission.
MAX_CAPTURE_MS, CLOCK_AGREEMENT_MS, PACKET_AGE_MS, CLOCK_AHEAD_MS = 300_000, 1, 2_000, 1_000


def _changed(columns: list[str], prefix: str = "p_") -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | ~F.col(c).eqNullSafe(F.col(f"{prefix}{c}"))
    return out


def _joined(rows: DataFrame, other: DataFrame, keys: list[str], prefix: str = "p_") -> DataFrame:
    return rows.join(other.select(*keys, *[F.col(c).alias(f"{prefix}{c}") for c in other.columns if c not in keys]), keys, "left")


def frame_refusals(frames: DataFrame, authorisations: DataFrame, keys: list[str], most: int | None = None) -> DataFrame:
    """Frames (subject_ref, platform_participant_id, modality, acquired_at_ms, t_ms) with refusal, against their authorisation (participant_id, platform_participant_id, modalities, started_at_ms).

    With most: of a key's sound frames in time order, those beyond that number are refused as well.
    """
    c = F.col
    joined = _joined(frames, authorisations, keys, "a_")
    timed = S.finite("acquired_at_ms") & S.finite("t_ms") & F.coalesce(
        c("t_ms").between(0, MAX_CAPTURE_MS) & (F.abs(c("acquired_at_ms") - c("a_started_at_ms") - c("t_ms")) <= CLOCK_AGREEMENT_MS), F.lit(False)
    )
    reason = S.first_reason([
        (c("a_participant_id").isNull(), "not-authorised"), (~c("subject_ref").eqNullSafe(c("a_participant_id")), "wrong-subject"), (
            ~c("platform_participant_id").eqNullSafe(c("a_platform_participant_id")), "wrong-participant"
        ),
        (~F.coalesce(F.array_contains("a_modalities", c("modality")), F.lit(False)), "modality-not-authorised"), (~timed, "invalid-time"),
    ])
    judged = joined.withColumn("refusal", reason)
    if most is not None:
        place = F.sum(F.col("refusal").isNull().cast("long")).over(Window.partitionBy(*keys).orderBy("t_ms", "acquired_at_ms").rowsBetween(Window.unboundedPreceding, 0))
        judged = judged.withColumn("place", place).withColumn("refusal", F.when(F.col("refusal").isNull() & (F.col("place") > most), "window-full").otherwise(F.col("refusal"))).drop("place")
    return judged.select(*frames.columns, "refusal")


def authorisation_failure(now: Column) -> Column:
    """Over an encounter's authorisation (encounter_active, encounter_id, b_* of its binding, c_* of its consent, modalities): the first failing rule."""
    c = F.col
    bound = c("b_status").eqNullSafe("verified") & (c("b_verification_method") != "unverified") & c("b_revoked_at").isNull() & (c("b_recorded_at") <= now) & (c("b_encounter_id") == c("encounter_id"))
    permitted = c("c_capture") & c("c_derived_analysis") & c("c_withdrawn_at").isNull() & (c("c_granted_at") <= now) & F.coalesce(c("c_expires_at") > now, F.lit(True)) & c("c_scope").eqNullSafe(c("b_scope"))
    covered = (F.size("modalities") > 0) & (F.size(F.array_except("modalities", "c_modalities")) == 0)
    return S.first_reason([
        (
            ~F.coalesce(c("encounter_active"), F.lit(False)) | c("encounter_id").isNull(), "encounter-inactive"
        ), (~F.coalesce(bound, F.lit(False)), "participant-unresolved"), (~F.coalesce(permitted & covered, F.lit(False)), "consent-required"),
    ])


def packet_refusals(packets: DataFrame, authorisations: DataFrame, keys: list[str], now: str) -> DataFrame:
    """Packets with refusal, the first failing rule, null if admitted.

    packets: packet_encounter_id, attribution, platform_participant_id, modality, track_id, sequence, acquired_at_ms and a column with the time of receipt.
    authorisations: what authorisation_failure() asks for, with started_at_ms, available (modalities that are up) and platform_participant_id.
    A packet that is not later than an earlier one of its modality is stale, whether or not that one was admitted.
    """
    c = F.col
    joined = packets.join(
        authorisations.select(
            *keys,
            *[c(x).alias(x if x in (
                "encounter_active", "encounter_id", "modalities", "available", "started_at_ms"
            ) or x[:2] in ("b_", "c_") else f"a_{x}") for x in authorisations.columns if x not in keys]
        ),
        keys, "left"
    )
    w = Window.partitionBy(*keys, "modality").orderBy(now, "sequence").rowsBetween(Window.unboundedPreceding, -1)
    last = F.max("acquired_at_ms").over(w)
    at, received = c("acquired_at_ms"), c(now)
    listed = F.coalesce(F.array_contains("modalities", c("modality")) & F.array_contains("available", c("modality")), F.lit(False))
    valid = F.coalesce(F.length("track_id") > 0, F.lit(False)) & F.coalesce(c("sequence") >= 0, F.lit(False)) & S.finite("acquired_at_ms")
    stale = (at < F.greatest("started_at_ms", "c_granted_at")) | (received - at > PACKET_AGE_MS) | (at > received + CLOCK_AHEAD_MS) | F.coalesce(at <= c("last_at"), F.lit(False))
    judged = joined.withColumn("last_at", last).withColumn("failure", authorisation_failure(received))
    reason = S.first_reason([
        (c("a_platform_participant_id").isNull(), "capture-stopped"), (c("failure") == "encounter-inactive", "encounter-inactive"), (
            c("failure") == "participant-unresolved", "participant-unresolved"
        ), (c("failure") == "consent-required", "consent-required"),
        (~c("packet_encounter_id").eqNullSafe(c("encounter_id")), "wrong-encounter"), (~c("attribution").eqNullSafe("individual-track"), "attribution-ambiguous"), (
            ~c("platform_participant_id").eqNullSafe(c("a_platform_participant_id")), "wrong-participant"
        ),
        (~listed, "modality-unavailable"), (~valid, "invalid-packet"), (stale, "stale-packet"),
    ])
    return judged.withColumn("refusal", reason).select(*packets.columns, "refusal")


def consent_refusals(consents: DataFrame, current: DataFrame, keys: list[str], granted: list[str], now: Column) -> DataFrame:
    """Consents with refusal: chronology, a withdrawal that is taken back, or a grant that changes. granted: the columns that never change."""
    c, withdrawn = F.col, F.col("withdrawn_at")
    joined = _joined(consents, current.withColumn("known", F.lit(True)), keys)
    chronology = (c("granted_at") > now) | (c("expires_at") <= c("granted_at")) | (withdrawn < c("granted_at")) | (withdrawn > now)
    return joined.withColumn("refusal", S.first_reason([
        (chronology, "consent-chronology"), (
            c("p_known") & c("p_withdrawn_at").isNotNull() & ~c("p_withdrawn_at").eqNullSafe(withdrawn), "consent-withdrawal-immutable"
        ), (c("p_known") & _changed(granted), "consent-grant-immutable"),
    ])).select(*consents.columns, "refusal")


def binding_refusals(bindings: DataFrame, current: DataFrame, keys: list[str], identity: list[str], now: Column) -> DataFrame:
    """Bindings with refusal: chronology, verification, revocation, and what of an existing one may not change."""
    c = F.col
    joined = _joined(bindings, current.withColumn("known", F.lit(True)), keys)
    revoked = c("status") == "revoked"
    agrees = F.when(revoked, F.coalesce((c("revoked_at") >= c("recorded_at")) & (c("revoked_at") <= now), F.lit(False))).otherwise(c("revoked_at").isNull())
    return joined.withColumn("refusal", S.first_reason([
        (c("recorded_at") > now, "binding-chronology"), (
            (c("status") == "verified") & (c("verification_method") == "unverified"), "binding-verification"
        ), (~agrees, "binding-revocation"), (c("p_known") & _changed(identity), "binding-identity-immutable"),
        (c("p_known") & (c("p_status") != c("status")) & ~revoked, "binding-transition"), (
            c("p_known") & c("p_revoked_at").isNotNull() & ~c("p_revoked_at").eqNullSafe(c("revoked_at")), "binding-revocation-immutable"
        ),
    ])).select(*bindings.columns, "refusal")


def review_refusals(reviews: DataFrame, episodes: DataFrame, snapshots: DataFrame, earlier: DataFrame) -> DataFrame:
    """Reviews with refusal and duplicate: a known key with the same content is a duplicate; else the snapshot must be the episode's current one and the run just its own.

    reviews: episode_id, idempotency_key, content_hash, snapshot_id, input_revision, run_id, run_digest. episodes: episode_id, revision.
    snapshots: snapshot_id, episode_id, input_revision, run_id, run_digest. earlier: episode_id, idempotency_key, snapshot_id, content_hash.
    """
    c = F.col
    joined = _joined(_joined(_joined(reviews, episodes, ["episode_id"], "e_"), snapshots, ["snapshot_id", "episode_id", "input_revision"], "s_"), earlier, ["episode_id", "idempotency_key"])
    known = c("p_content_hash").isNotNull()
    same = (c("p_content_hash") == c("content_hash")) & (c("p_snapshot_id") == c("snapshot_id"))
    bound = c("s_run_id").eqNullSafe(c("run_id")) & c("s_run_digest").eqNullSafe(c("run_digest"))
    current = F.coalesce(c("e_revision") == c("input_revision"), F.lit(False)) & c("s_run_id").isNotNull()
    return joined.withColumn("refusal", S.first_reason([
        (c("e_revision").isNull(), "episode-not-found"), (known & ~same, "idempotency-conflict"), (~known & ~current, "stale-evidence"), (~known & ~bound, "review-run-mismatch"),
    ])).withColumn("duplicate", known & same).select(*reviews.columns, "refusal", "duplicate")


def annotation_refusals(annotations: DataFrame, consents: DataFrame, clips: DataFrame, scope: list[str], permits: Column) -> DataFrame:
    """Annotations (kind, role, encounter_id, clip_ref) with refusal: routine-care outcomes need clinical authority; blinded ones a research consent now and a clip of their encounter."""
    able = consents.filter(permits & F.col("research_clips")).select(*scope).distinct().withColumn("researched", F.lit(True))
    owned = clips.select(*scope, "encounter_id", "clip_ref").distinct().withColumn("owned", F.lit(True))
    joined = annotations.join(able, scope, "left").join(owned, [*scope, "encounter_id", "clip_ref"], "left")
    blinded = F.col("kind") == "blinded-clip-annotation"
    return joined.withColumn("refusal", S.first_reason([
        (
            (F.col("kind") == "routine-care-reference") & ~F.col("role").isin("clinician", "integration"), "clinical-authority"
        ), (blinded & (F.col("researched").isNull() | F.col("clip_ref").isNull()), "clip-consent-required"), (blinded & F.col("owned").isNull(), "clip-access-denied"),
    ])).select(*annotations.columns, "refusal")


def episode_refusals(episodes: DataFrame, protocols: DataFrame, registered: DataFrame) -> DataFrame:
    """Episodes with refusal. episodes: tenant, study, participant, session_tenant, session_studies, spec_tenant, spec_study, spec_participant, protocol_id, protocol_version, protocol_digest (what the specification names) and spec_verified.

    protocols: protocol_id, version, digest, verified. registered: the digests that live analysis may use.
    """
    c = F.col
    named = protocols.select("protocol_id", c("version").alias("n_version"), c("digest").alias("n_digest"), c("verified").alias("n_verified"))
    allowed = registered.select(c("digest").alias("n_digest")).distinct().withColumn("allowed", F.lit(True))
    joined = episodes.join(named, "protocol_id", "left").join(allowed, "n_digest", "left")
    outside = ~c("tenant").eqNullSafe(c("session_tenant")) | ~F.coalesce(F.array_contains("session_studies", c("study")), F.lit(False))
    other = ~c("spec_tenant").eqNullSafe(c("tenant")) | ~c("spec_study").eqNullSafe(c("study")) | ~c("spec_participant").eqNullSafe(c("participant"))
    return joined.withColumn("refusal", S.first_reason([
        (outside, "scope-mismatch"), (other, "specification-scope"), (~F.coalesce(c("n_verified") & c("spec_verified"), F.lit(False)), "artifact-integrity"),
        (~c("n_digest").eqNullSafe(c("protocol_digest")) | ~c("n_version").eqNullSafe(c("protocol_version")), "protocol-mismatch"), (c("allowed").isNull(), "protocol-not-registered"),
    ])).select(*episodes.columns, "refusal")


def access_audit(judged: DataFrame, actor: str, action: str, at: str, artifact: str) -> DataFrame:
    """An audit row for each judged request: actor_id, action, result (allowed or denied), reason, artifact_id and recorded_at, with an id of its own content."""
    row = judged.select(
        F.col(actor).cast("string").alias("actor_id"), F.lit(action).alias("action"),
        F.when(F.col("refusal").isNull(), "allowed").otherwise("denied").alias("result"), F.col("refusal").alias("reason"),
        F.col(artifact).cast("string").alias("artifact_id"), F.col(at).alias("recorded_at")
    )
    return row.withColumn("audit_id", S.identity("audit", "actor_id", "action", "artifact_id", "recorded_at"))


def source_counts(records: DataFrame, episode: str, kind: str, kinds: list[str]) -> DataFrame:
    """Records of each listed kind by episode, 0 where there are none."""
    return records.groupBy(episode).agg(*[F.sum((F.col(kind) == k).cast("long")).alias(k.replace("-", "_")) for k in kinds])
