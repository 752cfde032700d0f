"""Access and retention: consent and binding validity, snapshot accessibility, clips, scopes, registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def consent_permits(start: Column, end: Column, now: Column) -> Column:
    """Over a consent's columns: capture, analysis and retention are granted over [start, end], and still are."""
    c = F.col
    live = (c("granted_at") <= start) & F.coalesce(c("expires_at") > F.greatest(end, now), F.lit(True)) & F.coalesce(c("withdrawn_at") > now, F.lit(True))
    return F.coalesce(c("capture") & c("derived_analysis") & c("derived_retention") & live, F.lit(False))


def binding_holds(encounter: Column) -> Column:
    return F.coalesce((F.col("status") == "verified") & F.col("revoked_at").isNull() & (F.col("encounter_id") == encounter), F.lit(False))


def capture_context(consents: DataFrame, bindings: DataFrame, scope: list[str], now: Column) -> DataFrame:
    """For each encounter its verified binding with its scope's newest permitting consent; encounters without either are left out."""
    permitting = consents.filter(consent_permits(now, now, now)).withColumn(
        "newest", F.row_number().over(Window.partitionBy(*scope).orderBy(F.col("granted_at").desc(), "consent_id"))
    ).filter("newest = 1").select(*scope, "consent_id")
    held = bindings.filter((F.col("status") == "verified") & F.col("revoked_at").isNull())
    one = held.groupBy(*scope, "encounter_id").agg(F.min("binding_id").alias("binding_id"))
    return one.join(permitting, scope)


def accessible_snapshots(used: DataFrame, sources: DataFrame) -> DataFrame:
    """snapshot_id and accessible: every used revision (snapshot_id, revision_id) is a source (revision_id, permitted) that is still permitted."""
    joined = used.join(sources.select("revision_id", "permitted"), "revision_id", "left")
    return joined.groupBy("snapshot_id").agg(F.min(F.coalesce("permitted", F.lit(False))).alias("accessible"))


#: Fixed value: why evidence that rests on captured data is not shown.
CONSENT_INACTIVE = "analysis-consent-inactive"


def evidence_status(episodes: DataFrame, snapshots: DataFrame, jobs: DataFrame, reviews: DataFrame | None = None) -> DataFrame:
    """Episodes with status: ready (an accessible snapshot of the current revision), failed, pending or empty; with snapshot_id where ready, and with refusal.

    snapshots: episode_id, input_revision, accessible and, where reviews are given, snapshot_id. Where episodes have has_capture and consented, one with captured data and without
    consent to its analysis has a refusal, and neither status nor more. reviews: snapshot_id and review_id; visible_reviews lists those
    of all accessible snapshots of the episode, whatever their revision, in order.
    """
    named = "snapshot_id" in snapshots.columns
    seen = snapshots.filter("accessible")
    ready = seen.groupBy("episode_id", F.col("input_revision").alias("revision")).agg((F.max("snapshot_id") if named else F.lit(None).cast("string")).alias("snapshot_id"), F.lit(True).alias("ready"))
    job = jobs.groupBy("episode_id", F.col("input_revision").alias("revision")).agg(F.max_by("job_status", "job_id").alias("job_status"))
    joined = episodes.join(ready, ["episode_id", "revision"], "left").join(job, ["episode_id", "revision"], "left")
    gated = {"has_capture", "consented"} <= set(episodes.columns)
    refused = F.col("has_capture") & ~F.coalesce("consented", F.lit(False)) if gated else F.lit(False)
    shown = lambda c: F.when(~F.coalesce(refused, F.lit(False)), c)
    status = F.when(F.col("ready"), "ready").when(F.col("job_status") == "failed", "failed").when(F.col("job_status").isNotNull(), "pending").otherwise("empty")
    out = joined.withColumns({"status": shown(status), "snapshot_id": shown(F.col("snapshot_id")), "refusal": F.when(refused, CONSENT_INACTIVE)}).drop("ready", "job_status")
    if reviews is None:
        return out
    visible = seen.select("episode_id", "snapshot_id").distinct().join(reviews, "snapshot_id").groupBy("episode_id").agg(F.array_sort(F.collect_set("review_id")).alias("visible_reviews"))
    listed = F.coalesce("visible_reviews", F.array().cast(visible.schema["visible_reviews"].dataType))
    return out.join(visible, "episode_id", "left").withColumn("visible_reviews", shown(listed))


def latest_review(runs: DataFrame, reviews: DataFrame) -> DataFrame:
    """Runs (run_id, digest, superseded_by) with the disposition of their last review of the same digest, and status."""
    last = reviews.groupBy("run_id", "digest").agg(F.max_by("disposition", F.struct("recorded_at", "review_id")).alias("disposition"), F.max("recorded_at").alias("reviewed_at"))
    joined = runs.join(last, ["run_id", "digest"], "left")
    shown = F.when(F.col("disposition") == "acknowledged", "reviewed").otherwise(F.coalesce("disposition", F.lit("generated")))
    return joined.withColumn("status", F.when(F.col("superseded_by").isNotNull(), "superseded").otherwise(shown))


def clip_reasons(now: Column, retention: Column) -> Column:
    """Why a clip is not available, over a clip left-joined with its consent (k_*) and observation (o_*); empty if it is."""
    c = F.col
    return S.reasons([
        (F.coalesce(c("status") != "available", F.lit(True)), "not-available"), (
            ~F.coalesce((c("created_at") <= now) & (c("expires_at") > now) & (c("expires_at") <= c("created_at") + retention), F.lit(False)), "expired"
        ),
        (c("k_id").isNull(), "consent-missing"), (
            c("k_id").isNotNull() & ~F.coalesce(c("k_retain") & c("k_withdrawn_at").isNull() & (c("k_valid_from") <= now) & (c("k_valid_until") > now), F.lit(False)),
            "consent-not-valid"
        ),
        (
            ~F.coalesce(
                (c("captured_at") >= F.greatest("k_valid_from", "o_started_at")) & (c("ended_at") <= F.least(c("k_valid_until"), c("o_ended_at"), now)) & (c("ended_at") > c("captured_at")),
                F.lit(False)
            ),
            "capture-outside-source"
        ),
    ])


def to_delete(clips: DataFrame, now: Column, retention: Column) -> DataFrame:
    """The clips that a retention sweep removes, with the reasons; deletion itself is the caller's."""
    return clips.withColumn("reasons", clip_reasons(now, retention)).filter(F.size("reasons") > 0)


def permitted_scope(rows: DataFrame, grants: DataFrame, keys: list[str]) -> DataFrame:
    """The rows in some principal's scope; grants repeat no row."""
    return rows.join(grants.select(*keys).distinct(), keys, "left_semi")


def completed(present: DataFrame, owners: DataFrame, registry: DataFrame, owner: list[str], code: str) -> DataFrame:
    """One row for each owner and registered code, with problem: missing, repeated, or null. The registry is a small table of the library."""
    counted = present.groupBy(*owner, code).agg(F.count("*").alias("n"))
    every = owners.select(*owner).distinct().crossJoin(registry.select(code))  # a fixed handful of codes
    joined = every.join(counted, [*owner, code], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return joined.withColumn("problem", F.when(F.col("n") == 0, "missing").when(F.col("n") > 1, "repeated"))


def unregistered(present: DataFrame, registry: DataFrame, code: str) -> DataFrame:
    return present.join(registry.select(code), code, "left_anti")
