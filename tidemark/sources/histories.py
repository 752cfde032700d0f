"""Readers of nested documents: snapshots of a history, the append-only log of inputs, workflow events; and the tables of metric definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S

_REVISION = "revisionId: string, supersedesRevisionId: string, recordedAt: timestamp"
_TIME = "effectiveTime: struct<earliest: timestamp, latest: timestamp, precision: string>"
_METRIC = "metricCode: string, unit: string, context: string, modality: string, algorithmVersion: string, processorRef: string, status: string, value: double, reasonCodes: array<string>, usableDurationMs: double, technicalQualityScore: double, sourceWindowIds: array<string>"
_WINDOW = "windowId: string, startMs: double, endMs: double, status: string, reasonCodes: array<string>"
#: A snapshot document: five lists of one scope.
SNAPSHOT_DDL = (
    "scope struct<tenantId: string, studyId: string, participantId: string>, asOf timestamp, "
    f"observations array<struct<observationId: string, {_REVISION}, encounterId: string, consentId: string, bindingId: string, startedAt: timestamp, endedAt: timestamp, status: string, windows: array<struct<{_WINDOW}>>, metrics: array<struct<{_METRIC}>>>>, "
    "consents array<struct<consentId: string, grantedAt: timestamp, expiresAt: timestamp, withdrawnAt: timestamp, permissions: struct<capture: boolean, derivedAnalysis: boolean, derivedRetention: boolean, researchClips: boolean, modalities: array<string>>>>, "
    "bindings array<struct<bindingId: string, encounterId: string, platformParticipantId: string, status: string, verificationMethod: string, recordedAt: timestamp, revokedAt: timestamp>>, "
    f"treatments array<struct<treatmentId: string, {_REVISION}, courseId: string, status: string, verification: string, kind: string, {_TIME}>>, "
    f"contexts array<struct<contextId: string, {_REVISION}, status: string, kind: string, {_TIME}>>"
)
_SCOPE = ["scope.tenantId", "scope.studyId", "scope.participantId"]


def snapshot_tables(documents: DataFrame, payload: str) -> dict[str, DataFrame]:
    """observations, windows, metrics, consents, bindings, treatments, contexts and unread (documents that are none) of a column of JSON snapshots.

    Every child row has the scope's three columns; windows and metrics also revisionId. A document without a scope is unread.
    """
    read = documents.withColumn("snapshot", F.from_json(payload, SNAPSHOT_DDL))
    known = read.filter("snapshot.scope.participantId is not null").select("snapshot.*")
    child = lambda name: known.select(*_SCOPE, F.inline(name))
    observations = child("observations")
    own = lambda name: observations.select("tenantId", "studyId", "participantId", "revisionId", F.inline(name))
    tables = {"observations": observations.drop("windows", "metrics"), "windows": own("windows"), "metrics": own("metrics")}
    tables |= {name: child(name) for name in ("consents", "bindings", "treatments", "contexts")}
    return tables | {"unread": read.filter("snapshot.scope.participantId is null").drop("snapshot")}


def split_log(log: DataFrame, kinds: dict[str, str], kind: str = "kind", payload: str = "payload") -> dict[str, DataFrame]:
    """The rows of a log by kind, their payload parsed with the kind's schema; and other: rows of no listed kind."""
    rest = [c for c in log.columns if c not in (kind, payload)]
    tables = {k: log.filter(F.col(kind) == k).select(*rest, F.from_json(payload, ddl).alias("p")).select(*rest, "p.*") for k, ddl in kinds.items()}
    return tables | {"other": log.filter(~F.coalesce(F.col(kind).isin(*kinds), F.lit(False)))}


def definition_table(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A table of definitions in their order (place, from 0), each with the digest of its content."""
    names = [c.split()[0] for c in columns.split(", ")]
    df = spark.createDataFrame([(k, *row) for k, row in enumerate(rows)], f"place int, {columns}")
    return df.withColumn("digest", S.digest({c: c for c in names}))
