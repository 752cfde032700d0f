"""Admission to an append-only log: idempotency, corrections, mapping of coded resources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def classify_batch(batch: DataFrame, log: DataFrame, keys: list[str], content_hash: str, order: list[str]) -> DataFrame:
    """The batch with admission: new; duplicate (same key and hash as one before); conflict (same key, other hash). Earlier means in the log, or before it in the batch."""
    first = Window.partitionBy(*keys).orderBy(*order)
    held = log.groupBy(*keys).agg(F.min(content_hash).alias("held_hash"))
    joined = batch.join(held, keys, "left").withColumn("first_hash", F.coalesce("held_hash", F.first(content_hash).over(first))).withColumn("turn", F.row_number().over(first))
    kind = F.when(F.col("held_hash").isNull() & (F.col("turn") == 1), "new").when(F.col(content_hash) == F.col("first_hash"), "duplicate").otherwise("conflict")
    return joined.withColumn("admission", kind).drop("held_hash", "first_hash", "turn")


def correction_admission(batch: DataFrame, current: DataFrame, keys: list[str], replaces: str, record_id: str) -> DataFrame:
    """The batch with correction: admitted, or correction-conflict where it does not replace just the current version of its key."""
    now = current.select(*keys, F.col(record_id).alias("current_id"))
    sound = F.col(replaces).eqNullSafe(F.col("current_id"))
    return batch.join(now, keys, "left").withColumn("correction", F.when(sound, "admitted").otherwise("correction-conflict")).drop("current_id")


def correction_chain_reasons(supersedes: Column, revision: Column, recorded: Column, record_class: Column) -> Column:
    """Over a record left-joined with the current one of its id (current_revision, current_recorded, current_class)."""
    exists = F.col("current_revision").isNotNull()
    other = exists & (F.col("current_revision") != revision)
    return S.reasons([
        (~exists & supersedes.isNotNull(), "correction-parent-missing"), (other & ~supersedes.eqNullSafe(F.col("current_revision")), "correction-chain"),
        (other & (recorded < F.col("current_recorded")), "correction-chronology"), (exists & (record_class != F.col("current_class")), "record-class-change"),
    ])


def without_duplicates(admitted: DataFrame) -> DataFrame:
    return admitted.filter("admission = 'new'").drop("admission")


#: Resource types that are taken in, and why a resource is not.
RESOURCE_TYPES = ["MedicationAdministration", "MedicationRequest", "MedicationStatement", "Procedure"]
UNSUPPORTED, NO_ID, OTHER_PATIENT, MODIFIER = "unsupported-resource-type", "fhir-resource-id", "fhir-patient-mismatch", "fhir-unsupported-modifier"
UNMAPPED, NOT_COMPLETE = "unmapped-treatment-code", "administration-not-confirmed-complete"
#: Why nothing can be read.
NO_JSON, NO_OBJECT, NO_ENTRIES, NO_RESOURCE = "not-json", "not-an-object", "entry-is-not-a-list", "entry-without-resource"
_ID = r"^[A-Za-z0-9.-]{1,64}$"

_CODING = "array<struct<system: string, code: string>>"
RESOURCE_DDL = (
    "resourceType string, id string, status string, subject struct<reference: string>, meta struct<versionId: string, lastUpdated: string>, modifierExtension array<string>, "
    f"code struct<coding: {_CODING}>, medicationCodeableConcept struct<coding: {_CODING}>, medicationReference struct<reference: string>, effectiveDateTime string, performedDateTime string, "
    f"dosage struct<dose: struct<value: double, unit: string, code: string, comparator: string>, route: struct<coding: {_CODING}>, site: struct<coding: {_CODING}>>"
)


def _kind(json: Column) -> Column:
    """What a variant is: OBJECT<...>, ARRAY<...>, a simple type, or null."""
    return F.schema_of_variant(json)


def read_resources(documents: DataFrame, document_id: str, payload: str) -> tuple[DataFrame, DataFrame]:
    """(resources, unread) of JSON documents, each a bundle of resources or one resource.

    resources: document_id, position (0 for a single one), resource (RESOURCE_DDL; fields of another type are null) and content_sha256, which the
    order of keys does not change. unread: document_id, position (null for a whole document), reason and raw. A bundle without
    entries has none of either.
    """
    json = F.col("json")
    parsed = documents.select(F.col(document_id), F.col(payload).alias("raw"), F.try_parse_json(payload).alias("json"))
    is_object = F.coalesce(_kind(json).startswith("OBJECT"), F.lit(False))
    bundle = is_object & F.coalesce(F.try_variant_get(json, "$.resourceType", "string") == "Bundle", F.lit(False))
    entry, entries = F.try_variant_get(json, "$.entry", "variant"), F.try_variant_get(json, "$.entry", "array<variant>")
    absent = entry.isNull() | (_kind(entry) == "VOID")
    reason = F.when(json.isNull(), NO_JSON).when(~is_object, NO_OBJECT).when(bundle & ~absent & entries.isNull(), NO_ENTRIES)
    none = F.lit(None).cast("variant")
    item = lambda position, entry, resource, why: F.struct(position.cast("int").alias("position"), entry.alias("entry"), resource.alias("resource"), why.cast("string").alias("reason"))
    listed = F.transform(F.coalesce(entries, F.array().cast("array<variant>")), lambda e, k: item(k, e, F.try_variant_get(e, "$.resource", "variant"), F.lit(None)))
    #: One list for each document, so that its JSON is parsed once and filters stay behind the generator.
    each = F.when(reason.isNotNull(), F.array(item(F.lit(None), none, none, reason))).when(~bundle, F.array(item(F.lit(0), json, json, F.lit(None)))).otherwise(listed)
    items = parsed.select(document_id, "raw", F.explode(each).alias("e"))
    sound = F.coalesce(_kind(F.col("e.resource")).startswith("OBJECT"), F.lit(False))
    text = F.to_json("e.resource")
    resources = items.filter(sound).select(document_id, "e.position", text.alias("text"))
    resources = resources.select(document_id, "position", F.from_json("text", RESOURCE_DDL).alias("resource"), F.sha2("text", 256).alias("content_sha256"))
    whole = F.col("e.reason").isNotNull()
    unread = items.filter(~sound).select(document_id, "e.position", F.coalesce("e.reason", F.lit(NO_RESOURCE)).alias("reason"), F.when(whole, F.col("raw")).otherwise(F.to_json("e.entry")).alias("raw"))
    return resources, unread


def map_resources(resources: DataFrame, document_id: str, codes: DataFrame, patient: Column | None = None, date_offset: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, excluded, sources) of read_resources(): each resource is in one of the first two, known by document_id and position.

    rows: resource_id, record (treatment or context), status, verification, kind, product, effective, dose, route, site. excluded: resource_id and
    reason. sources: version_id (a digest of the content where none is given), last_updated, content_sha256 and original_effective of
    every resource of a type that is taken in, of the right patient.

    codes: system, code, product, kind, position; of several that fit, the first. A medication is looked up by reference within its
    document. An order is never an administration. patient: the reference that a resource must have; null or left out: any.
    """
    r, place = F.col("resource"), [document_id, "position"]
    known = resources.withColumn("resource_id", F.concat_ws("/", r["resourceType"], F.coalesce(r["id"], F.lit("missing-id"))))
    if "content_sha256" not in known.columns:
        known = known.withColumn("content_sha256", F.sha2(F.to_json(r), 256))
    of_type = F.coalesce(r["resourceType"].isin(RESOURCE_TYPES), F.lit(False))
    wanted = F.lit(None).cast("string") if patient is None else patient
    refused = S.first_reason([
        (~of_type, UNSUPPORTED), (~F.coalesce(r["id"].rlike(_ID), F.lit(False)), NO_ID), (wanted.isNotNull() & ~r["subject"]["reference"].eqNullSafe(wanted), OTHER_PATIENT),
        (F.coalesce(F.size(r["modifierExtension"]) > 0, F.lit(False)), MODIFIER),
    ])
    judged = known.withColumn("refused", refused)
    medications = known.filter(r["resourceType"] == "Medication").groupBy(document_id, F.col("resource_id").alias("m_id")).agg(F.max_by(r["code"]["coding"], "position").alias("m_coding"))
    typed = judged.filter("refused is null").withColumn("m_id", r["medicationReference"]["reference"])
    coded = typed.join(medications, [document_id, "m_id"], "left").withColumn(
        "coding",
        F.when(r["resourceType"] == "Procedure", r["code"]["coding"]).otherwise(F.coalesce(r["medicationCodeableConcept"]["coding"], F.col("m_coding")))
    )
    each = coded.select(*place, F.explode("coding").alias("c")).select(*place, F.col("c.system").alias("system"), F.col("c.code").alias("code"))
    ranked = codes.withColumnRenamed("position", "rank")
    mapped = each.join(ranked, ["system", "code"]).groupBy(*place).agg(F.min_by(F.struct("kind", "product"), "rank").alias("mapping"))
    joined = coded.join(mapped, place, "left")
    kind = r["resourceType"]
    actual = kind.isin("MedicationAdministration", "Procedure")
    completed, error = F.coalesce(actual & (r["status"] == "completed"), F.lit(False)), F.coalesce(r["status"] == "entered-in-error", F.lit(False))
    treatment = F.col("mapping").isNotNull() & (completed | error | (kind == "MedicationRequest"))
    context = (kind == "MedicationStatement") | ((kind == "Procedure") & (completed | error))
    planned = ~error & ~completed
    effective = F.when(kind == "Procedure", r["performedDateTime"]).otherwise(r["effectiveDateTime"])
    dose, unit = r["dosage"]["dose"], F.coalesce(r["dosage"]["dose"]["unit"], r["dosage"]["dose"]["code"])
    marked = joined.withColumn("record", F.when(treatment, "treatment").when(context, "context"))
    rows = marked.filter("record is not null").select(
        *place, "resource_id", "record",
        F.when(error, "entered-in-error").when(F.col("record") == "context", "active").when(completed, "administered").otherwise("planned").alias("status"),
        F.when(actual, "verified").otherwise("unverified").alias("verification"), F.col("mapping.kind").alias("kind"), F.col("mapping.product").alias("product"),
        S.clinical_time(F.when((F.col("record") == "treatment") & planned, None).otherwise(effective), date_offset).alias("effective"),
        F.when(
            dose["comparator"].isNull(), S.positive_dose(dose["value"], unit)
        ).alias("dose"), S.coding_label(r["dosage"]["route"]["coding"]).alias("route"), S.coding_label(r["dosage"]["site"]["coding"]).alias("site"),
    )
    left = marked.filter("record is null").select(*place, "resource_id", F.when(F.col("mapping").isNull(), UNMAPPED).otherwise(NOT_COMPLETE).alias("reason"))
    excluded = judged.filter("refused is not null").select(*place, "resource_id", F.col("refused").alias("reason")).unionByName(left)
    updated = r["meta"]["lastUpdated"]
    sources = typed.select(
        *place, "resource_id", F.coalesce(r["meta"]["versionId"], F.concat(F.lit("content-sha256:"), F.col("content_sha256"))).alias("version_id"),
        F.when(S.clinical_time(updated)["precision"] == "instant", updated).alias("last_updated"), "content_sha256", effective.alias("original_effective"),
    )
    return rows, excluded, sources


def source_order_reason(version: Column, updated: Column, current_version: Column, current_updated: Column) -> Column:
    """source-order where a version is not later than the current one: by number where both are numbers, else by time of update; null for the first."""
    numeric = version.rlike(r"^\d{1,38}$") & current_version.rlike(r"^\d{1,38}$")
    later = F.when(numeric, version.try_cast("decimal(38,0)") > current_version.try_cast("decimal(38,0)")).otherwise(updated > current_updated)
    return F.when(current_version.isNotNull() & ~F.coalesce(later, F.lit(False)), F.lit("source-order"))
