"""Continuity of blocks, resources of documents, and canonical digests, against plain versions."""

import datetime
import hashlib
import json
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import canonical
from tidemark.functions import scalars as S
from tidemark.operators import ingest, sessionize, signals


def told_block_by_block(rows):
    """accepted, lost, gap, jump, back and restarts of (number, index, samples, at, rate) in order of arrival."""
    seq = end = 0
    at, restarts, out = None, 1, []
    for number, index, n, t, rate in rows:
        if (seq > 0 and number <= seq) or (end > 0 and index < end):
            out.append((False, 0, 0.0, False, False, restarts))
            continue
        lost = max(0, number - seq - 1) if seq > 0 else 0
        gap = 0.0 if at is None else max(0.0, t - at - n / rate * 1000)
        jump, back = end > 0 and index != end, at is not None and t < at
        restarts += lost > 0 or jump or gap > 40
        out.append((True, lost, gap, jump, back, restarts))
        seq, end, at = number, index + n, t
    return out


@pytest.mark.parametrize("seed", range(20))
def test_continuity_of_blocks(seed):
    r = np.random.default_rng(seed)
    n = 300
    k = np.arange(n)
    number = k + np.cumsum(r.random(n) < 0.05) * 2 - np.where(r.random(n) < 0.1, 4, 0) - (3 if seed % 2 else 0)
    index = k * 480 + np.where(r.random(n) < 0.05, 100, 0) - np.where(r.random(n) < 0.08, 1200, 0) + np.where(r.random(n) < 0.01, 5000, 0)
    blocks = pd.DataFrame({"seq": number, "idx": index, "len": 480, "at": k * 10.0 + np.where(r.random(n) < 0.05, 60, 0), "rate": 48_000})
    found = sessionize._continuity(blocks, "seq", "idx", "len", "at", "rate")
    got = [tuple(x) for x in found[["accepted", "lost_before", "gap_ms", "discontinuous", "time_back", "restart_no"]].to_numpy(object).tolist()]
    assert got == told_block_by_block(blocks.to_numpy(float).tolist())
    assert 0 < found["accepted"].sum() < n


def test_a_refused_block_is_not_what_the_next_is_compared_with(spark):
    rows = [(1, 0), (2, 480), (3, 960), (2, 480), (4, 1440), (7, 2880)]
    df = spark.createDataFrame([(k, s, i, 480, k * 10.0, 48_000, 5.0 + k) for k, (s, i) in enumerate(rows)], "k int, seq long, idx long, len long, at double, rate long, late double").withColumn("s", F.lit("a"))
    assert [r.lost_before for r in sessionize.block_continuity(df, ["s"], ["k"], "seq", "idx", "len", "at", "rate").orderBy("k").collect()] == [0, 0, 0, 0, 0, 2]
    d = signals.stream_diagnostics(df, ["s"], ["k"], "seq", "idx", "len", "at", "rate", "late").first()
    assert (d.received, d.lost, d.regressions, d.max_gap_ms, d.p95_latency_ms) == (5, 2, 1, 10.0, 10.0) and d.lost_fraction == pytest.approx(2 / 7)


@pytest.mark.parametrize(
    "text,offset,precision,earliest,latest",
    [
        ("2024-03-01", None, "unknown", None, None), ("2024-03-01", "-07:00", "day", "2024-03-01T07:00:00", "2024-03-02T06:59:59.999"), ("2024-03-01", "+15:00", "unknown", None, None),
        ("2024-03-01", "Z", "unknown", None, None), ("2024-02-30", "+01:00", "unknown", None, None), ("2024-03", "+01:00", "unknown", None, None),
        ("2024-03-01T10:00:00", "+01:00", "unknown", None, None), ("2024-03-01T10:00:00+02:00", None, "instant", "2024-03-01T08:00:00", "2024-03-01T08:00:00"), (None, "+01:00", "unknown", None, None),
    ],
)
def test_clinical_times_take_no_zone_from_the_session(spark, text, offset, precision, earliest, latest):
    df = spark.createDataFrame([(text, offset)], "t string, o string")
    zone = spark.conf.get("spark.sql.session.timeZone")
    iso = lambda us: None if us is None else (datetime.datetime(1970, 1, 1) + datetime.timedelta(microseconds=us)).isoformat().replace("000", "", 1 if us % 1_000_000 else 0)
    try:
        for own in ("UTC", "America/Los_Angeles"):
            spark.conf.set("spark.sql.session.timeZone", own)
            t = S.clinical_time("t", "o")
            r = df.select(t["precision"].alias("p"), F.unix_micros(t["earliest"]).alias("a"), F.unix_micros(t["latest"]).alias("b")).first()
            as_us = lambda x: None if x is None else round((datetime.datetime.fromisoformat(x) - datetime.datetime(1970, 1, 1)).total_seconds() * 1e6)
            assert (r.p, r.a, r.b) == (precision, as_us(earliest), as_us(latest)), iso(r.a)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_no_resource_vanishes(spark):
    code = {"coding": [{"system": "u", "code": "1"}]}
    good = {"resourceType": "Procedure", "id": "p1", "status": "completed", "code": code, "subject": {"reference": "Patient/a"}, "performedDateTime": "2024-03-01"}
    documents = {
        "single": good, "bundle": {"resourceType": "Bundle", "entry": [{"resource": good}, {"resource": good | {"id": "p2", "subject": {"reference": "Patient/b"}}}, {"fullUrl": "x"}, 5]}, "empty": {"resourceType": "Bundle"},
        "typed": {"resourceType": "Bundle", "entry": [{"resource": good | {"id": 7}}, {"resource": good | {"status": {"odd": 1}}}, {"resource": {"no": "type"}}]}, "list": [good], "number": 3, "entry": {"resourceType": "Bundle", "entry": {"resource": good}},
        "modified": good | {"modifierExtension": [{"url": "x"}]},
    }
    rows = [(k, json.dumps(v)) for k, v in documents.items()] + [("broken", '{"resourceType": "Bundle", "entry": ['), ("null", None), ("blank", "")]
    resources, unread = ingest.read_resources(spark.createDataFrame(rows, "d string, payload string"), "d", "payload")
    codes = spark.createDataFrame([("u", "1", "x", "injection", 0)], "system string, code string, product string, kind string, position int")
    kept, excluded, sources = ingest.map_resources(resources, "d", codes, F.lit("Patient/a"), F.lit("+01:00"))
    assert sorted((r.d, r.position, r.reason) for r in unread.collect() if r.position is not None) == [("bundle", 2, "entry-without-resource"), ("bundle", 3, "entry-without-resource")]
    assert {r.d: r.reason for r in unread.collect() if r.position is None} == {"broken": "not-json", "null": "not-json", "blank": "not-json", "list": "not-an-object", "number": "not-an-object", "entry": "entry-is-not-a-list"}
    assert sorted((r.d, r.position, r.status, r.effective.precision) for r in kept.collect()) == [("bundle", 0, "administered", "day"), ("single", 0, "administered", "day"), ("typed", 0, "administered", "day")]
    assert sorted((r.d, r.position, r.reason) for r in excluded.collect()) == [
        ("bundle", 1, "fhir-patient-mismatch"), ("modified", 0, "fhir-unsupported-modifier"), ("typed", 1, "administration-not-confirmed-complete"), ("typed", 2, "unsupported-resource-type"),
    ]
    assert len({r.content_sha256 for r in sources.filter("d in ('single', 'bundle')").collect()}) == 1 and all(r.version_id == f"content-sha256:{r.content_sha256}" for r in sources.collect())


def plain(value, without=()):
    """Canonical JSON, told recursively."""
    if isinstance(value, T.Row):
        value = value.asDict()
    if value is None or (isinstance(value, float) and not math.isfinite(value)):
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(str(k), ensure_ascii=False)}:{plain(v, without)}" for k, v in sorted(value.items(), key=lambda e: str(e[0])) if k not in without) + "}"
    if isinstance(value, list):
        return "[" + ",".join(plain(v, without) for v in value) + "]"
    if isinstance(value, float):
        return number(value)
    if isinstance(value, datetime.datetime):
        return '"' + value.strftime("%Y-%m-%dT%H:%M:%S.") + f"{value.microsecond // 1000:03d}Z" + '"'
    return str(value) if isinstance(value, int) else json.dumps(str(value), ensure_ascii=False)


def number(x):
    """As ECMAScript writes it."""
    if x == 0:
        return "0"
    sign, digits = "-" * (x < 0), repr(abs(x))
    mantissa, _, exponent = digits.partition("e")
    whole, _, part = mantissa.partition(".")
    part = "" if part == "0" else part
    point = len(whole) + int(exponent or 0)
    all_digits = (whole + part).lstrip("0")
    point -= len(whole + part) - len((whole + part).lstrip("0"))
    all_digits = all_digits.rstrip("0") or "0"
    n = len(all_digits)
    if n <= point <= 21:
        return sign + all_digits + "0" * (point - n)
    if 0 < point <= 21:
        return sign + all_digits[:point] + "." + all_digits[point:]
    if -6 < point <= 0:
        return sign + "0." + "0" * -point + all_digits
    e = point - 1
    return sign + all_digits[0] + ("." + all_digits[1:] if n > 1 else "") + f"e{'+' if e > 0 else '-'}{abs(e)}"


def test_numbers_are_written_as_they_are_read(spark):
    r = random.Random(4)
    values = [0.0, -0.0, 1.0, -1.0, 0.1, 1e-6, 1e-7, 1.5e-7, 123456789.25, 1e20, 1e21, 1.5e22, 123456789012345680000.0, 2.0**53, 1.7976931348623157e308, float("nan"), float("inf"), 100.0, 1e15 + 0.5]
    values += [r.uniform(-1, 1) * 10.0 ** r.randint(-12, 25) for _ in range(500)]
    found = spark.createDataFrame([(v,) for v in values], "x double").select("x", canonical.canonical(F.col("x"), T.DoubleType()).alias("t")).collect()
    for x in found:
        if x.t != plain(x.x):  # the JVM has given more digits than are needed
            assert x.t != "null" and float(x.t) == x.x and ("e" in x.t) == (not 1e-6 <= abs(x.x) < 1e21) and not x.t.endswith(".0"), x
    assert sum(x.t == plain(x.x) for x in found) > 0.8 * len(found)


NESTED = "b string, a struct<z: double, y: array<struct<k: int, recordedAt: timestamp, d: double>>>, m map<string, struct<q: boolean, recordedAt: string>>, `odd \"name` long, recordedAt string"


def test_nested_values(spark):
    at = datetime.datetime(2024, 1, 2, 3, 4, 5, 678000)
    rows = [
        ("x\"\\\n é", (1.0, [(1, at, 0.5), None, (None, None, None)]), {"b": (True, "t"), "a": None, "é": (None, None)}, 7, "now"), (None, None, None, None, None), ("", (None, []), {}, 0, ""),
    ]
    df = spark.createDataFrame(rows, NESTED)
    again = df.select("recordedAt", "m", '`odd "name`', "a", "b")
    for without in ((), ("recordedAt",)):
        wanted = [plain(r, without) for r in df.collect()]
        for one in (df, again):
            found = one.select(canonical.canonical_row(one, without=without).alias("t"), canonical.row_digest(one, without=without).alias("h")).collect()
            assert [r.t for r in found] == wanted and [r.h for r in found] == [hashlib.sha256(w.encode()).hexdigest() for w in wanted]


def test_fixed_fields_of_inputs_and_reviews(spark):
    kinds = "kind string, logicalId string, replacesRecordId string, payload struct<v: double, a: string>, sourceProvenance struct<system: string>, recordedAt string, tenantId string"
    df = spark.createDataFrame([("k", "l", None, (1.0, "x"), None, "now", "t"), ("k", "l", None, (1.0, "x"), None, "later", "u")], kinds)
    hashes = {r.h for r in df.select(canonical.input_digest(df).alias("h")).collect()}
    assert hashes == {hashlib.sha256(b'{"kind":"k","logicalId":"l","payload":{"a":"x","v":1},"replacesRecordId":null,"sourceProvenance":null}').hexdigest()}
    reviews = spark.createDataFrame([(("r1", "now", "ok", ("deep", 1)),), (("r2", "later", "ok", ("deep", 1)),)], "payload struct<reviewId: string, recordedAt: string, verdict: string, note: struct<recordedAt: string, n: int>>")
    hashes = {r.h for r in reviews.select(canonical.review_digest(reviews).alias("h")).collect()}
    assert hashes == {hashlib.sha256(b'{"note":{"n":1,"recordedAt":"deep"},"verdict":"ok"}').hexdigest()}


def test_json_digests_know_no_order(spark):
    texts = ['{"a": 1, "b": {"d": [1, 2], "c": null}}', '{"b": {"c": null, "d": [1, 2]}, "a": 1}', '{"a": 1, "b": {"d": [2, 1], "c": null}}', "no"]
    found = [r.h for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(canonical.json_digest(F.col("t")).alias("h")).collect()]
    assert found[0] == found[1] != found[2] and found[3] is None
