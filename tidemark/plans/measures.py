"""Queries over all tables: geometry, signals, registries, validity, identities, clocks, coded resources, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import assembly, geometry, governance, history, ingest, provenance, signals
from ..sources import schemas
from ..sources.scratch import dealt, materialize, shared_folder
from .catalog import query, table
from .histories import ORDERS, orders
from .signals import events


@query(
    "pooled_embeddings",
    "WITH l AS (SELECT label, unnest(range(0, len(embedding))) AS dimension, unnest(embedding) AS x FROM embeddings) SELECT label, CAST(dimension AS INT) AS dimension, count(*) AS n, round(avg(x::DOUBLE), 6) AS mean_value, round(stddev_pop(x::DOUBLE), 6) AS sd_value FROM l GROUP BY label, dimension",
)
def pooled_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.pooled(table(spark, sf_dir, "embeddings"), ["label"], "embedding").select(
        "label", "dimension", "n", F.round("mean_value", 6).alias("mean_value"), F.round("sd_value", 6).alias("sd_value")
    )


def landmark_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 32 landmarks: neighbouring components, from -1..1 to 0..1."""
    x = lambda k: (F.get("embedding", k).cast("double") + 1) / 2
    points = F.transform(F.sequence(F.lit(0), F.lit(62), F.lit(2)), lambda k: F.struct(x(k).alias("x"), x(k + 1).alias("y")))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", points.alias("points"))


POINTS = "p AS (SELECT vec_id, label, list_transform(range(0, 32), lambda k: (embedding[2 * k + 1]::DOUBLE + 1) / 2) AS xs, list_transform(range(0, 32), lambda k: (embedding[2 * k + 2]::DOUBLE + 1) / 2) AS ys FROM embeddings)"
#: A layout of the few landmarks of landmark_rows.
SMALL_LAYOUT = {
    "left_eye": {"canthi": (0, 1), "lids": ((2, 3), (4, 5))}, "right_eye": {"canthi": (6, 7), "lids": ((8, 9), (10, 11))}, "left_brow": (12, 13, 14),
    "left_corner": 15, "right_corner": 16, "upper_lip": 17, "lower_lip": 18, "movement": (0, 1, 6, 7, 15, 16)
}


@query(
    "landmark_boxes",
    f"WITH {POINTS} SELECT vec_id, round(list_min(xs), 6) AS x, round(list_min(ys), 6) AS y, round((list_max(xs) - list_min(xs)) * 640, 4) AS width_pixels, round((list_max(ys) - list_min(ys)) * 480, 4) AS height_pixels, round(least(list_min(xs), list_min(ys), 1 - list_max(xs), 1 - list_max(ys)), 6) AS edge_margin FROM p"
)
def landmark_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("box")
    boxed = landmark_rows(spark, sf_dir).withColumn("box", geometry.Face("points", F.lit(640.0), F.lit(480.0)).bounding_box())
    return boxed.select(
        "vec_id", F.round(b["x"], 6).alias("x"), F.round(b["y"], 6).alias("y"), F.round(b["width_pixels"], 4).alias("width_pixels"),
        F.round(b["height_pixels"], 4).alias("height_pixels"), F.round(b["edge_margin_fraction"], 6).alias("edge_margin")
    )


def _d(a: int, b: int) -> str:
    return f"sqrt(((xs[{a + 1}] - xs[{b + 1}]) * 640) ** 2 + ((ys[{a + 1}] - ys[{b + 1}]) * 480) ** 2)"


@query(
    "face_geometry",
    f"""WITH {POINTS}, s AS (SELECT *, 640 * (xs[1] + xs[2]) / 2 AS lx, 480 * (ys[1] + ys[2]) / 2 AS ly, 640 * (xs[7] + xs[8]) / 2 AS rx, 480 * (ys[7] + ys[8]) / 2 AS ry FROM p),
t AS (SELECT *, sqrt((lx - rx) ** 2 + (ly - ry) ** 2) AS scale, atan2(ly - ry, lx - rx) AS angle, (lx + rx) / 2 AS cx, (ly + ry) / 2 AS cy FROM s)
SELECT vec_id, round(scale, 4) AS scale, round(angle, 6) AS angle, round(({_d(2, 3)} + {_d(4, 5)}) / 2 / {_d(0, 1)}, 5) AS left_aperture, round({_d(17, 18)} / {_d(15, 16)}, 5) AS mouth_aperture,
  round(((cos(angle) * (640 * xs[16] - cx) + sin(angle) * (480 * ys[16] - cy)) + (cos(angle) * (640 * xs[17] - cx) + sin(angle) * (480 * ys[17] - cy))) / 2 / scale, 5) AS midline_offset,
  round(-((cos(angle) * (480 * ys[13] - cy) - sin(angle) * (640 * xs[13] - cx)) + (cos(angle) * (480 * ys[14] - cy) - sin(angle) * (640 * xs[14] - cx)) + (cos(angle) * (480 * ys[15] - cy) - sin(angle) * (640 * xs[15] - cx))) / 3 / scale, 5) AS brow_height FROM t""",
)
def face_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    face = geometry.Face("points", F.lit(640.0), F.lit(480.0), SMALL_LAYOUT)
    s = F.col("system")
    r = lambda c, n: F.round(c, n)
    return landmark_rows(spark, sf_dir).withColumn("system", face.system()).select(
        "vec_id", r(s["scale"], 4).alias("scale"), r(s["angle"], 6).alias("angle"), r(face.eye_aperture("left_eye"), 5).alias("left_aperture"), r(face.mouth_aperture(), 5).alias("mouth_aperture"), r(face.mouth_midline_offset(s), 5).alias("midline_offset"), r(face.brow_height("left_brow", s), 5).alias("brow_height")
    )


@query(
    "movement_speeds",
    f"""WITH {POINTS}, s AS (SELECT *, 640 * (xs[1] + xs[2]) / 2 AS lx, 480 * (ys[1] + ys[2]) / 2 AS ly, 640 * (xs[7] + xs[8]) / 2 AS rx, 480 * (ys[7] + ys[8]) / 2 AS ry FROM p),
t AS (SELECT *, sqrt((lx - rx) ** 2 + (ly - ry) ** 2) AS scale, atan2(ly - ry, lx - rx) AS angle, (lx + rx) / 2 AS cx, (ly + ry) / 2 AS cy FROM s), i AS (SELECT *, unnest([1, 2, 7, 8, 16, 17]) AS k FROM t),
n AS (SELECT vec_id, label, k, (cos(angle) * (640 * xs[k] - cx) + sin(angle) * (480 * ys[k] - cy)) / scale AS x, (cos(angle) * (480 * ys[k] - cy) - sin(angle) * (640 * xs[k] - cx)) / scale AS y FROM i),
m AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(vec_id) OVER w AS pv FROM n WINDOW w AS (PARTITION BY label, k ORDER BY vec_id)) SELECT vec_id, label, round(avg(sqrt((x - px) ** 2 + (y - py) ** 2)) / any_value((vec_id - pv) * 10 / 1000.0), 5) AS speed FROM m GROUP BY vec_id, label""",
)
def movement_speeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Movement of the normalised points from one vector of a label to the next, a time step of ten each."""
    face = geometry.Face("points", F.lit(640.0), F.lit(480.0), SMALL_LAYOUT)
    rows = landmark_rows(spark, sf_dir).withColumn("system", face.system()).withColumns({"moved": face.movement_points(F.col("system")), "at_ms": F.col("vec_id") * 10.0})
    return geometry.movement_speed(rows, ["label"], ["vec_id"], "moved", "at_ms").select("vec_id", "label", F.round("regional_movement_speed", 5).alias("speed"))


@query(
    "sample_levels",
    "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE)) / len(embedding)), 6) AS rms, round(list_sum(list_transform(embedding, lambda v: v::DOUBLE)) / len(embedding), 6) AS dc_offset, round(len(list_filter(embedding, lambda v: abs(v::DOUBLE) >= 0.25)) / len(embedding), 6) AS clipped_fraction FROM embeddings",
)
def sample_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = signals.block_levels("embedding", 0.25)
    return table(spark, sf_dir, "embeddings").select("vec_id", *[F.round(c, 6).alias(name) for name, c in levels.items()])


@query(
    "spectral_flux",
    """WITH w AS (SELECT vec_id, label, list_transform(embedding, lambda v: abs(v::DOUBLE)) AS b FROM embeddings), v AS (SELECT *, lag(b) OVER (PARTITION BY label ORDER BY vec_id) AS a FROM w)
SELECT vec_id, label, CASE WHEN a IS NULL THEN 0.0 ELSE round(sqrt(list_sum(list_transform(range(1, len(b) + 1), lambda i: greatest(ln(1 + b[i]) - ln(1 + a[i]), 0) ** 2)) / len(b)), 6) END AS spectral_flux FROM v""",
)
def spectral_flux(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: F.abs(v.cast("double"))).alias("bands"))
    return signals.spectral_flux(bands, ["label"], ["vec_id"], "bands").select("vec_id", "label", F.round("spectral_flux", 6).alias("spectral_flux"))


@query(
    "encoded_windows",
    """WITH k AS (SELECT unnest(range(0, 33)) AS k), p AS (SELECT vec_id, label, k,
  (list_sum(list_transform(range(0, 64), lambda i: embedding[i + 1]::DOUBLE * cos(2 * pi() * k * i / 64))) ** 2 + list_sum(list_transform(range(0, 64), lambda i: embedding[i + 1]::DOUBLE * sin(2 * pi() * k * i / 64))) ** 2) / 64 AS power FROM embeddings CROSS JOIN k WHERE embedding IS NOT NULL),
b AS (SELECT vec_id, label, CASE WHEN k < 5 THEN 0 ELSE 1 + (k - 5) // 4 END AS d, ln(1 + avg(power)) AS x FROM p GROUP BY ALL) SELECT label, CAST(d AS INT) AS dimension, round(avg(x), 4) AS mean_value, count(*) AS n FROM b GROUP BY label, d""",
)
def encoded_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as windows of 64 samples, encoded by the power of eight bands and pooled by label."""
    vectors = signals.encoded(table(spark, sf_dir, "embeddings"), "embedding", signals.band_encoder(8))
    return signals.pooled(vectors, ["label"], "vector").select("label", "dimension", F.round("mean_value", 4).alias("mean_value"), "n")


@query(
    "signal_to_noise",
    "SELECT event_id, round(CASE WHEN event_id % 9 = 0 THEN NULL ELSE greatest(20 * log10(greatest(value / 1000, 1e-12) / greatest(0.0001, event_id % 7 / 1000.0)), 0) END, 6) AS snr_db FROM events",
)
def signal_to_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels over noise floors, some of them 0, some not known."""
    e = F.col("event_id")
    floor = F.when(e % 9 == 0, F.lit(float("nan"))).otherwise((e % 7) / 1000.0)
    return events(spark, sf_dir).select("event_id", F.round(S.decibels_over(F.col("value") / 1000, floor), 6).alias("snr_db"))


_EYES = {**SMALL_LAYOUT, "left_iris": {"centre": 19, "ring": (20, 21, 22, 23)}}
_AXES = f"""s AS (SELECT *, 640 * (xs[1] + xs[2]) / 2 AS lx, 480 * (ys[1] + ys[2]) / 2 AS ly, 640 * (xs[7] + xs[8]) / 2 AS rx, 480 * (ys[7] + ys[8]) / 2 AS ry FROM p),
t AS (SELECT *, sqrt((lx - rx) ** 2 + (ly - ry) ** 2) AS scale, atan2(ly - ry, lx - rx) AS angle, (lx + rx) / 2 AS cx, (ly + ry) / 2 AS cy, ({_d(2, 3)} + {_d(4, 5)}) / 2 AS lid FROM s)"""


def _nx(k: int) -> str:
    return f"(cos(angle) * (640 * xs[{k + 1}] - cx) + sin(angle) * (480 * ys[{k + 1}] - cy)) / scale"


def _ny(k: int) -> str:
    return f"(cos(angle) * (480 * ys[{k + 1}] - cy) - sin(angle) * (640 * xs[{k + 1}] - cx)) / scale"


@query(
    "eye_openings",
    f"""WITH {POINTS}, {_AXES} SELECT vec_id, round({_d(0, 1)} / scale, 5) AS width, round(lid / scale, 5) AS height, round(2 * ({_d(19, 20)} + {_d(19, 21)} + {_d(19, 22)} + {_d(19, 23)}) / 4 / scale, 5) AS iris_diameter,
  round({_nx(19)} - ({_nx(0)} + {_nx(1)}) / 2, 5) AS gaze_x, round({_ny(19)} - ({_ny(0)} + {_ny(1)}) / 2, 5) AS gaze_y FROM t""",
)
def eye_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The left eye's opening, and its iris by diameter and place."""
    face, s = geometry.Face("points", F.lit(640.0), F.lit(480.0), _EYES), F.col("system")
    f, i = F.col("fissure"), F.col("iris")
    rows = landmark_rows(spark, sf_dir).withColumn("system", face.system()).withColumns({"fissure": face.fissure("left_eye", s), "iris": face.iris("left", s)})
    named = {"width": f["width"], "height": f["height"], "iris_diameter": i["diameter"], "gaze_x": i["gaze_x"], "gaze_y": i["gaze_y"]}
    return rows.select("vec_id", *[F.round(c, 5).alias(n) for n, c in named.items()])


@query(
    "head_poses",
    "SELECT event_id, round(value % 160 - 80, 4) AS yaw, round(value * 7 % 170 - 85, 4) AS pitch, round(value * 13 % 170 - 85, 4) AS roll FROM events",
)
def head_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transforms that values set, scaled, taken back to their angles."""
    v = F.col("value")
    a, b, c = (F.radians(x) for x in (v * 7 % 170 - 85, v % 160 - 80, v * 13 % 170 - 85))
    cos, sin = F.cos, F.sin
    rows = [
        [cos(c) * cos(b), cos(c) * sin(b) * sin(a) - sin(c) * cos(a), cos(c) * sin(b) * cos(a) + sin(c) * sin(a)], [sin(c) * cos(b), sin(c) * sin(b) * sin(a) + cos(c) * cos(a), sin(c) * sin(b) * cos(a) - cos(c) * sin(a)],
        [-sin(b), cos(b) * sin(a), cos(b) * cos(a)],
    ]
    size, none = 1 + F.col("event_id") % 3, F.lit(0.0)
    matrix = F.array(*[x for k in range(3) for x in (*[rows[r][k] * size for r in range(3)], none)], none, none, none, F.lit(1.0))
    posed = events(spark, sf_dir).select("event_id", matrix.alias("m")).withColumn("pose", geometry.pose("m"))
    return posed.select("event_id", *[F.round(F.col("pose")[f"{n}_degrees"], 4).alias(n) for n in ("yaw", "pitch", "roll")])


@query(
    "finite_facts",
    "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END + CASE WHEN event_id % 4 = 0 THEN 0 ELSE 1 END + 1 AS facts, CASE WHEN event_id % 3 <> 0 THEN value END AS level FROM events",
)
def finite_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of a record, those that are finite alone."""
    e = F.col("event_id")
    rows = events(spark, sf_dir).select("event_id", F.when(e % 3 != 0, F.col("value")).otherwise(F.lit(float("nan"))).alias("level"), F.when(e % 4 != 0, e).alias("count"), F.lit(1.0).alias("one"))
    facts = assembly.quality_facts(["level", "count", "one"])
    return rows.select("event_id", F.size(facts).alias("facts"), F.try_element_at(facts, F.lit("level")).alias("level"))


@query(
    "appended_once",
    "SELECT event_type AS kind, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events WHERE event_id % 10 < 8 GROUP BY event_type",
)
def appended_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping appends to one path, each twice; every key is there once."""
    path = f"{shared_folder(spark)}/log"
    rows = events(spark, sf_dir).select("event_id", F.col("event_type").alias("kind"))
    for part in ("event_id % 10 < 5", "event_id % 10 BETWEEN 3 AND 7", "event_id % 10 < 5"):
        schemas.append_once(rows.filter(part), path, ["event_id"], ["kind"])
    return spark.read.parquet(path).groupBy("kind").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query(
    "published_runs",
    "SELECT c_custkey::VARCHAR AS episode_id, c_custkey % 3 AS input_revision, '2' AS engine_version FROM customer UNION ALL SELECT c_custkey::VARCHAR, c_custkey % 3, '1' FROM customer WHERE c_custkey % 2 = 0",
)
def published_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of three revisions by two engines, some published again: those that are current, once an engine."""
    k = F.col("c_custkey")
    customers = table(spark, sf_dir, "customer")
    runs = customers.select(k.cast("string").alias("episode_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("input_revision"))
    now, path = customers.select(k.cast("string").alias("episode_id"), (k % 3).alias("revision")), f"{shared_folder(spark)}/runs"
    for engine, part in (("1", runs.filter("cast(episode_id AS long) % 2 = 0")), ("2", runs), ("1", runs.filter("cast(episode_id AS long) % 4 = 0"))):
        schemas.publish_runs(part, path, engine, now)
    return spark.read.schema("episode_id string, input_revision long, engine_version string").parquet(path)


@query("pitch_of_blocks")
def pitch_of_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pitch of 800-sample tones whose frequency each event's value sets."""
    turn = 2 * 3.141592653589793 * (80 + F.col("value") % 300)
    tones = dealt(events(spark, sf_dir).select("event_id", "value"), "event_id").select(  # as files are cut, a large one may be a single task
        "event_id", F.transform(F.array_repeat(turn, 800), lambda turned, k: F.sin(turned * k / 8000)).alias("samples"), F.lit(8000.0).alias("rate")
    )
    p = F.col("pitch")
    return signals.with_pitch(tones, "samples", "rate").select("event_id", F.round(p["hz"], 3).alias("hz"), F.round(p["agreement"], 4).alias("agreement"))


_HZ, _BLOCK = 48_000, 480


def audio_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as ten-millisecond blocks of samples: some lost, some back in number or samples, some with a jump or a gap in time."""
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    whole, at = F.floor("value"), F.col("k")
    return events(spark, sf_dir).withColumn("k", k).select(
        "user_id", "event_id", "value", (at + F.expr("k div 10") - F.when(whole % 7 == 0, 3).otherwise(0)).cast("long").alias("seq"),
        (at * _BLOCK + F.when(whole % 11 == 0, 100).otherwise(0) - F.when(whole % 13 == 0, 2 * _BLOCK).otherwise(0)).cast("long").alias("idx"), F.lit(_BLOCK).cast("long").alias("len"),
        (at * 10.0 + F.when(whole % 17 == 0, 60.0).otherwise(0.0)).alias("at_ms"), F.lit(_HZ).cast("long").alias("rate"),
    )


#: The rule told block by block: what counts is the last accepted block.
BLOCKS_SQL = f"""WITH RECURSIVE b AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, CAST(floor(value) AS BIGINT) AS w FROM events),
e AS (SELECT user_id, event_id, value, k, k + k // 10 - CASE WHEN w % 7 = 0 THEN 3 ELSE 0 END AS seq, k * {_BLOCK} + CASE WHEN w % 11 = 0 THEN 100 ELSE 0 END - CASE WHEN w % 13 = 0 THEN {2 * _BLOCK} ELSE 0 END AS idx, k * 10.0::DOUBLE + CASE WHEN w % 17 = 0 THEN 60 ELSE 0 END AS t FROM b),
c AS (SELECT user_id, k, true AS ok, seq AS last_seq, idx + {_BLOCK} AS last_end, t AS last_at, 0::BIGINT AS lost, 0::DOUBLE AS gap, false AS jump, false AS back, 1::BIGINT AS restart FROM e WHERE k = 1 UNION ALL
  SELECT e.user_id, e.k, o.ok, CASE WHEN o.ok THEN e.seq ELSE last_seq END, CASE WHEN o.ok THEN e.idx + {_BLOCK} ELSE last_end END, CASE WHEN o.ok THEN e.t ELSE last_at END,
    CASE WHEN o.ok AND last_seq > 0 THEN greatest(0, e.seq - last_seq - 1) ELSE 0 END, CASE WHEN o.ok THEN greatest(0, e.t - last_at - 10) ELSE 0 END, o.ok AND last_end > 0 AND e.idx <> last_end, o.ok AND e.t < last_at,
    restart + CASE WHEN o.ok AND ((last_seq > 0 AND e.seq - last_seq > 1) OR (last_end > 0 AND e.idx <> last_end) OR e.t - last_at - 10 > 40) THEN 1 ELSE 0 END
  FROM c JOIN e ON e.user_id = c.user_id AND e.k = c.k + 1, LATERAL (SELECT NOT (last_seq > 0 AND e.seq <= last_seq) AND NOT (last_end > 0 AND e.idx < last_end) AS ok) o)"""


@query(
    "stream_diagnostics",
    f"""{BLOCKS_SQL}, l AS (SELECT c.user_id, value, row_number() OVER (PARTITION BY c.user_id ORDER BY c.k DESC) AS n FROM c JOIN e USING (user_id, k) WHERE ok),
p AS (SELECT user_id, list_sort(list(value)) AS v FROM l WHERE n <= 500 GROUP BY user_id), d AS (SELECT user_id, count(*) FILTER (ok) AS received, CAST(sum(lost) AS BIGINT) AS lost, max(gap) AS max_gap_ms, count(*) FILTER (NOT ok OR back) AS regressions FROM c GROUP BY user_id)
SELECT user_id, received, lost, round(lost / greatest(1, received + lost), 9) AS lost_fraction, max_gap_ms, regressions, v[1 + least(len(v) - 1, CAST(floor(len(v) * 0.95) AS BIGINT))] AS p95_latency_ms FROM d JOIN p USING (user_id)""",
)
def stream_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = signals.stream_diagnostics(audio_blocks(spark, sf_dir), ["user_id"], ["event_id"], "seq", "idx", "len", "at_ms", "rate", "value")
    return d.withColumn("lost_fraction", F.round("lost_fraction", 9))


TYPES = ["click", "view", "purchase", "signup", "error"]


@query(
    "registry_completion",
    f"""WITH d AS (SELECT user_id, event_type, date_trunc('day', ts) AS day FROM events), r AS (SELECT unnest({TYPES}) AS event_type), o AS (SELECT DISTINCT user_id, day FROM d),
c AS (SELECT o.user_id, r.event_type, o.day, count(d.user_id) AS n FROM o CROSS JOIN r LEFT JOIN d ON d.user_id = o.user_id AND d.day = o.day AND d.event_type = r.event_type GROUP BY ALL)
SELECT user_id, epoch_us(day) AS day_us, event_type, n, CASE WHEN n = 0 THEN 'missing' WHEN n > 1 THEN 'repeated' END AS problem FROM c""",
)
def registry_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("day_us", F.col("us") - F.col("us") % history.DAY_US)
    registry = spark.createDataFrame([(t,) for t in TYPES], "event_type string")
    return governance.completed(e, e, registry, ["user_id", "day_us"], "event_type")


@query("unregistered_events", f"SELECT event_type, count(*) AS n FROM events WHERE event_type NOT IN ({', '.join(repr(t) for t in TYPES[:3])}) GROUP BY event_type")
def unregistered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = spark.createDataFrame([(t,) for t in TYPES[:3]], "event_type string")
    return governance.unregistered(events(spark, sf_dir), registry, "event_type").groupBy("event_type").agg(F.count("*").alias("n"))


DAY = history.DAY_US
AS_OF = 883_612_800_000_000  # 1998-01-01


@query(
    "consent_applicability",
    f"""WITH {ORDERS}, c AS (SELECT c_custkey, epoch_us(TIMESTAMP '1993-01-01') + (c_custkey % 900) * {DAY} AS granted, CASE WHEN c_custkey % 7 = 0 THEN epoch_us(TIMESTAMP '1997-01-01') END AS withdrawn, CASE WHEN c_custkey % 5 = 0 THEN epoch_us(TIMESTAMP '1999-01-01') END AS expires, c_acctbal > 0 AS face FROM customer WHERE c_custkey % 11 <> 0),
j AS (SELECT o.*, c.* FROM o LEFT JOIN c ON o.o_custkey = c.c_custkey),
r AS (SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN 'consent-missing' WHEN NOT (CASE WHEN o_orderstatus = 'F' THEN face ELSE true END) OR granted > us OR coalesce(withdrawn <= {AS_OF}, false) OR coalesce(expires <= greatest(us + {DAY}, {AS_OF}), false) THEN 'consent-not-applicable' END AS reason FROM j)
SELECT coalesce(reason, 'applicable') AS result, count(*) AS n FROM r GROUP BY ALL""",
)
def consent_applicability(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    start = lambda d: F.unix_micros(F.lit(d).cast("timestamp"))
    consents = table(spark, sf_dir, "customer").filter("c_custkey % 11 <> 0").select(
        key.alias("c_consent_id"), *[F.lit(True).alias(p) for p in ("capture", "derived_analysis", "derived_retention")], (start("1993-01-01") + key % 900 * DAY).alias("granted_at"),
        F.when(key % 7 == 0, start("1997-01-01")).alias("withdrawn_at"), F.when(key % 5 == 0, start("1999-01-01")).alias("expires_at"), F.when(
            F.col("c_acctbal") > 0, F.array(F.lit("face"), F.lit("voice"))
        ).otherwise(F.array(F.lit("voice"))).alias("modalities"),
    )
    joined = orders(spark, sf_dir).withColumn("modality", F.when(F.col("o_orderstatus") == "F", "face").otherwise("voice")).join(consents, F.col("o_custkey") == F.col("c_consent_id"), "left")
    listed = S.reasons(history.consent_reasons(F.col("modality"), F.col("us"), F.col("us") + DAY, F.lit(AS_OF)))
    return joined.groupBy(F.coalesce(F.get(listed, F.lit(0)), F.lit("applicable")).alias("result")).agg(F.count("*").alias("n"))


@query(
    "retention_sweep",
    """SELECT d.doc_id, concat_ws(',', CASE WHEN l.doc_id IS NULL THEN 'consent-missing' END, CASE WHEN l.doc_id IS NOT NULL AND NOT (l.quality = 1 AND l.toxic = 0) THEN 'consent-not-valid' END, CASE WHEN d.n_chars % 10 = 0 THEN 'capture-outside-source' END) AS reasons
FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL OR NOT (l.quality = 1 AND l.toxic = 0) OR d.n_chars % 10 = 0""",
)
def retention_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as clips, labels as their consents: quality grants, toxicity withdraws."""
    f = F.lit
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", f("available").alias("status"), f(0).alias("created_at"), f(1000).alias("expires_at"), f(10).alias("captured_at"),
        F.when(F.col("n_chars") % 10 == 0, 5).otherwise(20).alias("ended_at"), f(0).alias("o_started_at"), f(100).alias("o_ended_at")
    )
    consents = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("k_id"), (F.col("quality") == 1).alias("k_retain"), F.when(F.col("toxic") == 1, 50).alias("k_withdrawn_at"),
        f(0).alias("k_valid_from"), f(2000).alias("k_valid_until")
    )
    swept = governance.to_delete(docs.join(consents, F.col("doc_id") == F.col("k_id"), "left"), F.lit(500), F.lit(5000))
    return swept.select("doc_id", F.array_join("reasons", ",").alias("reasons"))


@query("order_identities", "SELECT o_orderkey, substr(sha256(concat(length(o_orderkey::VARCHAR), ':', o_orderkey, '|', length(o_orderpriority), ':', o_orderpriority)), 1, 24) AS identity FROM orders")
def order_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.substring(S.identity("x", "o_orderkey", "o_orderpriority"), 3, 24).alias("identity"))


@query(
    "clinical_times",
    """WITH t AS (SELECT o_orderkey, o_orderkey % 5 AS k, o_orderkey % 3 AS z, epoch_us(date_trunc('day', o_orderdate)) AS day FROM orders)
SELECT o_orderkey, CASE WHEN k = 0 AND z < 2 THEN 'day' WHEN k IN (1, 3) THEN 'instant' ELSE 'unknown' END AS precision, CASE WHEN k = 0 AND z < 2 THEN day + CASE z WHEN 0 THEN 7 ELSE -5 END * 3600000000 WHEN k = 1 THEN day + 37800000000 WHEN k = 3 THEN day + 30600000000 END AS earliest_us,
  CASE WHEN k = 0 AND z < 2 THEN day + CASE z WHEN 0 THEN 7 ELSE -5 END * 3600000000 + 86399999000 WHEN k = 1 THEN day + 37800000000 WHEN k = 3 THEN day + 30600000000 END AS latest_us FROM t""",
)
def clinical_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days at offsets that some rows give, instants, months and nulls."""
    k, date = F.col("o_orderkey") % 5, lambda p: F.date_format("o_orderdate", p)
    at = lambda time: F.concat(date("yyyy-MM-dd"), F.lit(time))
    text = F.when(k == 0, date("yyyy-MM-dd")).when(k == 1, at("T10:30:00Z")).when(k == 2, date("yyyy-MM")).when(k == 3, at("T10:30:00.000+02:00"))
    offset = F.when(F.col("o_orderkey") % 3 == 0, "-07:00").when(F.col("o_orderkey") % 3 == 1, "+05:00")
    t = F.col("t")
    return table(spark, sf_dir, "orders").withColumn("t", S.clinical_time(text, offset)).select(
        "o_orderkey", t["precision"].alias("precision"), F.unix_micros(t["earliest"]).alias("earliest_us"), F.unix_micros(t["latest"]).alias("latest_us")
    )


@query(
    "clock_selection",
    """WITH c AS (SELECT user_id, event_id, value % 10 AS off, 5 + value % 7 AS unc FROM events), g AS (SELECT user_id, max(off - unc) AS lo, min(off + unc) AS hi, min_by(event_id, struct_pack(a := unc, b := event_id)) AS best FROM c GROUP BY user_id)
SELECT user_id, CASE WHEN lo > hi THEN 'inconsistent' ELSE 'selected' END AS result, CASE WHEN lo <= hi THEN best END AS best_event FROM g""",
)
def clock_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as clock calibrations: overlapping bounds, then the least uncertain."""
    c = events(spark, sf_dir).withColumns({"offset_ms": F.col("value") % 10, "uncertainty_ms": 5 + F.col("value") % 7})
    g = c.groupBy("user_id").agg(
        F.max(F.col("offset_ms") - F.col("uncertainty_ms")).alias("low"), F.min(F.col("offset_ms") + F.col("uncertainty_ms")).alias("high"),
        F.min_by("event_id", F.struct("uncertainty_ms", "event_id")).alias("best")
    )
    sound = F.col("low") <= F.col("high")
    return g.select("user_id", F.when(sound, "selected").otherwise("inconsistent").alias("result"), F.when(sound, F.col("best")).alias("best_event"))


_TYPES_SQL = "['MedicationAdministration', 'MedicationRequest', 'MedicationStatement', 'Procedure', 'Observation']"
_CODED_SQL = f"""WITH r AS (SELECT o_orderkey, o_custkey, {_TYPES_SQL}[1 + o_orderkey % 5] AS type, CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderkey % 13 = 0 THEN 'entered-in-error' ELSE 'in-progress' END AS status, o_orderpriority IN ('1-URGENT', '2-HIGH') AS mapped FROM orders),
j AS (SELECT *, type IN ('MedicationAdministration', 'Procedure') AND status = 'completed' AS done, status = 'entered-in-error' AS err,
  CASE WHEN o_orderkey % 29 = 1 THEN 'not-json' WHEN o_orderkey % 31 = 1 THEN 'entry-without-resource' WHEN o_orderkey % 37 = 1 THEN 'not-an-object' WHEN o_orderkey % 43 = 1 THEN 'entry-is-not-a-list' END AS unread FROM r),
k AS (SELECT *, CASE WHEN type = 'Observation' THEN 'unsupported-resource-type' WHEN o_orderkey % 47 = 1 THEN 'fhir-resource-id' WHEN o_custkey % 19 = 0 THEN 'fhir-patient-mismatch' WHEN o_orderkey % 41 = 1 THEN 'fhir-unsupported-modifier' END AS refused,
  CASE WHEN mapped AND (done OR err OR type = 'MedicationRequest') THEN 'treatment' WHEN type = 'MedicationStatement' OR (type = 'Procedure' AND (done OR err)) THEN 'context' END AS kept FROM j),
o AS (SELECT *, CASE WHEN unread IS NOT NULL THEN 'unread' WHEN refused IS NOT NULL OR kept IS NULL THEN 'excluded' ELSE kept END AS record FROM k)"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as JSON documents of one coded resource each, some in bundles, some alone, some that cannot be read."""
    k = F.col("o_orderkey")
    kinds = F.array(*[F.lit(t) for t in ("MedicationAdministration", "MedicationRequest", "MedicationStatement", "Procedure", "Observation")])
    concept = F.struct(F.array(F.struct(F.lit("urn:p").alias("system"), F.col("o_orderpriority").alias("code"))).alias("coding"))
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(k % 13 == 0, "entered-in-error").otherwise("in-progress")
    resource = F.struct(
        F.get(kinds, (k % 5).cast("int")).alias("resourceType"), F.when(k % 47 == 1, F.lit("no id!")).otherwise(k.cast("string")).alias("id"), status.alias("status"), concept.alias("code"), concept.alias("medicationCodeableConcept"),
        F.struct(F.concat(F.lit("Patient/"), F.when(F.col("o_custkey") % 19 == 0, "b").otherwise("a")).alias("reference")).alias("subject"), F.when(k % 41 == 1, F.array(F.struct(F.lit("x").alias("url")))).alias("modifierExtension"),
        F.struct(F.when(k % 2 == 0, (k % 9).cast("string")).alias("versionId")).alias("meta"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("effectiveDateTime"),
    )
    bundle = F.to_json(F.struct(F.lit("Bundle").alias("resourceType"), F.array(F.struct(resource.alias("resource"))).alias("entry")))
    payload = (
        F.when(k % 29 == 1, F.lit('{"resourceType": "Bundle", "entry": [')).when(k % 31 == 1, F.lit('{"resourceType": "Bundle", "entry": [{"fullUrl": "x"}]}')).when(k % 37 == 1, F.lit("[1, 2]"))
        .when(k % 43 == 1, F.lit('{"resourceType": "Bundle", "entry": 5}')).when(k % 3 == 0, F.to_json(resource)).otherwise(bundle)
    )
    return table(spark, sf_dir, "orders").select(k.alias("document_id"), payload.alias("payload"))


def _mapped(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    codes = spark.createDataFrame([("urn:p", "1-URGENT", "a", "injection", 0), ("urn:p", "2-HIGH", "b", "injection", 1)], "system string, code string, product string, kind string, position int")
    resources, unread = (materialize(x) for x in ingest.read_resources(_documents(spark, sf_dir), "document_id", "payload"))
    return *ingest.map_resources(resources, "document_id", codes, F.lit("Patient/a"), F.lit("-07:00")), unread


@query(
    "coded_resources",
    f"""{_CODED_SQL} SELECT record, CASE WHEN record = 'unread' THEN unread WHEN refused IS NOT NULL THEN refused WHEN record = 'excluded' AND NOT mapped THEN 'unmapped-treatment-code' WHEN record = 'excluded' THEN 'administration-not-confirmed-complete'
  WHEN err THEN 'entered-in-error' WHEN record = 'context' THEN 'active' WHEN done THEN 'administered' ELSE 'planned' END AS status, count(*) AS n FROM o GROUP BY ALL""",
)
def coded_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's resource is taken in, excluded or unread, and counted."""
    rows, excluded, _, unread = _mapped(spark, sf_dir)
    told = lambda df, record: df.select(F.lit(record).alias("record"), F.col("reason").alias("status"))
    both = rows.select("record", "status").unionByName(told(excluded, "excluded")).unionByName(told(unread, "unread"))
    return both.groupBy("record", "status").agg(F.count("*").alias("n"))


@query(
    "resource_sources",
    f"""{_CODED_SQL} SELECT o_orderkey AS document_id, type || '/' || o_orderkey AS resource_id, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 9 AS VARCHAR) ELSE 'content-sha256' END AS version, CASE WHEN type <> 'Procedure' THEN strftime(d.o_orderdate, '%Y-%m-%d') END AS original_effective
  FROM o JOIN orders d USING (o_orderkey) WHERE unread IS NULL AND refused IS NULL""",
)
def resource_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each resource that is looked at came from."""
    sources = _mapped(spark, sf_dir)[2]
    return sources.select("document_id", "resource_id", F.split_part("version_id", F.lit(":"), F.lit(1)).alias("version"), "original_effective")


@query(
    "reference_audit",
    """WITH t AS (SELECT o_orderkey AS k, o_custkey % 10 AS grp FROM orders WHERE o_orderkey % 17 <> 0), r AS (SELECT l_orderkey AS k, l_suppkey % 10 AS grp FROM lineitem),
j AS (SELECT r.*, t.k AS tk, t.grp AS tg FROM r LEFT JOIN t ON r.k = t.k), v AS (SELECT CASE WHEN tk IS NULL THEN 'dangling-reference' WHEN grp IS DISTINCT FROM tg THEN 'grp-differs' ELSE '' END AS violations FROM j) SELECT violations, count(*) AS n FROM v GROUP BY violations""",
)
def reference_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "orders").filter("o_orderkey % 17 <> 0").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 10).alias("grp"))
    refs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_suppkey") % 10).alias("grp"))
    return provenance.resolve_refs(refs, targets, ["k"], ["grp"]).groupBy(F.array_join("violations", ",").alias("violations")).agg(F.count("*").alias("n"))


@query(
    "threshold_audit",
    """WITH v AS (SELECT concat_ws(',', CASE WHEN l_discount > 0.07 THEN 'above:maximumDiscount' END, CASE WHEN l_orderkey % 9 = 0 THEN 'missing:minimumPrice' WHEN l_extendedprice < 5000 THEN 'below:minimumPrice' END, CASE WHEN l_quantity < 5 THEN 'below:minimumQuantity' END) AS violations FROM lineitem)
SELECT violations, count(*) AS n FROM v GROUP BY violations""",
)
def threshold_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = lambda k, v: [F.lit(k), v.cast("double")]
    facts = F.map_filter(
        F.create_map(
            *entry("minimumQuantity", F.col("l_quantity")), *entry("minimumPrice", F.when(F.col("l_orderkey") % 9 != 0, F.col("l_extendedprice"))),
            *entry("maximumDiscount", F.col("l_discount"))
        ),
        lambda k, v: v.isNotNull()
    )
    needs = F.create_map(*entry("minimumQuantity", F.lit(5)), *entry("minimumPrice", F.lit(5000)), *entry("maximumDiscount", F.lit(0.07)))
    judged = provenance.threshold_errors(table(spark, sf_dir, "lineitem").select(facts.alias("facts"), needs.alias("needs")), "needs", "facts")
    return judged.groupBy(F.array_join("violations", ",").alias("violations")).agg(F.count("*").alias("n"))
