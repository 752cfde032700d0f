"""The queries of the corpus operators, over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import importance, langid, mixing, neardup, negatives, packing, pieces, quality, sharding, tokencount, tokenfile, topk, urlrules
from .common import materialize, shared_folder, word_count


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"))
    return mixing.Mix(docs, "size", "tie").taken().select("doc_id", "source", "size", "source_size", "target", "taken")


def quantized(vector, scale: int = 1024):
    """floor(scale x) of each component as double; null for a vector that is null or holds a null or non-finite component."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    sound = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(sound, F.transform(doubles, lambda x: F.floor(x * scale)))


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), quantized(F.col("embedding")).alias("vector"))
    return topk.top_k(vectors, vectors.filter("id % 100 = 0"), 10).withColumnRenamed("id", "vec_id")


OP2_SQL = """
WITH v AS (SELECT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), keep_ids=False)


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    return urlrules.judge(table(spark, sf_dir, "pages"), rules)


OP5_SQL = r"""
WITH p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path FROM pages),
m AS (SELECT *, (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') AS a, (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') AS b,
  (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') AS c, (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') AS d FROM p)
SELECT page_id, host, path, CASE WHEN b THEN 'example.net/en/' WHEN c THEN 'example.com/de/' WHEN d THEN 'org/fr/' WHEN a THEN 'net/' END AS rule,
  CASE WHEN b OR d THEN 'allow' WHEN c OR a THEN 'block' ELSE 'allow' END AS verdict FROM m
"""


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)))
    model = langid.fit(docs.filter(~F.col("held_out")))
    return langid.identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        F.xxhash64("text").alias("text_key")
    )
    sharded = sharding.shard(docs, 16, "size", "doc_id", "text_key")
    return sharded.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark, 'flat')}/files"
    written = materialize(tokencount.write_flat_files(table(spark, sf_dir, "documents"), folder, tokenizer("byte_bpe_50k.json"), end_id=50256))
    found = materialize(tokencount.file_ends(spark, folder, end_id=50256))
    return tokencount.count_tokens(found).join(written, ["file", "doc_no"]).select("doc_id", "n_tokens", "finished", "file", "doc_no", "start")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.annotate(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), keep_text=False)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_words")


OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
g AS (SELECT r, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
tri AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS tri FROM g),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, tri) AS n FROM tri) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT j) AS n_repeat FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY r),
l AS (SELECT r, source, t, unnest(string_split(t, chr(10))) AS line FROM d),
lw AS (SELECT *, list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS lws FROM l),
full_lines AS (SELECT r, source, t, line, len(lws) AS n, regexp_replace(translate(array_to_string(lws, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g') AS norm FROM lw WHERE len(lws) > 0),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup FROM full_lines GROUP BY r),
freq AS (SELECT source, norm FROM (SELECT source, norm, count(DISTINCT t) AS n FROM full_lines GROUP BY source, norm) a
  JOIN (SELECT source AS s, count(DISTINCT t) AS docs FROM d GROUP BY source) b ON a.source IS NOT DISTINCT FROM b.s WHERE n > 50 AND n > 0.01 * docs),
gone AS (SELECT f.r, sum(f.n) AS gone FROM full_lines f JOIN freq q ON f.source IS NOT DISTINCT FROM q.source AND f.norm = q.norm GROUP BY f.r),
c AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words, CAST(len(ws) - coalesce(gone, 0) AS BIGINT) AS kept_words FROM w LEFT JOIN rep USING (r) LEFT JOIN dup USING (r) LEFT JOIN gone USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND kept_words >= 0.3 * n_words AS kept, kept_words FROM b
"""


def op10_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark, 'tokens')}/file"
    tokenfile.write_token_file(table(spark, sf_dir, "documents"), path, tokenizer("word_bpe_49k.json"), end_id=2)
    return tokenfile.read_token_file(spark, path, keep_ids=False)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label")
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), label, quantized(F.col("embedding"), 256).alias("vector"))
    return negatives.hard_negatives(rows, rows.filter("id % 100 = 0"), positives=5, negatives=5, least=(80, 100))


OP11_SQL = """
WITH v AS (SELECT CAST(vec_id AS BIGINT) AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT row_number() OVER () AS r, * FROM v WHERE id % 100 = 0),
s AS (SELECT a.r, a.id AS anchor_id, c.id, a.label = c.label AS same, CAST(coalesce(list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * c.e[i])), 0) AS BIGINT) AS score
  FROM a JOIN v c ON a.id <> c.id AND len(a.e) = len(c.e)),
p AS (SELECT r, anchor_id, id AS positive_id, score, row_number() OVER (PARTITION BY r ORDER BY score DESC, id) AS k FROM s WHERE same),
n AS (SELECT p.anchor_id, p.positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score, CAST(row_number() OVER (PARTITION BY p.r, p.k ORDER BY s.score DESC, s.id) AS INTEGER) AS rank
  FROM p JOIN s ON p.r = s.r AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score WHERE p.k <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = importance.resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), share=(5, 100))
    return scored.select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 byte by byte over the distinct features, then counts, gains, noise and the draw.
OP12_SQL = r"""
WITH RECURSIVE tab AS (SELECT i AS b, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256)) AS i)),
texts AS (SELECT 'd' AS side, row_number() OVER () AS r, doc_id, text FROM documents UNION ALL SELECT 'b', row_number() OVER (), NULL, text FROM benchmark),
w AS (SELECT side, r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM texts),
f AS (SELECT side, r, unnest(ws) AS f FROM w
  UNION ALL SELECT side, r, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w
  UNION ALL SELECT side, r, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) FROM w),
c AS (SELECT f, hex(encode(f)) AS h, CAST(octet_length(encode(f)) AS BIGINT) AS n, CAST(0 AS BIGINT) AS i, CAST(4294967295 AS BIGINT) AS crc FROM (SELECT DISTINCT f FROM f)
  UNION ALL SELECT c.f, c.h, c.n, c.i + 1, xor(tab.v, c.crc >> 8) FROM c JOIN tab ON tab.b = xor(c.crc & 255, CAST('0x' || substr(c.h, 2 * c.i + 1, 2) AS BIGINT)) WHERE c.i < c.n),
k AS (SELECT f.side, f.r, xor(c.crc, 4294967295) % 10000 AS bucket FROM f JOIN c ON f.f = c.f AND c.i = c.n),
n AS (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM k GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * ((SELECT sum(s) FROM n)::DOUBLE + 10000) / ((CAST(s AS DOUBLE) + 1) * ((SELECT sum(t) FROM n)::DOUBLE + 10000)))) AS BIGINT) AS gain FROM n),
x AS (SELECT r, CAST(sum(gain) AS BIGINT) AS weight, count(*) AS n_features FROM k JOIN g USING (bucket) WHERE side = 'd' GROUP BY r),
y AS (SELECT w.r, doc_id, len(ws) >= 20 AS able, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
  CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM w LEFT JOIN x USING (r) WHERE side = 'd'),
z AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM y),
o AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= 5 * (SELECT count(*) FROM z WHERE able) // 100 THEN place END AS rank FROM o
"""


def op13_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer("piece_bpe_32k.model"), back=True)
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest, F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_source_mix, op2_exact_top_k, op3_minhash_near_dedup, op4_packing, op5_url_filter, op6_language_id, op7_sharding, op8_token_counts, op9_quality_rules,
    op10_token_file, op11_hard_negatives, op12_importance_resampling, op13_sentence_pieces
)}
ORACLE_SQL = {"op2_exact_top_k": OP2_SQL, "op5_url_filter": OP5_SQL, "op9_quality_rules": OP9_SQL, "op11_hard_negatives": OP11_SQL, "op12_importance_resampling": OP12_SQL}
