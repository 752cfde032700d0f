import collections
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.messy import DOCUMENTS_DDL, documents, lowered, prose, words
from tidemark.llm import components, langid, mixing, neardup, quality, sharding, topk, urlrules
from tidemark.llm.common import text_slices, word_count


@pytest.fixture
def messy(spark):
    return spark.createDataFrame(documents(), DOCUMENTS_DDL).repartition(4)


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], DOCUMENTS_DDL)


def test_word_count(messy):
    for r in messy.select("text", word_count(F.col("text")).alias("n")).collect():
        assert r.n == len(words(r.text))


# 1: mixing


def mix_of(docs, **more):
    sized = docs.withColumns({"words_in": word_count(F.col("text")), "tie": F.xxhash64("text")})
    return mixing.Mix(sized, "words_in", "tie", shards=7, **more)


def test_targets_stop_at_the_limit():
    assert mixing.targets([100, 100, 10], [1, 2, 3], 3) == [60.0, 120.0, 30.0]
    assert mixing.targets([0, 0], [1, 2], 3) == [0.0, 0.0] and mixing.targets([], [], 3) == []


def test_shard_counts_meet_quotas():
    counts = mixing.shard_counts([1000, 10, 0, 333], 9, 1)
    assert counts.sum(axis=0).tolist() == [1000, 10, 0, 333] and np.ptp(counts.sum(axis=1)) <= 1
    assert (mixing.shard_counts([1000, 10, 0, 333], 9, 1) == counts).all()


def test_permutations():
    for n in (1, 2, 3, 10, 1000, 4097):
        out = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 99))
        assert sorted(out.tolist()) == list(range(n))
    assert mixing.permuted(np.arange(500), np.full(500, 500), np.full(500, 1)).tolist() != mixing.permuted(np.arange(500), np.full(500, 500), np.full(500, 2)).tolist()


def test_mix_of_messy_documents(messy):
    mix = mix_of(messy, block_words=4)
    rows, again = mix.taken().collect(), mix_of(messy, block_words=4).taken().collect()
    key = lambda r: (r.doc_id or 0, r.source or "", r["size"], r.start, r.taken)
    assert sorted(map(key, rows)) == sorted(map(key, again)) and len(rows) == len(documents())
    by_source = {}
    for r in rows:
        assert r.taken <= 3 * r["size"]
        by_source.setdefault(r.source_no, []).append(r)
    assert sum(r[0].target for r in by_source.values()) == pytest.approx(sum(r["size"] for r in rows))
    order = sorted({r.source for r in rows}, key=lambda s: (s is None, s))
    for no, own in by_source.items():
        assert own[0].source == order[no] and own[0].source_size == sum(r["size"] for r in own)
        assert abs(sum(r.taken for r in own) - own[0].target) <= 4


def test_mix_pieces_hold_the_whole_text(messy):
    mix = mix_of(messy, block_words=8, text_col="text", carry=("lang",))
    whole = {}
    for r in mix.pieces().collect():
        assert len(words(r.text)) == r.n_words
        whole.setdefault((r.source_no, r.start), []).append((r.first_word, r.text))
    assert sorted("".join(t for _, t in sorted(v)) for v in whole.values()) == sorted(r[1] for r in documents() if words(r[1]))
    taken = {}
    for r in mix.rows().collect():
        taken.setdefault((r.source_no, r.block), set()).add((r.shard, r.place))
    assert len({p for v in taken.values() for p in v}) == sum(len(v) for v in taken.values())


def test_mix_of_nothing(nothing):
    assert mix_of(nothing).taken().collect() == [] and mix_of(nothing, text_col="text").rows().collect() == []


# 2: top-k


def brute_top(vectors, queries, k):
    out = {}
    for q, x in queries:
        scored = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in vectors if i != q and len(y) == len(x))[:k]
        out[q] = [(i, -s) for s, i in scored]
    return out


@pytest.mark.parametrize("blocks", [4096, 7])
def test_top_k(spark, monkeypatch, blocks):
    monkeypatch.setattr(topk, "BLOCK_ROWS", blocks)
    rng = np.random.default_rng(1)
    centres = rng.integers(-500, 500, (5, 6))
    rows = [(i, (centres[i % 5] + rng.integers(-20, 20, 6)).tolist()) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(30)] + [(400, [1, 2]), (401, [3, 4]), (402, []), (403, [0] * 6)]
    messy = rows + [rows[5], (404, None), (None, rows[0][1]), (405, [1, None, 2, 3, 4, 5])]
    ddl = "id long, vector array<long>, rank int"
    df = spark.createDataFrame([(*r, 0) for r in messy], ddl).repartition(3)
    found = {}
    for r in topk.top_k(df, df.filter("id % 10 = 0"), 4).collect():
        found.setdefault(r.query_id, {})[r["rank"]] = (r.id, r.score)
    wanted = brute_top([*rows, rows[5]], [r for r in rows if r[0] % 10 == 0], 4)  # a repeated row is a candidate each time
    assert {q: [v[k] for k in sorted(v)] for q, v in found.items()} == {q: v for q, v in wanted.items() if v}


def test_top_k_reads_no_more_annuli_than_the_bound_asks_for():
    rings = [{"low": float(k), "high": k + 1.0, "block": k} for k in range(10)]
    assert topk._reads(np.array([3.5]), rings, None, None) == {3: np.array([0])}
    assert sorted(topk._reads(np.array([3.5]), rings, np.array([1.0]), np.array([True]))) == [2, 4]
    assert sorted(topk._reads(np.array([3.5]), rings, np.array([np.inf]), np.array([False]))) == list(range(10))


def test_top_k_of_large_components_and_nothing(spark):
    df = spark.createDataFrame([(0, [2**31, 1]), (1, [2**31, 2]), (2, [1, 1])], "id long, vector array<long>")
    assert [(r.id, r.score) for r in sorted(topk.top_k(df, df.filter("id = 0"), 2).collect(), key=lambda r: r["rank"])] == [(1, 2**62 + 2), (2, 2**31 + 1)]
    none = df.filter("id > 5")
    assert topk.top_k(none, none, 3).collect() == []


# 3: near-duplicates


def shingle_set(text):
    w = words(lowered(text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    label = {i: i for i, _ in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if x and y and 100 * len(x & y) >= 85 * len(x | y):
            a, b = sorted((root(a), root(b)))
            label[b] = a
    return {i: root(i) for i in label}


def near_copies(seed, groups, copies):
    r, rows, i = random.Random(seed), [], 0
    for g in range(groups):
        base = prose(seed * 100 + g, r.choice([8, 30, 200]) + r.randrange(20)).split(" ")
        for _ in range(copies):
            text = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 3])):
                text[r.randrange(len(text))] = f"w{r.randrange(10)}"
            rows.append((i := i + 1, " ".join(text)))
    shared = prose(seed + 9, 70)
    rows += [(1000 + k, shared + " " + prose(seed + 50 + k, 30 + k)) for k in range(12)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, seed):
    rows = near_copies(seed, 6, 14)
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: r.component_id for r in found} == brute_components(rows)
    for r in found:
        assert r.n_shingles == len(shingle_set(dict(rows)[r.doc_id])) and r.kept == (r.doc_id == r.component_id)


def test_near_duplicates_of_messy_documents(messy, nothing):
    found = neardup.near_duplicates(messy).collect()
    assert len(found) == len(documents())
    own = {r.doc_id: r.component_id for r in found}
    wanted = brute_components([(r[0], r[1]) for r in documents() if r[0] is not None])
    assert {k: v for k, v in own.items() if k is not None} == wanted
    assert all(r.component_id is None and r.kept for r in found if r.doc_id is None)
    assert neardup.near_duplicates(nothing).collect() == []


def test_components_of_a_long_path(spark):
    edges = [(k + 1, k) for k in range(60)] + [(200, 100), (100, 100), (201, 200)]
    found = dict(components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert found == {**{k: 0 for k in range(61)}, 100: 100, 200: 100, 201: 100}


# 5: url rules


def brute_rule(host, path, rules):
    fits = [(len(h + p), h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, "allow")


def test_url_rules(spark):
    rules = [
        ("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.net", "/en/a", "block"), ("org", "/fr/", "allow"), ("com", "", "block"),
        ("é.com", "/", "allow"), ("www.example.net", "/", "allow")
    ]
    urls = [
        "http://a.example.net/en/x?q#f", "https://EXAMPLE.net/en/abc", "http://net/", "http://net", "http://xnet/", "http://b.org/fr/", "http://b.org/frx", "ftp://É.com/", "http://é.com/z", "http://com?x", "x://y://z.net/", None, "", "no scheme",
        "http://www.example.net/en/", "http://a..net/\n/x", "http://a.example.net/en/x", "://net/a", "http:///path", "http://example.net.evil.com/en/",
    ]
    rows = [(k, u, "clash", "clash") for k, u in enumerate(urls)] + [(None, "http://net/", "c", "c"), (0, urls[0], "c", "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    table = spark.createDataFrame([*rules, ("net", "/", "allow"), (None, "/", "block"), ("x", None, "block")], "host string, path string, action string")
    found = urlrules.judge(pages, table, lots=3).collect()
    assert len(found) == len(rows)
    import re

    for r in found:
        url = dict((row[0], row[1]) for row in rows[: len(urls)]).get(r.page_id, "http://net/")
        parts = re.search(r"^.*?://([^/?#]*)([^?#]*)", url or "", re.S)
        host, path = (lowered(parts[1]), parts[2]) if parts else ("", "")
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, *brute_rule(host, path, rules))
    assert urlrules.judge(pages, table.limit(0)).filter("rule is not null or verdict <> 'allow'").count() == 0
    assert urlrules.judge(pages.limit(0), table).collect() == []


# 6: language ID


@pytest.fixture(scope="module")
def model():
    def text(lang, k):
        r = random.Random(f"{lang}{k}")
        ends = {"aa": ["ing", "ed", "the"], "bb": ["eux", "ré", "les"]}[lang]
        return " ".join(r.choice("bcdfg") + r.choice("aeiou") + r.choice(ends) for _ in range(60))

    pairs = [(lang, text(lang, k)) for lang in ("aa", "bb") for k in range(40)]
    return langid.train(pairs), text


def test_forward_backward(model):
    m = model[0]
    scores = np.random.default_rng(0).normal(size=(150, 2)).astype(np.float32)
    bounds = np.array([0, 3, 3, 150])
    got = m.posteriors(scores, bounds)
    step = np.exp(m.transitions.astype(float))
    for a, b in ((0, 3), (3, 150)):
        local = np.exp(scores[a:b].astype(float))
        forward = [np.ones(2) @ step * local[0]]
        for x in local[1:]:
            forward.append(forward[-1] / forward[-1].sum() @ step * x)
        backward = [np.ones(2)]
        for x in local[:0:-1]:
            v = step @ (x * backward[-1])
            backward.append(v / v.sum())
        both = np.array(forward) * np.array(backward[::-1])
        assert np.allclose(got[a:b], both / both.sum(axis=1, keepdims=True))


def test_gradient_is_that_of_the_likelihood(model):
    m = langid.ChainModel(["a", "b", "c"], np.zeros(0, np.uint64))
    rng = np.random.default_rng(2)
    m.transitions = rng.normal(size=(3, 3))
    scores, label, bounds = rng.normal(size=(9, 3)), rng.integers(0, 3, 9), np.array([0, 4, 9])

    def loss():
        total = 0.0
        for a, b in itertools.pairwise(bounds):
            every = [sum(scores[a + t, s] for t, s in enumerate(p)) + sum(m.transitions[x, y] for x, y in itertools.pairwise(p)) for p in itertools.product(range(3), repeat=b - a)]
            own = label[a:b]
            total += np.log(np.sum(np.exp(every))) - sum(scores[a + t, s] for t, s in enumerate(own)) - sum(m.transitions[x, y] for x, y in itertools.pairwise(own))
        return total

    wrong, pairs = langid._gradient(m, scores, label, bounds)
    for held, slope in ((scores, wrong), (m.transitions, pairs)):
        for at in np.ndindex(held.shape):
            was, held[at] = held[at], held[at] + 1e-5
            high, held[at] = loss(), was - 1e-5
            low, held[at] = loss(), was
            assert (high - low) / 2e-5 == pytest.approx(slope[at], abs=1e-4)


def test_code_switched_text_is_labelled_in_parts(model):
    m, text = model
    a, b = text("aa", 100).encode(), text("bb", 101).encode()
    data, starts, ends, bounds = langid.text_words(np.frombuffer(a + b" " + b, np.uint8), np.array([0, len(a) + len(b) + 1]))
    labels = m.posteriors(m.scores(data, starts, ends), bounds).argmax(axis=1)
    assert (labels[:60] == 0).mean() > 0.97 and (labels[60:] == 1).mean() > 0.97


def test_identify(spark, messy, nothing, model):
    m, text = model
    rows = [(k, text(lang, k), lang) for k, lang in enumerate(["aa", "bb"] * 20, 500)]
    found = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang_pred string"), m).collect()
    assert np.mean([r.lang_pred == dict((i, lang) for i, _, lang in rows)[r.doc_id] for r in found]) > 0.95
    for r in langid.identify(messy, m).collect():
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) and 0 <= r.score <= 1 and (r.score > 0 or r.lang_pred == "und")
    assert langid.identify(nothing, m).collect() == []
    unlearned = langid.fit(nothing)
    assert {r.lang_pred for r in langid.identify(messy, unlearned).collect()} == {"und"}
    one = langid.fit(messy.filter("lang = 'en'"))
    assert {r.lang_pred for r in langid.identify(messy, one).collect()} == {"und", "en"}


# 7: sharding


def check_shards(rows, shards, size):
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(shards))


def test_sharding_splits_a_hot_key(spark):
    rng = random.Random(4)
    rows = [(k, 7 if k % 3 == 0 else rng.randrange(-(2**62), 2**62), rng.randrange(1, 200)) for k in range(6000)]
    df = spark.createDataFrame(rows, "id long, key long, size long").repartition(5)
    found = sharding.shard(df, 4, "size", "id", "key").collect()
    assert len(found) == len(rows)
    check_shards(found, 4, "size")
    held = {}
    for r in found:
        held[r.shard] = held.get(r.shard, 0) + r["size"]
    assert max(held.values()) <= 1.01 * min(held.values())


def test_sharding_messy_documents(messy, nothing):
    docs = messy.withColumn("bytes", F.octet_length("text")).withColumn("key", F.xxhash64("text")).withColumn("slot", F.lit("clash"))
    found = sharding.shard(docs, 3, "bytes", "doc_id", "key").collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in found) == sorted((r[0] or 0, r[1] or "") for r in documents())
    check_shards(found, 3, "bytes")
    assert sharding.shard(nothing.withColumn("key", F.xxhash64("text")), 3, "n_chars", "doc_id", "key").collect() == []


def test_places_among_bounds():
    bounds = sorted({(random.Random(k).randrange(5), random.Random(k + 99).randrange(9)) for k in range(30)})
    rows = [(a, b) for a in range(-1, 6) for b in range(-1, 10)]
    got = sharding._locate(*(np.array(x) for x in zip(*rows, strict=True)), *(np.array(x) for x in zip(*bounds, strict=True)))
    assert got.tolist() == [sum(x <= r for x in bounds) for r in rows]


# 9: quality


def brute_stats(text):
    text = text or ""
    w = words(text)
    tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    times = collections.Counter(tri)
    covered = {k + d for k, t in enumerate(tri) if times[t] > 1 for d in range(3)}
    full = [x for x in text.split("\n") if words(x)]
    n = len(w)
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(full) - len(set(full)), len(covered), n < 50 or 100 * len(covered) > 50 * n)


def test_quality_of_messy_documents(messy, nothing):
    texts = [r for r in documents() if r[0] != 11]
    for r in quality.annotate(messy.filter("doc_id is null or doc_id <> 11")).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_stats(r.text)
        assert r.kept == (not r.base_failed) and r.removed_lines is None and r["line"] == "clash"
    assert quality.annotate(messy).count() == len(texts) + 1
    assert quality.annotate(nothing).collect() == []


def norm(line):
    return " ".join("".join("0" if c in "0123456789" else c for c in lowered(x)) for x in words(line))


def test_frequent_lines_go_and_depleted_documents_are_rejected(spark):
    own = lambda k: "\n".join(prose(k * 10 + j, 30).replace("\n", " ") + f" own{'abcdefghij'[k % 10]}{'abcdefghij'[k // 10]}" for j in range(3))
    rows = [(k, own(k) + ("\nCookie  Policy 12" if k % 2 else "\ncookie policy 34\n"), "h" if k < 40 else None) for k in range(80)]
    rows += [(100 + k, "cookie policy 99\n" * 60 + f"rare tail number {'abcdefghij'[k]}", "h") for k in range(5)]
    rows += [(200 + k, rows[0][1], "h") for k in range(30)]  # equal texts count once
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    found = {r.doc_id: r for r in quality.annotate(df, min_docs=20, max_share=0.3).withColumn("text", quality.strip_lines(F.col("text"), F.col("removed_lines"))).collect()}
    for i, text, host in rows:
        lines = [x for x in text.split("\n") if norm(x) != "cookie policy 00"]
        assert words(found[i].text) == words("\n".join(lines))
        assert found[i].kept_words == len(words("\n".join(lines)))
    assert all(found[i].kept for i in range(80)) and not any(found[100 + k].kept for k in range(5))
    assert found[0].text == own(0) + "\n"


def test_stripping_leaves_nulls_alone(spark):
    df = spark.createDataFrame([(None, [1]), ("a b", None), ("a b", [1]), ("", [2])], "text string, removed array<long>")
    assert [r[0] for r in df.select(quality.strip_lines(F.col("text"), F.col("removed"))).collect()] == [None, "a b", "a b", ""]


# the pipeline


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = [r[:5] for r in documents()] + [(100 + k, f"{prose(700 + k, 80)} tail", "en" if k % 2 else "de", f"s{k % 3}", 0) for k in range(30)]
    ddl = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, ddl).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = docs
    for name, stage in pipeline.STAGES[:3]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == pipeline.COLUMNS, name
        kept.write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
    texts = {r.doc_id: r.text for r in kept.collect()}
    lettered = [(i, t) for i, t, *_ in rows if t and any(c.isalpha() for c in t)]
    passed = [(i, t) for i, t in lettered if not brute_stats(t)[-1]]
    labels = brute_components([x for x in passed if x[0] is not None])
    assert {i: t for i, t in texts.items() if i is not None} == {i: t for i, t in passed if i is not None and labels[i] == i}
    mixed = pipeline.source_mix(spark, kept, str(tmp_path)).cache()
    assert mixed.columns == pipeline.COLUMNS and {r.doc_id for r in mixed.select("doc_id").collect()} <= set(texts)
    packed = pipeline.pack(spark, mixed, str(tmp_path)).collect()
    from tests.llm.test_tokens import BYTE, check_packed, plain

    pieces = mixed.collect()
    check_packed(packed, [(r.doc_id, ids + [0]) for r, ids in zip(pieces, plain(BYTE, [r.text for r in pieces]), strict=True)], 1024)
    spark.createDataFrame([], ddl).write.parquet(str(tmp_path / "none/documents.parquet"))
    assert pipeline.run(spark, str(tmp_path / "none")).collect() == []


def test_slices_cover_all_rows():
    column = pa.array(["ab", None, "", "x" * 50, "é"])[1:]
    seen = [(low, high, bytes(data), offsets.tolist()) for low, high, data, offsets in text_slices(column, 4)]
    assert [s[:2] for s in seen] == [(0, 2), (2, 3), (3, 4)] and seen[2][2] == "é".encode()


@pytest.mark.parametrize("size", [200, 1 << 16])
def test_clusters_of_near_copies_in_blocks(spark, monkeypatch, size):
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", size)
    r, base, rows = random.Random(8), prose(77, 120).split(" "), []
    for i in range(90):  # edits of every strength, many of them alike
        text = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 4, 6])):
            text[r.randrange(0, len(text), 6)] = r.choice(["red", "green", "blue"])
        rows.append((i, " ".join(text)))
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    wanted = brute_components(rows)
    assert len(set(wanted.values())) > 5
    assert {r.doc_id: r.component_id for r in found} == wanted


def test_overlaps():
    rng = np.random.default_rng(3)
    one, other = ([np.unique(rng.integers(0, 60, rng.integers(1, 40))) for _ in range(7)] for _ in range(2))
    assert neardup._overlaps(one, other, 16).tolist() == [[len(np.intersect1d(a, b)) for b in other] for a in one]


def test_tables_are_deleted_when_discarded(spark):
    from tidemark.llm import common

    def there(df):
        path = spark._jvm.org.apache.hadoop.fs.Path(common._paths[df])
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)

    with common.Run().active() as run, common.Run().active() as other:
        kept = common.materialize(spark.range(3))
    with run.active():
        own = common.materialize(spark.range(2))
    alone, gone = common.materialize(spark.range(4)), common.materialize(spark.range(5))
    common.discard(gone, spark.range(1))
    assert there(kept) and there(alone) and gone not in common._paths
    run.delete(spark)
    assert there(kept) and not there(own)
    other.delete(spark)
    assert not there(kept) and there(alone) and alone.count() == 4


def alternating(one, other, join, rounds):
    for _ in range(rounds):
        one, other = join(one, other), join(other, one)
    return one, other


def test_alternating_texts_are_neither_linked_nor_counted_together(spark):
    glued = alternating("a", "b", lambda x, y: x + y, 11)
    spaced = alternating("a", "b", lambda x, y: f"{x} {y}", 11)
    rows = [(1, glued[0]), (2, glued[1]), (3, "\n".join([*spaced, spaced[0]]))]
    docs = spark.createDataFrame([(i, t, "h") for i, t in rows], "doc_id long, text string, source string")
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 3}
    assert {r.doc_id: r.n_dup_lines for r in quality.annotate(docs).collect()} == {1: 0, 2: 0, 3: 1}
    lines = [(k, f"{spaced[k % 2]}\nown{'abcdefghi'[k]}", "h") for k in range(9)]  # five hold one line, four the other
    judged = quality.annotate(spark.createDataFrame(lines, "doc_id long, text string, source string"), min_docs=4).collect()
    assert {r.doc_id for r in judged if r.removed_lines} == {0, 2, 4, 6, 8}


def test_url_rules_at_the_bounds_of_ranges(spark):
    rules = [("net", "/", "block")] + [("net", "/" + "a" * k, "allow" if k % 2 else "block") for k in range(1, 12)] + [("x.net", "/aaa", "allow"), ("org", "", "allow")]
    urls = [f"http://{h}/{'a' * (k % 15)}{'b' * (k % 3)}" for k in range(60) for h in ("net", "y.net", "x.net", "org", "com")]
    rows = list(enumerate(urls)) + [(1000 + k, "http://y.net/aaaa") for k in range(80)]  # one url that no range of keys can hold alone
    pages, table = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, action string")
    for lots in (1, 2, 9, 40):
        found = urlrules.judge(pages, table, lots=lots).collect()
        assert len(found) == len(rows)
        for r in found:
            assert (r.rule, r.verdict) == brute_rule(r.host, r.path, rules)


def test_top_k_counts_repeated_rows_as_its_sql_does(spark, tmp_path):
    import duckdb

    from tidemark.llm import queries

    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(0, 1200, 4)]
    rows += [rows[3]] * 4 + [rows[25]] * 2 + [(100, rows[7][1]), (7, None), (None, rows[0][1]), (9, [float("nan")] * 8)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    embeddings = duckdb.read_parquet(f"{tmp_path}/embeddings.parquet/*.parquet")  # noqa: F841
    found = queries.op2_exact_top_k(spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(tuple(r) for r in found) == sorted(duckdb.sql(queries.OP2_SQL).fetchall())
