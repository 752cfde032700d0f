"""The bounded sample that language ID is fitted on."""

import collections

from tidemark.llm import langid


def test_every_language_is_in_the_sample(spark):
    rows = [(None if k % 2 else 7, f"common text {k}", "aa" if k % 3 else "bb") for k in range(3000)]  # ids that are null or repeat
    rows += [(k, f"rare text {k}", "rare") for k in range(2)]
    found = langid.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4), max_docs=60).collect()
    assert collections.Counter(r.lang for r in found) == {"aa": 29, "bb": 29, "rare": 2} and len({(r.lang, r.text) for r in found}) == 60


def test_long_texts_are_sampled_in_whole_words(spark):
    rows = [(k, " ".join(f"word{k}x{j}" for j in range(20000)), "aa") for k in range(20)] + [(99, "y" * 50000, "bb")]
    found = langid.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_words=10).collect()
    assert len(found) == 21
    for r in found:
        if r.lang == "aa":
            parts = r.text.split(" ")
            assert len(r.text) <= 160 and all(p.startswith("word") for p in parts) and len(parts) >= 8


def test_shares():
    assert langid.shares_of({"a": 9, "b": 1}, 20) == {"a": 9, "b": 1}
    assert langid.shares_of({"a": 90, "b": 100, "c": 2}, 21) == {"c": 2, "a": 9, "b": 10}
    assert langid.shares_of({"a": 5, "b": 5, "c": 5}, 2) == {"a": 1, "b": 1, "c": 1} and langid.shares_of({}, 5) == {}
