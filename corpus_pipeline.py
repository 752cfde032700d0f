"""A training corpus from documents: language ID, quality rules, near-duplicates, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read back
as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import functools
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import langid, mixing, neardup, packing, quality
from tidemark.llm.common import Run, delete_folder, materialize, shared_folder, word_count
from tidemark.llm.queries import tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Share of a document's words that its language must have.
LEAST_SCORE = 0.4
#: A line goes that is in more documents of its host than chance explains, and in over 1 % of them or in very many.
CHANCE_DOCS, MANY_DOCS = 5, 1000
#: Words to a block of the mix.
BLOCK_WORDS = 512


class _Runs(threading.local):
    """Of the thread's current run: the tables of each stage that it has begun, by the stage's place."""

    def __init__(self) -> None:
        self.stages: list[Run] = []


_runs = _Runs()


def stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """f as a stage. Its docs are the written rows of the stage before, so the tables that one left in the shared folder go now.

    A run begins with the first stage; what the last stage of a run left stays, as its rows may still be read, until the session ends.
    """

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        place = [own.__name__ for _, own in STAGES].index(f.__name__)
        if place != len(_runs.stages):
            _runs.stages = [Run() for _ in range(place)]
        for run in _runs.stages:
            run.delete(spark)
        with Run().active() as run:
            _runs.stages = [] if place == len(STAGES) - 1 else [*_runs.stages, run]
            return f(spark, docs, sf_dir)

    return run_stage


@stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; lang becomes the predicted one. Where no row is labelled, nothing can be told and all stay.

    Null or empty texts, and those without letters, go. Repeated rows share their fate.
    """
    model = langid.fit(docs)
    if not model.langs:
        return docs.select(COLUMNS)
    found = langid.identify(docs, model).filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return found.withColumn("lang", F.col("lang_pred")).select(COLUMNS)


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without the lines that are too frequent on their host, where near copies count once.

    Null or empty texts go, as they have fewer than 50 words. Repeated rows are judged alike and count once. A null source is a host.
    """
    judged = quality.annotate(docs, min_docs=CHANCE_DOCS, many_docs=MANY_DOCS, copies=neardup.GENERAL).filter("kept")
    kept = judged.withColumn("text", quality.strip_lines(F.col("text"), F.col("removed_lines")))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (similarity of 0.8 or more): that of the smallest doc_id, any of several such rows.

    Rows count one by one, whatever their doc_id: of repeated rows one stays, of rows that share an id those of other texts. Null ids
    come last. Rows without a word are in no group and stay.
    """
    rows = materialize(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")))
    found = neardup.near_duplicates(rows.select("row", "text"), "row", **neardup.GENERAL)
    named = found.join(rows.select(F.col("row").alias("doc_id"), F.col("doc_id").alias("id")), "doc_id")
    first = F.min_by("doc_id", F.struct(F.col("id").isNull(), "id", "doc_id")).alias("row")
    return rows.join(named.groupBy("component_id").agg(first).select("row"), "row", "left_semi").select(COLUMNS)


@stage
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents that the mix takes, as often as it takes them.

    Null or empty texts have no words and are not taken. Repeated rows are so many documents; a null source is one, the last.
    """
    sized = docs.withColumns({"size": word_count(F.col("text")), "tie": F.xxhash64("text")})
    mix = mixing.Mix(sized, "size", "tie", text_col="text", carry=("lang",), block_words=BLOCK_WORDS)
    return mix.rows().withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of at most 1024 tokens, one row for each piece of text in them, with its ids.

    A null or empty text is its end id alone. Repeated rows are packed as often as they stand.
    """
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("language_id", language_id), ("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("source_mix", source_mix), ("packing", pack)]

#: Tokenising and the draws of the mix have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents. Of the stages' rows in the shared folder, none but the packed pieces are still there when this returns."""
    _runs.stages = []
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, apply in STAGES[:-1]:
        folder = shared_folder(spark, name)
        apply(spark, docs, sf_dir).write.mode("overwrite").option("compression", "zstd").parquet(folder)
        docs = spark.read.parquet(folder)
        if before:
            delete_folder(spark, before)
        before = folder
    packed = STAGES[-1][1](spark, docs, sf_dir)  # its pieces are written by now
    delete_folder(spark, before)
    return packed
