"""A corpus pipeline of five operators.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
kept.  All but the last return the columns of documents; stages write their
result in the shared folder and the next one reads it again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from densitylab.llm import decontaminate, language_id, near_dedup, packing, substring_dedup
from densitylab.llm.common import documents, read, staged

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Texts whose language is less sure than this go.
SURE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter or without a sure language go; the language found replaces lang."""
    model = language_id.train(docs)
    found = language_id.predict(docs, model, COLUMNS).filter((F.col("lang_pred") != "und") & (F.col("score") >= SURE))
    return found.select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least document of each class stays; rows with a null id stay."""
    losers = near_dedup.near_duplicate_classes(docs).filter("not kept").select("doc_id")
    return documents(docs, *COLUMNS).join(losers, "doc_id", "left_anti").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut; a text of which nothing is left goes."""
    cut = substring_dedup.remove_repeats(docs, columns=("doc_id", "lang", "source", "n_chars"))
    left = cut.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    return left.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.when(F.col("n_removed") > 0, F.char_length("kept_text")).otherwise(F.col("n_chars")).cast("bigint").alias("n_chars"))


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return decontaminate.without_leaks(docs, decontaminate.find_leaks(docs, read(spark, sf_dir, "benchmark")), COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # the workers also serve the stages before, so they keep fewer pieces
    return packing.pack_documents(docs, with_ids=False, cache=600_000).drop("ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", decontaminate_benchmark),
    ("packing", pack_sequences),
]

#: Language ID is learned, so no SQL gives these rows; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
