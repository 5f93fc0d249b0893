"""The registered queries of the operators: thin wrappers with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, heap_lloyd, importance, language_id, license_scan, line_rules, near_dedup, packing, posting_lists, quality_mil, substring_dedup, toxicity, training_order
from .common import new_path, read


def op1_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.write_shards(read(spark, sf_dir, "documents"), new_path(spark, "shards"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    chain = toxicity.train(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, chain).withColumn("held_out", toxicity.held_out()).withColumn("predicted", F.col("toxic").cast("int"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(decontaminate.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))


def op4_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_rules.clean(read(spark, sf_dir, "documents"))
    return cut.withColumn("clean_sha256", F.sha2(F.coalesce("clean_text", F.lit("")), 256)).drop("clean_text")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), with_ids=False).drop("ids")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents")).drop("matches")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.train(docs)).withColumn("held_out", language_id.held_out())


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicate_classes(read(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.remove_repeats(read(spark, sf_dir, "documents"))
    words = F.regexp_replace(F.coalesce("kept_text", F.lit("")), r"[\x20\x09-\x0D]+", " ")
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.trim(words), 256).alias("kept_sha256"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality_mil.train(docs, read(spark, sf_dir, "labels"))
    return quality_mil.score(docs, model).withColumn("held_out", quality_mil.held_out())


def op11_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posting_lists.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op12_heap_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = heap_lloyd.compress(read(spark, sf_dir, "embeddings"))
    return heap_lloyd.with_label_error(coded).drop("label").withColumn("codebooks_sha256", F.lit(heap_lloyd.digest(books)))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("n_words")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_training_order,
        op2_toxicity,
        op3_decontamination,
        op4_line_rules,
        op5_packing,
        op6_license_scan,
        op7_language_id,
        op8_near_duplicates,
        op9_substring_dedup,
        op10_quality,
        op11_nearest,
        op12_heap_codes,
        op13_importance,
        pipeline,
    )
}

_DECONTAMINATION = """
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
q AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + 9], ' ') AS g FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
d AS (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, (SELECT DISTINCT n FROM q) WHERE len(ws) >= n),
h AS (SELECT r, i, n, item_id FROM (SELECT r, i, n, array_to_string(ws[i:i + n - 1], ' ') AS g FROM d) JOIN q USING (n, g)),
c AS (SELECT r, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM h)) GROUP BY r),
t AS (SELECT r, count(DISTINCT item_id)::BIGINT AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM h GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN c USING (r) LEFT JOIN t USING (r)
"""

_SUBSTRING = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
o AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS lo FROM g) WHERE lo < doc_id),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM o),
k AS (SELECT doc_id, ws, p FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM w)),
t AS (SELECT k.doc_id, string_agg(ws[k.p], ' ' ORDER BY k.p) AS kept, count(*) AS n FROM k ANTI JOIN c ON k.doc_id = c.doc_id AND k.p = c.p GROUP BY k.doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN t USING (doc_id)
"""

ORACLE_SQL: dict[str, str] = {
    "op3_decontamination": _DECONTAMINATION,
    "op4_line_rules": line_rules.ORACLE_SQL,
    "op6_license_scan": license_scan.ORACLE_SQL,
    "op9_substring_dedup": _SUBSTRING,
    "op12_heap_codes": heap_lloyd.ORACLE_SQL,
}
