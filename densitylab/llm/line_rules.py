"""Quality rules with cross-document line frequency (operator 4), DataFrame functions only.

Base rules look at one text: symbols, repeated lines, words in repeated
EIGHT-word windows.  They are computed inside the row, so no word is shuffled.

Line frequency: each document's distinct normalised lines (lower case, white space
runs as one blank) are hashed to 64 bits, once a document, and counted per host
(``source``) by an aggregation with partial counts, so a line in every document of a
hot host is one row a task.  A line is boilerplate if it stands in at least MIN_DOCS
documents of its host, however large that is, or on a small host in at least FEW
documents and more than MOST of them.  Only boilerplate lines go back to their
documents.  ``clean`` removes them from the text and rejects a document, as depleted,
if less than HALF of its words are left.  Lines without a word stay.

Defined results: a null or empty text has no words, so it fails the base rule.
A null source is a host of its own.  Rows of one doc_id are one document, and rows
of a null doc_id are one for each text.  Equal rows get equal results.  Extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, staged

MIN_DOCS, FEW, MOST, HALF = 20, 3, 0.5, 0.5
MIN_WORDS, MAX_REPEAT = 20, 30

_WORD = r"[^\x20\x09-\x0D]+"
_BLANK = r"[\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """``body(value)`` with value computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _pairs(h: Column, far: int) -> Column:
    """Hashes of h[i] and h[i + far]."""
    n = F.size(h) - far
    return F.when(n > 0, F.zip_with(F.slice(h, 1, n), F.slice(h, far + 1, n), lambda a, b: F.xxhash64(a, b))).otherwise(F.array().cast("array<bigint>"))


def _covered(windows: Column, size: int) -> Column:
    """Words in windows whose hash is there twice or more."""
    marked = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(s: Column) -> Column:
        n = F.size(s)
        same = F.filter(
            F.sequence(F.lit(0), n - 1),
            lambda k: ((k > 0) & (F.get(s, k)["h"] == F.get(s, F.greatest(k - 1, F.lit(0)))["h"])) | ((k < n - 1) & (F.get(s, k)["h"] == F.get(s, F.least(k + 1, n - 1))["h"])),
        )
        return F.sort_array(F.transform(same, lambda k: F.get(s, k)["i"]))

    def union(p: Column) -> Column:
        n = F.size(p)
        return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, k: acc + F.when(k < n - 1, F.least(F.lit(size), F.get(p, F.least(k + 1, n - 1)) - F.get(p, k))).otherwise(F.lit(size)))

    return let(marked, lambda s: let(places(s), union))


def repeat_words(words: Column, size: int = 8) -> Column:
    """Number of words in ``size``-word windows (a power of two) found twice or more."""
    h, step = F.transform(words, lambda w: F.xxhash64(w)), 1

    def double(x: Column, far: int) -> Column:
        if far == size:
            return F.when((F.size(x) > 1) & (F.size(F.array_distinct(x)) < F.size(x)), _covered(x, size)).otherwise(F.lit(0))
        return let(_pairs(x, far), lambda y: double(y, 2 * far))

    return let(h, lambda x: double(x, step)).cast("bigint")


def lines_of(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(_WORD))


def normal(line: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(line, _BLANK, " ")))


def row_key() -> Column:
    return F.xxhash64("doc_id", "source", "text")


def _document() -> Column:
    """Names a row's document on its host: the doc_id, or the text where that is null."""
    return F.struct(F.col("doc_id"), F.when(F.col("doc_id").isNull(), F.xxhash64("text")).alias("t"))


def _host() -> Column:
    return F.coalesce("source", F.lit("\0"))


def _figures(base: DataFrame, text: Column, *more: Column) -> DataFrame:
    """doc_id, rk, the base figures and base_failed of a text, and more columns."""

    def figures(words: Column) -> Column:
        lines = lines_of(text)
        return F.struct(
            F.size(words).cast("bigint").alias("n_words"),
            F.aggregate(words, F.lit(0).cast("bigint"), lambda acc, w: acc + F.char_length(w)).alias("word_chars"),
            repeat_words(words).alias("n_repeat_words"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        )

    own = base.select("doc_id", row_key().alias("rk"), let(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)), figures).alias("f"), F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"), *more)
    own = own.select("doc_id", "rk", "f.n_words", "f.word_chars", "n_symbols", "f.n_dup_lines", "f.n_repeat_words", *[c for c in own.columns if c not in ("doc_id", "rk", "f", "n_symbols")])
    return own.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words")))


def frequent_lines(docs: DataFrame, min_docs: int = MIN_DOCS, few: int = FEW, most: float = MOST) -> DataFrame:
    """host and hash of the boilerplate lines."""
    base = documents(docs, "doc_id", "source", "text").filter("text is not null")
    hashes = base.select(_host().alias("host"), _document().alias("d"), F.explode(F.array_distinct(F.transform(lines_of(F.col("text")), lambda x: F.xxhash64(normal(x))))).alias("h"))
    counts = hashes.distinct().groupBy("host", "h").agg(F.count("*").alias("n")).filter(F.col("n") >= min(few, min_docs))
    total = base.select(_host().alias("host"), _document().alias("d")).distinct().groupBy("host").agg(F.count("*").alias("n_host"))
    by_share = (F.col("n") >= few) & (F.col("n") > most * F.col("n_host"))
    return counts.join(total, "host").filter((F.col("n") >= min_docs) | by_share).select("host", "h")


def clean(docs: DataFrame, min_docs: int = MIN_DOCS, few: int = FEW, most: float = MOST, half: float = HALF) -> DataFrame:
    """doc_id, n_words, the base figures, base_failed, n_left (words left), kept, clean_text (null for a null text)."""
    base = documents(docs, "doc_id", "source", "text")
    frequent = staged(frequent_lines(base, min_docs, few, most), "lines")
    lines = base.filter("text is not null").select(
        "doc_id", row_key().alias("rk"), _host().alias("host"), F.explode(F.array_distinct(F.transform(lines_of(F.col("text")), lambda x: F.xxhash64(normal(x))))).alias("h")
    )
    # rows with an equal key are equal rows and have the same set
    found = lines.join(frequent, ["host", "h"]).groupBy("doc_id", "rk").agg(F.collect_set("h").alias("hs"))
    found = staged(found.select(F.col("doc_id").alias("d2"), F.col("rk").alias("rk2"), "hs"), "gone")
    keyed = base.withColumn("rk", row_key())
    both = keyed.join(found.hint("merge"), keyed["doc_id"].eqNullSafe(F.col("d2")) & (F.col("rk") == F.col("rk2")), "left")
    left = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~(x.rlike(_WORD) & F.array_contains("hs", F.xxhash64(normal(x))))), "\n")
    own = _figures(both, F.coalesce("text", F.lit("")), F.when(F.col("hs").isNull(), F.col("text")).otherwise(left).alias("clean_text"), F.col("hs").isNull().alias("whole"))
    own = own.withColumn("n_left", F.when(F.col("whole"), F.col("n_words")).otherwise(F.regexp_count("clean_text", F.lit(_WORD)).cast("bigint")))
    kept = ~F.col("base_failed") & (F.col("n_left") >= half * F.col("n_words"))
    return own.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_left", kept.alias("kept"), "clean_text")


#: Of ``clean``, with the digest of its text.
ORACLE_SQL = f"""
WITH base AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id::VARCHAR, 'null ' || text) AS d, coalesce(source, chr(0)) AS host, coalesce(text, '') AS text, text IS NOT NULL AS there FROM documents),
words AS (SELECT r, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM base),
w AS (SELECT r, ws, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars FROM words),
win AS (SELECT r, i, array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM words)),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT r, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n_repeat_words FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM dup) GROUP BY r),
lines AS (SELECT r, d, host, there, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS l FROM base),
dl AS (SELECT r, (count(*) - count(DISTINCT line))::BIGINT AS n_dup_lines FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
norm AS (SELECT *, CASE WHEN there AND regexp_matches(line, '[^\\x20\\x09-\\x0D]') THEN trim(lower(regexp_replace(line, '[\\x20\\x09-\\x0D]+', ' ', 'g'))) END AS nl FROM lines),
hosts AS (SELECT host, count(DISTINCT d) AS n_host FROM base WHERE there GROUP BY host),
freq AS (SELECT host, nl FROM (SELECT host, nl, count(DISTINCT d) AS n FROM norm WHERE nl IS NOT NULL GROUP BY host, nl) JOIN hosts USING (host) WHERE n >= {MIN_DOCS} OR n >= {FEW} AND n > {MOST} * n_host),
rest AS (SELECT r, string_agg(line, chr(10) ORDER BY l) AS clean FROM norm ANTI JOIN freq USING (host, nl) GROUP BY r),
f AS (SELECT doc_id, n_words::BIGINT AS n_words, word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
 len(regexp_extract_all(coalesce(clean, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_left, coalesce(clean, '') AS clean FROM base JOIN w USING (r) LEFT JOIN cov USING (r) LEFT JOIN dl USING (r) LEFT JOIN rest USING (r)),
j AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_left >= {HALF} * n_words AS kept, n_left, sha256(clean) AS clean_sha256 FROM j
"""
