"""License scan as an exact set-similarity join (operator 6), DataFrame functions only.

Templates are whole license texts, standard headers and short notices.  A text block is a stretch of words
round a template's token, at most one template's length to either side, whatever the lines, so that a
block never is much longer than the template.  A block meets a template if it holds at least
THRESHOLD of the template's distinct words; notices of fewer than SHORT distinct words must be whole, as a
few common words meet by chance.  Tokens are ordered by their frequency in the whole corpus, rarest first
(only the templates' own tokens can be shared, so only they are counted).  With o the overlap that
a template T needs:

* prefix: a stretch that meets T holds one of T's first |T| - o + 1 tokens; blocks are made round these alone;
* length: the block has at least o distinct words;
* position: if the first shared token is T's i-th, i + o - 1 <= |T|.

Templates of one family share most of their words (RIVALS of the smaller one's).  Where two of them meet in one
block, the one with less containment goes, and of equal ones the one whose words the other has all of (a GPL notice inside an
AGPL notice); other ties stay.

Texts without a prefix token are passed over after one look; blocks that pass the
filters are verified.  The templates are fixed values, so they go into the plan
and texts are never shuffled.

Defined results: null and empty texts have no words, labels '' and score 0.
score is the greatest containment of a template in a block that meets it, 1 where
a base phrase stands, else 0.  Repeated rows get equal results.  Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents
from .line_rules import let

THRESHOLD, SHORT, RIVALS = 0.8, 12, 0.8

_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# License texts, headers and short notices in lower case, words joined by blanks, by label.
TEMPLATES = [
    ("mit", """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the
 software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit
 persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies
 or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of
 merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability
 whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"""),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("isc", """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and
 this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties
 of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of
 use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"""),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of
 source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice
 this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright
 holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose
 are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not
 limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract
 strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"""),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("apache-2", """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license
 at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
 without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"""),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("gpl-2", """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software
 foundation either version 2 of the license or at your option any later version"""),
    ("gpl-3", """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software
 foundation either version 3 of the license or at your option any later version"""),
    ("lgpl-3", """this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software
 foundation either version 3 of the license or at your option any later version"""),
    ("agpl-3", """this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software
 foundation either version 3 of the license or at your option any later version"""),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3"),
    ("agpl-3", "licensed under the gnu affero general public license version 3"),
    ("mpl-2", """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at
 http mozilla org mpl 2 0"""),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "licensed under the creative commons attribution license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "licensed under the creative commons attribution noncommercial license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "licensed under the creative commons attribution sharealike license"),
    ("public-domain", "this work is dedicated to the public domain"),
    ("proprietary", "all rights reserved no part may be reproduced without permission"),
]


def folded(text: Column) -> Column:
    """A-Z in lower case, and no other letter."""
    return F.translate(text, _UPPER, _LOWER)


def words_of(low: Column) -> Column:
    """Runs of digits, a-z and non-ASCII characters; Java matches the gaps between them much faster than them."""
    return F.array_remove(F.split(F.regexp_replace(low, _GAP, " "), " "), "")


def needed(tokens: set[str], threshold: float) -> int:
    return len(tokens) if len(tokens) < SHORT else math.ceil(threshold * len(tokens) - 1e-9)


def prefixes(order: dict[str, int], threshold: float = THRESHOLD) -> list[tuple[str, list[str], int, list[str], int]]:
    """label, tokens in order, overlap needed, prefix, words of each template."""
    out = []
    for label, text in TEMPLATES:
        tokens = sorted(set(text.split()), key=lambda t: (order.get(t, 0), t))
        need = needed(set(tokens), threshold)
        out.append((label, tokens, need, tokens[: len(tokens) - need + 1], len(text.split())))
    return out


def rivals() -> list[tuple[int, int, bool]]:
    """(template, another of its family, whether the other has all its words)."""
    own = [set(text.split()) for _, text in TEMPLATES]
    return [(i, j, a < b) for i, a in enumerate(own) for j, b in enumerate(own) if i != j and len(a & b) >= RIVALS * min(len(a), len(b)) - 1e-9]


def token_order(docs: DataFrame) -> dict[str, int]:
    """Texts that hold each token of the templates; a bounded number of counts."""
    vocabulary = sorted({t for _, text in TEMPLATES for t in text.split()})
    words = F.array_distinct(words_of(folded(F.col("text"))))
    held = documents(docs, "text").select(F.explode(F.array_intersect(words, F.array(*map(F.lit, vocabulary)))).alias("token"))
    return {r.token: r.n for r in held.groupBy("token").agg(F.count("*").alias("n")).collect()}


_PLACES = "array<struct<word: bigint, label: string>>"


def _places(joined: Column, phrase: str, label: str) -> Column:
    """Word number and label of each place of a phrase in words with one blank before and after each."""
    # every part but the last ends right before a phrase; the words up to there number its start
    sizes = F.transform(F.split(joined, f" (?={phrase} )"), lambda p: F.size(words_of(p)))

    def starts(s: Column) -> Column:
        ends = F.sequence(F.lit(1), F.size(s) - 1)
        return F.transform(ends, lambda k: F.struct(F.aggregate(F.slice(s, 1, k), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("word"), F.lit(label).alias("label")))

    return F.when(joined.contains(f" {phrase} "), let(sizes, starts)).otherwise(F.array().cast(_PLACES))


def scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches (word, label, score)."""
    rules = prefixes(token_order(docs), threshold)
    rare = sorted({t for *_, p, _ in rules for t in p})
    listed = lambda words: F.array(*map(F.lit, words))
    rules_column = F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(label).alias("label"), listed(t).alias("tokens"), F.lit(o).alias("need"), listed(p).alias("prefix"), F.lit(n).alias("length")) for i, (label, t, o, p, n) in enumerate(rules)])
    of_token = {t: [i for i, (*_, p, _) in enumerate(rules) if t in p] for t in rare}
    rules_of = F.create_map(*[x for t, own in of_token.items() for x in (F.lit(t), F.array(*map(F.lit, own)))])

    def meets(words: Column, at: Column) -> Column:
        """Matches of the templates that have the word at ``at`` in their prefix, in the block round it."""

        def match(t: Column) -> Column:
            def of(block: Column) -> Column:
                first = F.array_position(t["tokens"], F.element_at(F.array_intersect(t["prefix"], block), 1))  # place in T, from 1, of the rarest shared token
                passed = (F.size(block) >= t["need"]) & (first + t["need"] - 1 <= F.size(t["tokens"]))
                shared = F.when(passed, F.size(F.array_intersect(t["tokens"], block))).otherwise(F.lit(0))
                return F.struct(at.cast("bigint").alias("word"), t["rule"].alias("rule"), t["label"].alias("label"), t["length"].alias("length"), shared.alias("shared"), t["need"].alias("need"), (shared / F.size(t["tokens"])).alias("score"))

            begin = F.greatest(at - t["length"] + 1, F.lit(0))
            return let(F.array_distinct(F.slice(words, begin + 1, at + t["length"] - begin)), of)

        own = F.transform(rules_of[F.get(words, at)], lambda i: F.get(rules_column, i))
        return F.filter(F.transform(own, match), lambda m: m["shared"] >= m["need"])

    pairs = F.create_map(*[x for i, j, inside in rivals() for x in (F.lit(i * 1000 + j), F.lit(inside))])

    def best(every: Column) -> Column:
        """Matches without those that a rival in their block beats."""

        def beaten(m: Column) -> Column:
            def by(o: Column) -> Column:
                inside = pairs[m["rule"] * 1000 + o["rule"]]
                near = F.abs(m["word"] - o["word"]) < F.greatest(m["length"], o["length"])
                return inside.isNotNull() & near & ((o["score"] > m["score"]) | (inside & (o["score"] == m["score"])))

            return F.exists(every, by)

        return F.transform(F.filter(every, lambda m: ~beaten(m)), lambda m: F.struct(m["word"].alias("word"), m["label"].alias("label"), m["score"].alias("score")))

    def blocks(words: Column) -> Column:
        held = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda p: F.array_contains(listed(rare), F.get(words, p)))
        return let(F.flatten(F.transform(held, lambda p: meets(words, p))), best)

    empty = F.array().cast("array<struct<word: bigint, label: string, score: double>>")

    def places(joined: Column) -> Column:
        """(word, label) of each place of a phrase; ``joined``: words with one blank before and after each."""
        return F.concat(*[_places(joined, phrase, label) for phrase, label in PHRASES.items()])

    low = folded(F.coalesce("text", F.lit("")))

    def row(words: Column) -> Column:
        near = F.arrays_overlap(words, listed(rare))
        heads = F.arrays_overlap(words, F.array(*map(F.lit, ["mit", "apache", "nc"])))
        return F.struct(
            F.size(words).cast("bigint").alias("n_words"),
            F.when(near, blocks(words)).otherwise(empty).alias("matches"),
            F.when(heads, let(F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")), places)).otherwise(F.array().cast(_PLACES)).alias("base"),
        )

    out = documents(docs, "doc_id", "text").select("doc_id", let(words_of(low), row).alias("f")).select("doc_id", "f.*")
    at = F.transform("base", lambda b: b["word"])
    own = F.array_sort(F.array_distinct(F.transform("base", lambda b: b["label"])))
    every = F.array_sort(F.array_union(own, F.transform("matches", lambda m: m["label"])))
    best = F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0))
    return out.select(
        "doc_id",
        "n_words",
        F.size("base").cast("bigint").alias("n_base"),
        F.array_min(at).alias("first_word"),
        F.array_max(at).alias("last_word"),
        F.array_join(own, ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(best).alias("score"),
        "matches",
    )


def _oracle() -> str:
    values = ", ".join(f"({i}, '{label}', {len(t.split())}, {needed(set(t.split()), THRESHOLD)}, {sorted(set(t.split()))})" for i, (label, t) in enumerate(TEMPLATES))
    family = ", ".join(f"({i}, {j}, {inside})" for i, j, inside in rivals())
    phrases = " UNION ALL ".join(
        f"SELECT r, i - 1 AS word, '{label}' AS label FROM places WHERE array_to_string(ws[i:i + {len(p.split()) - 1}], ' ') = '{p}'" for p, label in PHRASES.items()
    )
    return f"""
WITH base AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS text FROM documents),
w AS (SELECT r, doc_id, regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM base),
places AS (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
hits AS ({phrases}),
b AS (SELECT r, count(*) AS n_base, min(word) AS first_word, max(word) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM hits GROUP BY r),
v AS (SELECT * FROM (VALUES {values}) v(rule, label, length, need, tokens)),
family AS (SELECT * FROM (VALUES {family}) f(rule, other, inside)),
t AS (SELECT rule, len(tokens) AS n, need, unnest(tokens) AS token FROM v),
df AS (SELECT token, count(DISTINCT r) AS n FROM (SELECT r, ws[i] AS token FROM places) JOIN (SELECT DISTINCT token FROM t) USING (token) GROUP BY token),
pre AS (SELECT rule, token FROM (SELECT rule, t.n, need, token, row_number() OVER (PARTITION BY rule ORDER BY coalesce(df.n, 0), token) AS k FROM t LEFT JOIN df USING (token)) WHERE k <= n - need + 1),
m AS (SELECT * FROM (SELECT r, i - 1 AS word, v.rule, v.label, v.length, v.need, len(list_intersect(v.tokens, ws[greatest(i - v.length + 1, 1):i + v.length - 1])) AS shared, len(v.tokens) AS n
 FROM places JOIN pre ON pre.token = ws[i] JOIN v ON v.rule = pre.rule) WHERE shared >= need),
lost AS (SELECT DISTINCT a.r, a.word, a.rule FROM m a JOIN family f ON f.rule = a.rule JOIN m o ON o.r = a.r AND o.rule = f.other
 WHERE abs(a.word - o.word) < greatest(a.length, o.length) AND (o.shared / o.n > a.shared / a.n OR (f.inside AND o.shared / o.n = a.shared / a.n))),
kept AS (SELECT r, label, shared / n AS score FROM m ANTI JOIN lost USING (r, word, rule)),
ml AS (SELECT r, max(score) AS score FROM kept GROUP BY r),
al AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM kept UNION ALL SELECT r, label FROM hits) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels,
coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(score, 0)::DOUBLE END AS score
FROM w LEFT JOIN b USING (r) LEFT JOIN ml USING (r) LEFT JOIN al USING (r)
"""


ORACLE_SQL = _oracle()
