"""The ten operators and the pipeline against brute force, round trips and held-out labels."""

import math
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from densitylab.llm import decontaminate, language_id, license_scan, line_rules, near_dedup, packing, quality_mil, queries, substring_dedup, textvec, tokens, toxicity, training_order
from densitylab.llm.common import components, new_path

SF = "/root/testdata/sf0.001"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = {i: i + 32 for i in range(65, 91)}
KINDS = "doc_id bigint, text string, lang string, source string, n_chars bigint, extra string"


def low_words(t):
    return ALNUM.findall((t or "").translate(LOW))


@pytest.fixture(scope="module")
def docs(spark):
    """Copies, near copies, shared passages, nulls, empty and long texts, a repeated row and an extra column."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(2, 6)))
    texts = [" ".join(word() for _ in range(r.randint(15, 120))) for _ in range(30)]
    shared = " ".join(word() for _ in range(20))
    texts += [texts[0]] * 4 + [f"{texts[1]} tail", f"{texts[2]}\n{shared}", f"{shared} {texts[3]}", texts[4].replace(" ", "  ", 3)]
    texts += [None, "", "  \n ", "!!!", "a b", " ".join(["go"] * 300), "x\0y z " * 20, " ".join(word() for _ in range(6000)), "Über den Wolken\n" * 12]
    for k in range(6):
        w = texts[5].split()
        w[k * 3] = word()
        texts.append(" ".join(w))
    rows = [(i, t, ["en", "de", None][i % 3], ["s1", "s2", None][i % 3], len(t or ""), "x") for i, t in enumerate(texts)]
    rows += [rows[0], (None, texts[7], "en", "s1", 1, "x")]
    return spark.createDataFrame(rows, KINDS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], KINDS)


def test_word_tables():
    texts = ["Ab-C1 é ß\0x", None, "", "  a\tb\nc  ", "ends", "Grüße, 東京!"] * 3
    for table, want in ((textvec.ALNUM, lambda t: low_words(t)), (textvec.SPACE, lambda t: SPACE.findall(t or ""))):
        for limit in (1, 1 << 20):
            got = []
            for w in textvec.words(pa.array(texts), table, limit=limit):
                for d in range(w.n_docs):
                    got.append(w.end[w.ptr[d] : w.ptr[d + 1]] - w.start[w.ptr[d] : w.ptr[d + 1]])
            assert [list(g) for g in got] == [[len(x.encode()) for x in want(t)] for t in texts]
    a, b = (next(textvec.words(pa.array([t]))) for t in ("x aa bb y", "aa bb"))
    assert list(a.hash[1:3]) == list(b.hash) and a.grams(2)[0][1] == b.grams(2)[0][0]


def test_order_is_a_permutation_and_shards_read_back(spark, docs, empty):
    for n in (1, 2, 3, 17, 1000):
        for key in (1, 99):
            assert sorted(training_order.permute(np.arange(n), n, key).tolist()) == list(range(n))
    folder = new_path(spark, "t")
    rows = training_order.write_shards(docs, folder, length=64, per_shard=16).collect()
    seqs = list(training_order.read_slots(folder))
    assert len(seqs) == 1 + max(r.slot for r in rows) and all(len(s) == 64 for s in seqs)
    assert [s.tolist() for s in training_order.read_slots(folder, 5, 3)] == [s.tolist() for s in seqs[5:8]]
    encode = tokens.encoder(tokens.vocabulary_path()).tokenizer.encode
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {}
    for r in rows:
        assert zlib.crc32(seqs[r.slot].tobytes()) == r.sequence_crc32
        if r.doc_id is not None and r.doc_id != 0:
            got.setdefault(r.doc_id, {})[r.start] = seqs[r.slot][r.offset : r.offset + r.length].tolist()
    for i, t in texts.items():
        if i:
            assert sum((got[i][k] for k in sorted(got[i])), []) == [*encode(t or "", add_special_tokens=False).ids, tokens.END]
    assert training_order.write_shards(empty, new_path(spark, "t")).collect() == []


def test_tokens_equal_the_tokenizer():
    r = random.Random(1)
    e = tokens.encoder(tokens.vocabulary_path())
    texts = ["", None, "it's we'LL'd İ ŉ ſ", "<|endoftext|> a", "Ωμέγα ΣΑΣ"] + ["".join(r.choice("ab'sStTd 1²!éÉ.\n –") for _ in range(50)) for _ in range(200)]
    want = e.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert [x.tolist() for x in e.encode(texts)] == [w.ids for w in want]


def test_chain_learns_and_is_out_of_fold(spark):
    r = np.random.default_rng(0)
    texts, y = [], []
    for i in range(400):
        toxic = i % 4 == 0
        texts.append(" ".join([f"w{k}" for k in r.integers(0, 50, 30)] + (["moron" if i % 8 else "scum"] if toxic else [])))
        y.append(int(toxic))
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(900, None), (901, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, v, 1) for i, v in enumerate(y)], "doc_id bigint, toxic int, quality int")
    rows = {x.doc_id: x for x in toxicity.score(d, toxicity.train(d, labels)).collect()}
    assert np.mean([rows[i].toxic == bool(v) for i, v in enumerate(y) if zlib.crc32(str(i).encode()) % 5 == 0]) > 0.97
    assert not rows[900].toxic and not rows[901].toxic
    assert toxicity.train(d, labels.limit(0)) is None and toxicity.score(d, None).filter("toxic").isEmpty()


def test_leaks_equal_brute_force(spark, docs, empty, monkeypatch):
    texts = {r.doc_id: r.text for r in docs.collect()}
    w = low_words(texts[9])
    items = [("3", " ".join(w[2:14])), ("q-20", " ".join(w[20:24]).upper()), ("100", "zz yy"), ("7", None), ("8", "!?"), ("5", texts[11]), ("3", " ".join(w[2:14])), (None, " ".join(w[30:34]))]
    bench = spark.createDataFrame([(*x, "extra") for x in items], "item_id string, text string, TEXT string")
    for block in (decontaminate.BLOCK_BYTES, 60):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
        rows = decontaminate.report(decontaminate.find_leaks(docs, bench)).collect()
        assert len(rows) == docs.count()
        for r in rows:
            own, hit, ids = low_words(texts[r.doc_id] if r.doc_id is not None else texts[7]), set(), set()
            for item, t in items:
                q = low_words(t)
                for win in [q] if 0 < len(q) < 10 else [q[i : i + 10] for i in range(len(q) - 9)]:
                    for i in range(len(own) - len(win) + 1):
                        if own[i : i + len(win)] == win:
                            hit.update(range(i, i + len(win)))
                            ids.add(item)
            assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(own), len(hit), len(ids), bool(hit))
            assert r.items_sha256 == hashlib.sha256(",".join(sorted(x for x in ids if x is not None)).encode()).hexdigest()
    assert decontaminate.find_leaks(empty, bench).count() == 0 and decontaminate.find_leaks(docs, bench.limit(0)).filter("n_hit > 0").count() == 0
    leaks = decontaminate.find_leaks(docs, bench)
    left = decontaminate.without_leaks(docs, leaks, ("doc_id", "text")).count()
    assert left == leaks.filter("n_hit = 0").count() < docs.count()


def test_blocks_of_items_are_one_scan(spark, docs, monkeypatch):
    """The plan over all hits doesn't grow with the items, nor do their ids stand in it."""
    texts = [r.text for r in docs.collect() if len(low_words(r.text or "")) > 20]
    bench = spark.createDataFrame([(f"name-{i}", " ".join(low_words(t)[3:16])) for i, t in enumerate(texts[:6])], "item_id string, text string")
    plans, plain = [], decontaminate.staged

    def spy(df, label, **more):
        if label == "leaks":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return plain(df, label, **more)

    monkeypatch.setattr(decontaminate, "staged", spy)
    found = []
    for block in (decontaminate.BLOCK_BYTES, 60):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
        found.append(sorted((r.doc_id is None, r.doc_id or 0, r.n_hit, tuple(r.item_ids)) for r in decontaminate.find_leaks(docs, bench).collect()))
    assert found[0] == found[1] and sum(n > 0 for _, _, n, _ in found[0]) >= 6
    assert len(plans) == 2 and all(p.count("Relation") == 1 and "Union" not in p and "name-" not in p for p in plans)


def test_proximity_equals_brute_force(spark, docs):
    w = low_words(docs.filter("doc_id = 9").first().text)
    phrases = [f"{w[5]} {w[8]} {w[6]}", "go go", f"{w[0]} nowhere", "", f"{w[40]} {w[1]}"]
    for slop in (2, 60):
        got = sorted((r.doc_id is None, r.doc_id or 0, r.phrase, r.position) for r in decontaminate.near_matches(docs, phrases, slop).collect())
        want = []
        for r in docs.collect():
            own = low_words(r.text)
            for p in phrases:
                terms, span = set(p.split()), len(p.split()) + slop
                hits = [[i for i in range(len(own)) if own[i] == t and all(t2 in own[max(0, i - span) : i + span + 1] for t2 in terms)] for t in sorted(terms)]
                if terms and all(hits):
                    want.append((r.doc_id, p, hits))
        found = {}
        for null, i, p, at in got:
            found.setdefault((None if null else i, p), set()).add(at)
        # a place of any one word of the phrase at which the others are near
        assert set(found) == {(i, p) for i, p, _ in want}
        assert all(any(found[i, p] <= set(h) for h in hits) for i, p, hits in want)


def test_line_rules_equal_brute_force(spark, docs, empty):
    rows = line_rules.clean(docs, min_docs=6, few=2, most=0.1).collect()
    every = docs.collect()
    hosts, norm = {}, lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", x).lower().strip(" ")
    for d in every:
        if d.text is not None:
            hosts.setdefault(d.source, {}).setdefault(d.doc_id if d.doc_id is not None else d.text, set()).update(norm(x) for x in d.text.split("\n") if SPACE.search(x))
    by = {}
    for d in every:
        t = d.text or ""
        w, lines = SPACE.findall(t), [x for x in t.split("\n") if SPACE.search(x)]
        wins = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        twice = {x for x in wins if wins.count(x) > 1} if len(wins) < 800 else set()
        covered = {k for i, x in enumerate(wins) if x in twice for k in range(i, i + 8)}
        sets = list(hosts.get(d.source, {}).values())
        frequent = {x for s in sets for x in s if (n := sum(x in o for o in sets)) >= 6 or n >= 2 and n > 0.1 * len(sets)}
        left = None if d.text is None else "\n".join(x for x in t.split("\n") if not SPACE.search(x) or norm(x) not in frequent)
        n_left = len(SPACE.findall(left or ""))
        failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        by[d.doc_id] = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed, n_left, not failed and n_left >= 0.5 * len(w), left)
    assert len(rows) == len(every) and any(r.n_left < r.n_words for r in rows)
    for r in rows:
        assert tuple(r)[1:] == by[r.doc_id], r
    assert line_rules.clean(empty).count() == 0


def test_packing_keeps_every_id(spark, docs, empty):
    five = np.array([8, 7, 6, 5, 4])
    assert sorted(np.bincount(packing.differencing(five, 2), five).tolist()) == [14, 16]  # the method's known result
    sizes = np.random.default_rng(1).integers(1, 1025, 1500)
    window = packing.pack(sizes)
    load = np.bincount(window, sizes)
    assert load.max() <= 4096 and 1 - sizes.sum() / (4096 * len(load)) < 0.02
    rows = packing.pack_documents(docs, capacity=256, chunk=64, part=64, partitions=3).collect()
    encode = tokens.encoder(tokens.vocabulary_path()).tokenizer.encode
    texts = {r.doc_id: r.text for r in docs.collect()}
    seqs, pieces = {}, {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append(r)
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 256
    for i, own in pieces.items():
        ids = [*encode(texts[i] or "", add_special_tokens=False).ids, tokens.END] if i is not None else None
        own = sorted(own, key=lambda r: r.start)
        if ids and i != 0:
            assert sum((list(r.ids) for r in own), []) == ids and {r.doc_tokens for r in own} == {len(ids)}
    assert packing.pack_documents(empty).count() == 0


def brute_labels(words, counts):
    """Labels of blocks round prefix tokens, less those that a rival beats."""
    found = []
    for i, (label, x) in enumerate(license_scan.TEMPLATES):
        own, n = set(x.split()), len(x.split())
        need = len(own) if len(own) < 12 else math.ceil(0.8 * len(own) - 1e-9)
        prefix = set(sorted(own, key=lambda w: (counts.get(w, 0), w))[: len(own) - need + 1])
        for p, w in enumerate(words):
            shared = len(own & set(words[max(0, p - n + 1) : p + n])) if w in prefix else 0
            if shared >= need:
                found.append((p, i, label, n, shared / len(own), own))
    def beaten(m):
        return any(
            o[1] != m[1] and len(m[5] & o[5]) >= 0.8 * min(len(m[5]), len(o[5])) - 1e-9 and abs(m[0] - o[0]) < max(m[3], o[3]) and (o[4] > m[4] or (m[5] < o[5] and o[4] == m[4]))
            for o in found
        )
    return {m[2] for m in found if not beaten(m)}


def test_notices_get_their_own_label(spark):
    family = {"agpl-3": "GNU Affero General Public License, version 3", "lgpl-3": "GNU Lesser General Public License version 3", "gpl-2": "GNU General Public License version 2", "gpl-3": "GNU General Public License, Version 3"}
    header = "This program is free software: you can redistribute it and/or modify it under the terms of the {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
    rows = [(k, f"words before. Licensed under the {v}. words after") for k, v in family.items()]
    rows += [(k, header.format(family[k].split(",")[0].split(" version")[0].split(" Version")[0], k[-1])) for k in family]
    rows += [("cc-by-sa", "Licensed under CC BY SA 4.0"), ("", "This file is released under the GPL license."), ("", "The album was released under a new label; the driving license of the mit singer was found."), ("cc-by-sa", "licensed under the Creative Commons Attribution-ShareAlike license")]
    rows += [(label, text) for label, text in license_scan.TEMPLATES] + [("apache-2,gpl-2", f"{rows[2][1]} or licensed under the Apache License, Version 2.0")]
    rows += [("", "license the software under terms public general of " * 400), ("mit", "\n".join(["pad " * 200, license_scan.TEMPLATES[0][1].replace("sublicense", "x"), "pad " * 200]))]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id bigint, text string")
    got = {r.doc_id: r.labels for r in license_scan.scan(docs).collect()}
    assert [got[i] for i in range(len(rows))] == [label for label, _ in rows]


def test_equal_rows_have_one_list_of_seeds(spark, monkeypatch):
    found = {}
    real = substring_dedup.staged
    monkeypatch.setattr(substring_dedup, "staged", lambda df, label, **o: found.setdefault(label, []).append(out := real(df, label, **o)) or out)
    monkeypatch.setattr(substring_dedup, "release", lambda *_: None)
    text = " ".join(f"w{i}" for i in range(120))
    for n in (20, 200):
        docs = spark.createDataFrame([(2, text)] * n + [(1, text + " end")], "doc_id bigint, text string")
        got = substring_dedup.remove_repeats(docs).collect()
        assert [r.n_removed for r in got if r.doc_id == 2] == [120] * n and [r.n_removed for r in got if r.doc_id == 1] == [0]
    sizes = [df.selectExpr("max(size(seeds))").first()[0] for df in found["seeds"]]
    assert sizes[0] == sizes[1] <= 120 and found["windows"][1].count() <= 10 * found["windows"][0].count()


def test_languages_of_repeated_and_null_ids(spark):
    text = {"en": "the cat sat on the mat and the dog ", "de": "der hund und die katze sind im haus "}
    for ids in (lambda i: 1, lambda i: None):
        rows = [(ids(i), text[lang] * 3 + (str(i) if distinct else ""), lang) for distinct in (False, True) for lang in text for i in range(40)]
        docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
        got = language_id.predict(docs, language_id.train(docs, max_train=40), ("lang",)).collect()
        assert len(got) == 160 and sum(r.lang == r.lang_pred for r in got) >= 150


def test_licenses(spark, empty):
    texts = [None, "", "Released under the MIT License.\nunder the mit license", "x Apache License, Version 2.0 y", "CC-BY-NC cc by nc", "work is licensed under the GNU general PUBLIC license version 3", "mit apache nc", "admit license", "this wor\u212A is dedicated to the public", "THIS WORK IS DEDICATED\nto the public domain\n" * 3, "x " * 20000]
    d = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(2, texts[2], "clash")], "doc_id bigint, text string, TEXT string")
    rows = {r.doc_id: r for r in license_scan.scan(d).collect()}
    assert [(rows[i].n_base, rows[i].first_word, rows[i].last_word, rows[i].base_labels) for i in range(8)] == [
        (0, None, None, ""), (0, None, None, ""), (2, 1, 5, "mit"), (1, 1, 1, "apache-2"), (2, 0, 3, "cc-by-nc"), (0, None, None, ""), (0, None, None, ""), (0, None, None, "")
    ]
    counts = {}
    for t in [*texts, texts[2]]:
        for token in set(ALNUM.findall((t or "").translate(LOW))):
            counts[token] = counts.get(token, 0) + 1
    for i, t in enumerate(texts):
        want = set(filter(None, rows[i].base_labels.split(",")))
        assert rows[i].labels == ",".join(sorted(want | brute_labels(ALNUM.findall((t or "").translate(LOW)), counts)))
    assert license_scan.scan(empty).count() == 0


def test_languages(spark, empty):
    d = queries.read(spark, SF, "documents")
    model = language_id.train(d)
    got = language_id.predict(d, model, ("doc_id", "lang")).filter(language_id.held_out())
    assert got.filter("lang = lang_pred").count() >= 0.97 * got.count()
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (4, "a")], "doc_id bigint, text string")
    assert [(r.lang_pred == "und", r.score == 0) for r in language_id.predict(odd, model).orderBy("doc_id").collect()] == [(True, True)] * 3 + [(False, False)]
    assert language_id.predict(empty, language_id.train(empty)).count() == 0
    assert {r.lang_pred for r in language_id.predict(d, language_id.train(empty)).collect()} == {"und"}


def test_languages_equal_brute_force(spark, docs):
    """Counts, posterior and choice by plain loops over the grams."""
    d = docs.collect()
    got = {(r.doc_id, r.text): r for r in language_id.predict(docs, language_id.train(docs), ("doc_id", "text")).collect()}
    m32 = (1 << 32) - 1

    def buckets(t):
        low = t.lower().replace("\0", " ")
        out = []
        for i in range(len(low)):
            if i + 1 < len(low):
                two = (ord(low[i]) * 0x9E3779B1 + ord(low[i + 1]) * 0x85EBCA77) & m32
                out.append(two)
                if i + 2 < len(low):
                    out.append((two * 0xC2B2AE3D + ord(low[i + 2]) * 0x27D4EB2F) & m32)
        return [((((x ^ (x >> 15)) * 0x2C1B3C6D) & m32) >> 12) % (language_id.BUCKETS - 1) + 1 for x in out]

    train = [r for r in d if r.lang is not None and r.text is not None and not (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)]
    langs = sorted({r.lang for r in train})
    count = {g: np.zeros(language_id.BUCKETS) for g in langs}
    for r in train:
        for b in buckets(r.text):
            count[r.lang][b] += 1
    log = {g: np.log((c + 0.5) / (c + 0.5).sum()) for g, c in count.items()}
    prior = {g: sum(r.lang == g for r in train) + 1 for g in langs}
    for r in d:
        own = got[r.doc_id, r.text]
        if not any(c.isalpha() for c in r.text or ""):
            assert (own.lang_pred, own.score) == ("und", 0)
            continue
        fit = np.array([log[g][buckets(r.text)].sum() + np.log(prior[g] / sum(prior.values())) for g in langs])
        p = np.exp(fit - fit.max())
        assert own.lang_pred == langs[fit.argmax()] and own.score == pytest.approx(1 / p.sum(), abs=2e-2)


def test_many_languages_keep_the_matrix_bounded(spark, monkeypatch):
    monkeypatch.setattr(language_id, "CELLS", language_id.BUCKETS * 2)
    d = spark.createDataFrame([(i, f"{c * 40} {c}{c}x", f"l{k}") for i, (k, c) in enumerate((k, chr(97 + k)) for k in range(8) for _ in range(9))], "doc_id bigint, text string, lang string")
    model = language_id.train(d)
    assert model.log.size <= language_id.CELLS and len(model.langs) == 8
    assert language_id.predict(d, model, ("lang",)).filter("lang <> lang_pred").count() == 0


def test_toxicity_equals_brute_force(spark, docs):
    """The chain's probabilities by plain loops over the words of every text."""
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    labels = spark.createDataFrame([(i, int("shared" in (t or "") or i % 3 == 0), 0) for i, t in texts.items()] + [(0, 1, 0), (None, 1, 0)], "doc_id bigint, toxic int, quality int")
    chain = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, chain).collect()}
    for i, t in texts.items():
        own = set()
        for word in low_words(t):
            own |= {toxicity._bucket([word])[0], int(textvec.mix64(next(textvec.words(pa.array([word]))).beginnings(6) + np.uint64(6))[0] % np.uint64(toxicity.BUCKETS))}
        p = []
        for m in chain.models:
            p.append(1 / (1 + np.exp(-(sum(m.w[k] for k, v in enumerate(chain.vocabulary.tolist()) if v in own) + sum(a * b for a, b in zip(p, m.d)) + m.b))))
        assert [got[i][f"p_{c}"] for c in toxicity.CHAIN] == pytest.approx(p, abs=1e-9)
        assert got[i].toxic == (p[-1] >= toxicity.THRESHOLD) and got[i].score == got[i].p_toxic
    assert not {r.h for r in docs.filter("doc_id is null").select(toxicity.held_out().alias("h")).collect()} - {False}


def test_words_are_chosen_without_the_fold_they_predict(monkeypatch):
    r, seen = np.random.default_rng(2), []
    rows = [np.unique(r.integers(0, 40, 12)) for _ in range(90)]
    begin, y, fold = np.r_[0, np.cumsum([len(x) for x in rows])], (np.arange(90) % 3 == 0).astype(float), np.arange(90) // 30
    pick = toxicity.vocabulary
    monkeypatch.setattr(toxicity, "vocabulary", lambda b, at, own: seen.append(len(own)) or pick(b, at, own))
    toxicity.fit_chain(np.concatenate(rows), begin, np.column_stack([y, y]), fold)
    assert seen == [90, 60, 60, 60]


def plain_model(x, dense, y, new, new_dense):
    """Logistic regression by the same falling Adam steps, over whole matrices."""
    z, m, v = np.column_stack([x, dense, np.ones(len(x))]), 0.0, 1e-12
    t = np.zeros(z.shape[1])
    t[-1] = np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
    keep = np.r_[np.full(z.shape[1] - 1, 2e-4), 0.0]
    for k in range(1, 151):
        g = z.T @ (1 / (1 + np.exp(-np.clip(z @ t, -30, 30))) - y) / len(y) + keep * t
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g**2
        t = t - 0.15 * (1 - k / 151) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return 1 / (1 + np.exp(-np.clip(np.column_stack([new, new_dense, np.ones(len(new))]) @ t, -30, 30)))


def test_chain_is_trained_as_by_plain_loops():
    """Every link, its out-of-fold inputs and the words of every fold against whole matrices."""
    r = np.random.default_rng(4)
    n, words = 120, 30
    toxic = (np.arange(n) % 3 == 0).astype(float)
    x = r.random((n, words)) < np.where(toxic[:, None] > 0, 0.15 + 0.6 * (np.arange(words) < 6), 0.2)
    poor = np.where(np.arange(n) % 5 == 0, np.nan, ((np.arange(n) % 4 == 0) | x[:, 20]).astype(float))
    weak = toxic * x[:, 2]
    marks, fold = np.column_stack([poor, weak, toxic]), np.arange(n) % 7 % 3
    rows = [np.flatnonzero(own) for own in x]
    begin = np.r_[0, np.cumsum([len(own) for own in rows])]
    chain = toxicity.fit_chain(np.concatenate(rows), begin, marks, fold)

    def chosen(at):
        own = [np.flatnonzero(x[i]) for i in at]
        return toxicity.vocabulary(np.concatenate(own), np.r_[0, np.cumsum([len(o) for o in own])], toxic[at])

    every, before, seen = np.arange(n), np.zeros((n, 0)), np.zeros((n, 0))
    for y in marks.T:
        known, unseen = ~np.isnan(y), np.zeros(n)
        for f in range(3):
            train, test = every[fold != f], every[fold == f]
            own, fit = chosen(train), train[known[train]]
            unseen[test] = plain_model(x[np.ix_(fit, own)], before[fit], y[fit], x[np.ix_(test, own)], before[test])
        own, fit = chosen(every), every[known]
        seen = np.column_stack([seen, plain_model(x[np.ix_(fit, own)], before[fit], y[fit], x[:, own], seen)])
        before = np.column_stack([before, unseen])
    assert np.allclose(chain.predict(np.concatenate(rows), begin), seen, atol=1e-6)


def test_the_chain_learns_from_earlier_marks(spark):
    """Log loss of the toxic link on held-out documents, with the chain's inputs and with the toxic link alone."""
    docs, labels = queries.read(spark, SF, "documents"), queries.read(spark, SF, "labels")
    chain = toxicity.train(docs, labels)
    marks = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None}
    rows = [r for r in toxicity.score(docs, chain).filter(toxicity.held_out()).collect() if r.doc_id in marks]
    loss = lambda p: -np.mean([np.log(np.clip(q if marks[r.doc_id] else 1 - q, 1e-6, 1)) for r, q in zip(rows, p)])
    base = np.mean(list(marks.values()))
    assert rows and loss([r.p_toxic for r in rows]) < 0.5 * loss([base] * len(rows))


def test_samples_of_labelled_rows_are_bounded(spark):
    d = spark.createDataFrame([(i % 50, f"text {i} " * (i % 7 + 1), "x") for i in range(400)] + [(3, None, "x"), (None, "null id", "x"), (60, "long " * 5000, "x")], "doc_id bigint, text string, TEXT string")
    labels = spark.createDataFrame([(i, (i or 0) % 2, "y") for i in [*range(50), 60, 7, None]], "doc_id bigint, toxic int, Toxic string")
    from pyspark.sql import functions as F

    from densitylab.llm.common import labelled

    rows = labelled(d, labels, "toxic", F.col("doc_id") < 10, 1000, 10_000).collect()
    assert sorted(r.doc_id for r in rows) == list(range(10, 50)) and all(r.text == min(f"text {i} " * (i % 7 + 1) for i in range(400) if i % 50 == r.doc_id) for r in rows)
    assert sum(len(r.text) for r in labelled(d, labels, "toxic", F.lit(False), 1000, 400).collect()) < 900
    assert 0 < labelled(d, labels, "toxic", F.lit(False), 20, 10_000).count() < 40


def test_minhash_estimates_the_index():
    r = np.random.default_rng(0)
    h = r.integers(0, 1 << 63, 300, dtype=np.uint64)
    a, b = np.sort(h[:240]), np.sort(h[60:])
    reg = near_dedup.probminhash(np.repeat([0, 1], 240), np.r_[a, b], np.ones(480), 2, 4000)
    assert abs((reg[0] == reg[1]).mean() - 0.6) < 0.03


def near_truth(texts):
    sets = {i: ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())) for i, w in ((i, low_words(t)) for i, t in texts.items())}
    up = {i: i for i in texts}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_near_duplicates_equal_brute_force(spark, docs, empty):
    truth = near_truth({r.doc_id: r.text for r in docs.collect() if r.doc_id is not None})
    rows = near_dedup.near_duplicate_classes(docs).collect()
    assert {r.doc_id: r.class_id for r in rows if r.doc_id is not None} == truth
    assert [r.class_id for r in rows if r.doc_id is None] == [None] and len(rows) == len(truth) + 1
    assert near_dedup.near_duplicate_classes(empty).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 20)] + [(30, 40), (40, 35)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(21), 0), 30: 30, 35: 30, 40: 30}


def cut_truth(texts):
    words = {i: SPACE.findall(t or "") for i, t in texts.items()}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][k : k + 13]), i)
    out = {}
    for i, w in words.items():
        gone = {x for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for x in range(k, k + 13)}
        out[i] = [x for k, x in enumerate(w) if k not in gone]
    return words, out


def test_substrings_equal_brute_force(spark, docs, empty):
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    words, kept = cut_truth(texts)
    rows = substring_dedup.remove_repeats(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r.doc_id is not None:
            assert SPACE.findall(r.kept_text or "") == kept[r.doc_id] and r.n_removed == len(words[r.doc_id]) - len(kept[r.doc_id])
            assert (r.kept_text is None) == (texts[r.doc_id] is None)
            own = words[r.doc_id]
            cut = {k for x in r.repeats for k in range(x["first"], x["last"] + 1)}
            assert [x for k, x in enumerate(own) if k not in cut] == kept[r.doc_id] and len(cut) == r.n_removed
            assert all(x["last"] - x["first"] >= 12 for x in r.repeats)
        else:
            assert r.n_removed == r.n_words
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_quality_gradient_and_accuracy(spark, empty):
    r = np.random.default_rng(3)
    m, x, begin, y = quality_mil.Model(), r.normal(size=(9, quality_mil.SIZE)), np.array([0, 2, 3, 9]), np.array([1.0, 0.0, 1.0])
    m.p["c"] = r.normal(size=quality_mil.HIDDEN)
    loss = lambda: -np.mean(np.log(np.where(y > 0, p := m.forward(x, begin)[-1], 1 - p)))
    for name, g in m.gradient(x, begin, y).items():
        at = tuple(r.integers(0, s) for s in m.p[name].shape)
        old = m.p[name][at]
        m.p[name][at] = old + 1e-5
        up = loss()
        m.p[name][at] = old - 1e-5
        down = loss()
        m.p[name][at] = old
        assert g[at] == pytest.approx((up - down) / 2e-5, abs=1e-6)
    plain = lambda t: SPACE.findall(t)
    texts = ["a b a\tb  c", "", "  lead " + "é word " * 100, "x" * 5000 + " y"]
    x, begin = quality_mil.passages(pa.array(texts))
    m = quality_mil.Model(3)
    for i, t in enumerate(texts):
        w, want = plain(t), []
        for lo in range(0, max(1, len(w)), 64):
            own, row = w[lo : lo + 64], np.zeros(quality_mil.SIZE)
            starts = [v.start() for v in SPACE.finditer(t)]
            part = t[starts[lo] : starts[lo + 64] if lo + 64 < len(w) else None].encode() if own else b""
            for c in part:
                row[0 if chr(c).isspace() and c < 128 else min(c, 128)] += 1  # white space is one kind
            row[:129] = np.sqrt(row[:129] / max(len(part), 1))
            if own:
                row[129:] = (len(own) - len(set(own))) / len(own), sum(v in w[: lo + k] for k, v in enumerate(own)) / len(own), min(sum(len(v.encode()) for v in own) / len(own) / 16, 4), len(own) / 64
            want.append(row)
        assert np.allclose(x[begin[i] : begin[i + 1]], want, atol=1e-6)
        h = np.tanh(np.array(want) @ m.p["W"] + m.p["b"])
        e = np.array([np.exp((np.tanh(v @ m.p["V"]) / (1 + np.exp(-(v @ m.p["U"])))) @ m.p["w"]) for v in h])
        assert m.scores(x, begin)[i] == pytest.approx(1 / (1 + np.exp(-((e / e.sum()) @ h @ m.p["c"] + m.p["d"][0]))), abs=1e-6)
    d, labels = queries.read(spark, "/root/testdata/sf0.01", "documents"), queries.read(spark, "/root/testdata/sf0.01", "labels")
    got = quality_mil.score(d, quality_mil.train(d, labels)).join(labels, "doc_id").filter(quality_mil.held_out())
    assert got.filter("predicted = quality").count() >= 0.93 * got.count()
    odd = spark.createDataFrame([(1, None), (2, ""), (3, " ")], "doc_id bigint, text string")
    assert len({x.score for x in quality_mil.score(odd, None).collect()}) == 1
    assert quality_mil.score(empty, None).count() == 0


def test_pipeline_equals_its_stages(spark):
    docs = {r.doc_id: r for r in queries.read(spark, SF, "documents").collect()}
    d = queries.read(spark, SF, "documents")
    found = language_id.predict(d, language_id.train(d))
    texts = {r.doc_id: docs[r.doc_id].text for r in found.collect() if r.lang_pred != "und" and r.score >= 0.5}
    truth = near_truth(texts)
    texts = {i: t for i, t in texts.items() if truth[i] == i}
    words, kept = cut_truth(texts)
    bench = [low_words(r.text) for r in queries.read(spark, SF, "benchmark").collect()]
    windows = {tuple(q[i : i + 10]) for q in bench for i in range(max(1, len(q) - 9)) if q}
    left = {}
    for i, w in kept.items():
        own = low_words(" ".join(w))
        if (w or not words[i]) and not any(tuple(own[k : k + n]) in windows for n in {len(x) for x in windows} for k in range(len(own) - n + 1)):
            left[i] = w
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(left)
    encode = tokens.encoder(tokens.vocabulary_path()).tokenizer.encode
    sizes = {}
    for r in rows:
        sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r.length
    assert sizes == {i: len(encode(" ".join(w), add_special_tokens=False).ids) + 1 for i, w in left.items()}
    docs_of = d
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs_of = stage(spark, docs_of, SF)
        assert docs_of.columns == list(corpus_pipeline.COLUMNS)


def test_clashing_and_missing_columns(spark, docs):
    """Extra columns of clashing names, equal texts in another case, and a table without some columns."""
    from pyspark.sql import functions as F

    clash = docs.select("doc_id", "text", "lang", "source", "n_chars", F.lit(7).alias("DOC_ID"), F.lit("no").alias("Text"), F.lit("no").alias("kept"), F.lit(1).alias("score"), F.lit(2).alias("rank"), F.lit(3).alias("id"))
    labels = spark.createDataFrame([(i, i % 2, i % 3 // 2, "x") for i in range(40)], "doc_id bigint, quality int, toxic int, QUALITY string")
    bench = spark.createDataFrame([(1, "go go go", "no")], "item_id bigint, text string, doc_id string")
    run = {
        "order": lambda d: training_order.write_shards(d, new_path(spark, "c"), length=64, per_shard=16).select("doc_id", "start", "length"),
        "toxic": lambda d: toxicity.score(d, toxicity.train(d, labels)),
        "leaks": lambda d: decontaminate.report(decontaminate.find_leaks(d, bench)),
        "lines": lambda d: line_rules.clean(d),
        "pack": lambda d: packing.pack_documents(d, partitions=2).select("doc_id", "start", "length", "ids_crc32"),
        "license": lambda d: license_scan.scan(d),
        "language": lambda d: language_id.predict(d, language_id.train(d)),
        "repeats": lambda d: substring_dedup.remove_repeats(d),
        "quality": lambda d: quality_mil.score(d, quality_mil.train(d, labels)),
        "near": lambda d: near_dedup.near_duplicate_classes(d),
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        run[name] = lambda d, stage=stage: stage(spark, d, SF)
    for name, f in run.items():
        assert sorted(map(str, f(clash).collect())) == sorted(map(str, f(docs).collect())), name
        if name not in dict(corpus_pipeline.STAGES) and name != "near":
            assert f(docs.select("doc_id").limit(3)).count() >= 3, name  # a missing text is null
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), labels)).count() == 0


def test_pipeline_stages_take_any_rows(spark, docs, empty, monkeypatch):
    read = corpus_pipeline.read
    for d in (docs, empty):
        monkeypatch.setattr(corpus_pipeline, "read", lambda s, f, t, d=d: d if t == "documents" else read(s, f, t))
        rows = corpus_pipeline.run(spark, SF).collect()
        assert bool(rows) == (d is docs)


def test_contract_columns(spark):
    want = {
        "op4_line_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
        "op5_packing": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
        "op6_license_scan": {"doc_id": "bigint", "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "string", "labels": "string", "score": "double"},
        "op3_decontamination": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
        "op7_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
        "op10_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
        "op9_substring_dedup": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    }
    for name, kinds in want.items():
        got = dict(queries.QUERIES[name](spark, SF).dtypes)
        assert {k: got[k] for k in kinds} == kinds
