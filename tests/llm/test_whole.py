"""The whole job of the training-data operators, on cases that narrower forms miss."""

from collections import Counter

import pyarrow as pa

from densitylab.llm import license_scan, line_rules, near_dedup

KINDS = "doc_id bigint, text string, source string"


def body(i):
    return " ".join(f"w{i}x{k}" for k in range(30))


def cleaned(spark, rows, **limits):
    return {r.doc_id: r for r in line_rules.clean(spark.createDataFrame(rows, KINDS), **limits).collect()}


def test_boilerplate_lines_are_removed(spark):
    rows = [(i, f"  Home |  About\n\n{body(i)}\r\nSHARE this page {'now ' * i}", "s") for i in range(25)] + [(25, "home | about\n" * 15 + body(25), "s"), (26, None, "s"), (27, "", "s"), (28, "Home | About", None)]
    rows.append(rows[0])
    got = cleaned(spark, rows)
    for i in range(25):
        assert got[i].clean_text == rows[i][1].split("\n", 1)[1] and got[i].n_left == got[i].n_words - 3
    assert got[25].clean_text == body(25) and (got[25].n_words, got[25].n_left) == (75, 30) and not got[25].kept and got[0].kept
    assert got[26].clean_text is None and got[27].clean_text == "" and got[28].clean_text == "Home | About"
    assert line_rules.clean(spark.createDataFrame(rows, KINDS)).count() == len(rows)


def test_rows_of_one_id_are_one_document(spark):
    rows = [(1, f"{body(i)}\nsame footer", "s") for i in range(30)] + [(i, body(i), "s") for i in range(2, 40)]
    rows += [(None, f"{body(k % 2)}\nnull footer", "n") for k in range(30)]
    got = line_rules.clean(spark.createDataFrame(rows, KINDS)).collect()
    assert sorted(r.clean_text or "" for r in got) == sorted(t for _, t, _ in rows)


def test_frequent_lines_at_every_host_size(spark):
    rows = [(i, body(i) + ("\nhot footer" if i < 20 else ""), "hot") for i in range(2500)]
    rows += [(3000 + i, body(i) + "\nsmall footer", "small") for i in range(19)]
    rows += [(4000 + i, body(i) + "\npair footer", "pair") for i in range(2)]
    rows += [(5000 + i, body(i) + ("\nhalf footer" if i < 5 else ""), "half") for i in range(10)]
    got = cleaned(spark, rows)
    cut = Counter(s for i, t, s in rows if got[i].clean_text != t)
    assert cut == {"hot": 20, "small": 19}
    assert all(got[i].clean_text == body(i) for i in range(20))


def test_wrapping_splits_no_notice(spark):
    notices = {
        "bsd": ["Redistribution and use in source and binary forms, with or without", "modification, are permitted provided that"],
        "mpl-2": ["# This Source Code Form is subject to the terms of the Mozilla Public", "# License, v. 2.0. If a copy"],
        "isc": ["Permission to use, copy, modify, and/or distribute this software for any", "", "purpose with or without fee is hereby granted, provided"],
    }
    rows = [(label, "head line\n" + "\n".join(lines) + "\ntail") for label, lines in notices.items()]
    rows += [(f"{i}/words", "\n".join(text.split())) for i, (_, text) in enumerate(license_scan.TEMPLATES)]
    rows += [("far", "redistribution and use in source and binary forms with or without\n" + "filler words here " * 10 + "\nmodification are permitted"), ("none", None)]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id bigint, text string")
    got = {rows[r.doc_id][0]: r for r in license_scan.scan(docs).collect()}
    assert all(label in got[label].labels.split(",") and got[label].score == 1 for label in notices)
    assert all(got[f"{i}/words"].labels == label for i, (label, _) in enumerate(license_scan.TEMPLATES))
    assert got["far"].labels == "" and got["far"].score == 0 and got["none"].labels == "" and got["none"].n_words == 0
    assert {m.label for m in got["bsd"].matches} == {"bsd"}


def test_repeated_passages_change_no_band():
    one, two = ([f"{c}{i}" for i in range(30)] for c in "ab")
    texts = [" ".join([*one * k, *one[:4], *two, *two[:4]]) for k in (1, 2, 50)]
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1, 2], pa.int64()), pa.array(texts)], names=["id", "text"])
    (got,) = near_dedup._signatures(near_dedup.SHINGLE, near_dedup.BANDS, near_dedup.ROWS)(iter([batch]))
    keys = got.column(3).to_pylist()
    assert len(keys) == 3 and keys[0] == keys[1] == keys[2]
