import re
from re import _parser

import pytest

from pagemill.llm import licenses
from pagemill.llm.queries import op3_license_scan

FOLD = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def brute(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))
    at, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        found = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        at += found
        labels |= {label} if found else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_base_of_the_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op3_license_scan(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(texts[r["doc_id"]])
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1
    assert sum(r["n_base"] for r in rows) > 0


def test_rules_labels_and_edges(frame):
    docs = {
        1: "Released under the MIT License.",
        2: "mit license mit--license, MIT\nLICENSE",
        3: "Licensed under the GNU Lesser General Public License, version 3 or later.",
        4: "Licensed under CC BY-NC 4.0.",
        5: "SPDX-License-Identifier: BSD-3-Clause",
        6: None,
        7: "",
        8: "permit licenses",
        9: "This is in the public domain. All rights reserved.",
        10: "é " * 4000 + "Apache License" + " é" * 4000 + " apache license",
        11: "general public license general public license",
        12: "Kelvin license",
    }
    rows = {r["doc_id"]: r for r in licenses.scan_licenses(frame(list(docs.items()))).collect()}
    for i, t in docs.items():
        r = rows[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(t), i
    labels = {i: r["labels"] for i, r in rows.items()}
    assert labels[1] == "mit" and rows[1]["score"] == 0.97
    assert labels[3] == "gpl,lgpl" and rows[3]["score"] == 0.99  # gpl stays for the base; the rule found lgpl alone
    assert labels[4] == "cc by nc"
    assert labels[9] == "proprietary,public domain"
    assert labels[6] == labels[7] == labels[8] == "" and rows[8]["score"] == 0
    assert rows[10]["last_word"] == 8002


def test_containment_and_priority(spark):
    texts = spark.createDataFrame([("a", " licensed under the apache license version 2 0 and cc by sa 4 0 ")], "key string, norm string")
    got = sorted((r["label"], r["tier"], r["first"], r["end"]) for r in licenses.detections(texts, spark).collect())
    assert got[0] == ("apache", 1, 0, 8)
    assert ("cc by sa", 2, 9, 14) in got and not any(g[0] == "cc by" for g in got)


def samples(parsed, wide):
    """A shortest (or wider) text for each first branch of a regex, and for each top branch."""
    out = [""]
    for op, arg in parsed:
        kind = str(op)
        if kind == "LITERAL":
            more = [chr(arg)]
        elif kind in ("MAX_REPEAT", "MIN_REPEAT"):
            least = max(arg[0], 1) if wide else arg[0]
            more = [s * least for s in samples(arg[2], wide)[:1]]
        elif kind == "SUBPATTERN":
            more = samples(arg[3], wide)
        elif kind == "BRANCH":
            more = [s for branch in arg[1] for s in samples(branch, wide)]
        elif kind == "IN":
            more = [chr(arg[0][1] if str(arg[0][0]) == "LITERAL" else arg[0][1][0])]
        else:
            more = ["x"]
        out = [a + b for a in out for b in more][:40]
    return out


@pytest.mark.parametrize("wide", [False, True])
def test_every_signature_meets_its_keyword_and_the_gate(wide):
    gate = re.compile(licenses.GATE)
    assert len(licenses.SIGNATURES) >= 150 and len({s[0] for s in licenses.SIGNATURES}) >= 50
    for (label, tier, sure, keyword, pattern), (*_, regex) in zip(licenses.SIGNATURES, licenses.rule_rows(), strict=True):
        assert 1 <= tier <= licenses.TIERS and 0 < sure <= 1
        for text in samples(_parser.parse(pattern), wide):
            assert re.search(regex, f" {text} "), (label, text)
            assert keyword in text and gate.search(text), (label, text)


TEXTS = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice",
    "apache": "you may not use this file except in compliance. You may obtain a copy of the License at\n\n http://www.apache.org/licenses/LICENSE-2.0\n",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "zlib": "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "boost": "// SPDX-License-Identifier: BSL-1.0",
    "json": "The Software shall be used for Good, not Evil.",
}


def test_texts_of_licenses(frame):
    rows = {r["doc_id"]: r for r in licenses.scan_licenses(frame(list(enumerate(TEXTS.values())))).collect()}
    for i, label in enumerate(TEXTS):
        found = set(rows[i]["labels"].split(","))
        assert label in found and found <= {label, "public domain", "gpl"} and rows[i]["score"] >= 0.9, (label, found)


def test_repeated_rows_nulls_and_empty_tables(frame):
    docs = frame([(1, "MIT license"), (1, "MIT license"), (None, "MIT license"), (None, None)])
    got = sorted((r["doc_id"] or -1, r["n_base"], r["labels"]) for r in licenses.scan_licenses(docs).collect())
    assert got == [(-1, 0, ""), (-1, 1, "mit"), (1, 1, "mit"), (1, 1, "mit")]
    assert licenses.scan_licenses(docs.limit(0)).count() == 0


def test_no_python_in_the_plan(frame):
    plan = licenses.scan_licenses(frame([(1, "MIT license")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


ODD = ["", " ", "\x00", "a", " a", "a ", "\n\t a\x0b\x7f", "A_b@c[D]`e{f}~", "\U0001f600", "\U0001f600 -\u00e9\u212a.", "0\u00a09", "." * 100_000, "x" * 100_000, "a." * 50_000, ".a" * 50_000]


def test_words_of_odd_texts(frame):
    rows = {r["doc_id"]: r["n_words"] for r in licenses.scan_licenses(frame(list(enumerate(ODD)))).collect()}
    assert rows == {i: brute(t)[0] for i, t in enumerate(ODD)}


def test_gate_over_any_separators_and_case(spark):
    between = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    gate = re.compile("|".join(p.replace(" ", between) for p in licenses.GATE_PHRASES))
    texts = [made for p in licenses.GATE_PHRASES for made in (p, p.upper(), f"sub{p}s", p.replace(" ", "\n--_"), p.replace(" ", ""), p.replace(" ", "\u00a0"), p[1:], p.replace("i", "\u0130"))]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    passed = {r["i"] for r in docs.select("i", licenses._gated(licenses._spaced(docs["text"])).alias("norm")).where("norm IS NOT NULL").collect()}
    assert passed == {i for i, t in enumerate(texts) if gate.search(t.translate(FOLD))} and 0 < len(passed) < len(texts)


def test_whole_texts_are_gone_through_cheaply(frame):
    """No list of all words of a text, no regex of forty branches at each of its places; a filter makes single-spaced words once."""
    plan = licenses.scan_licenses(frame([(1, "MIT license")]))._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"regexp_(?:extract_all|count)\((?:coalesce\()?text#", plan)
    assert not re.search(r"RLIKE\([^\n]{0,60}, \(\?i\)licen\|", plan)
    assert all(line.count("regexp_replace(") <= 1 for line in plan.splitlines() if re.match(r"[ :+-]*Filter ", line))
