import re
from math import ceil

from tabassay.llm.license_scan import (
    BLOCK_END, NOT_WORD, PHRASES, TEMPLATES, THRESHOLD, matching_blocks, scan_licenses,
)
from tabassay.llm.queries import op6_license_scans

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def places(text):
    words = WORD.findall((text or "").translate(LOWER))
    found = [
        (k, label)
        for phrase, label in PHRASES.items()
        for k in range(len(words))
        if words[k : k + len(phrase.split())] == phrase.split()
    ]
    return len(words), sorted(found)


def matches(text):
    found = {}
    for block in re.split(BLOCK_END, text or ""):
        words = {w for w in re.split(NOT_WORD, block.lower()) if w}
        for label, template in TEMPLATES:
            own = {w for w in re.split(NOT_WORD, template.lower()) if w}
            if len(words & own) >= ceil(THRESHOLD * len(own) - 1e-9):
                found[label] = max(found.get(label, 0), len(words & own) / len(own))
    return found


def check(found, docs):
    rows = {(r.doc_id, r.n_words): r for r in found.collect()}
    for row in docs.collect():
        n_words, base = places(row.text)
        one, templates = rows[row.doc_id, n_words], matches(row.text)
        assert sorted((p.start, p.label) for p in one.places) == base
        assert one.labels == sorted({label for _, label in base} | set(templates))
        expected = 1.0 if base else max(templates.values(), default=0.0)
        assert abs(one.score - expected) < 1e-9


def test_statements(spark, tricky):
    texts = [
        "Released under the MIT License.", "Intro words.\nLicensed under CC BY-NC 4.0.", "cc by nc",
        "under the mit license, apache license version 2 under THE mit  license",
        "This work is licensed under the GNU General Public License, version 3. More follows here.",
        "this work is licensed under the GNU general license, version 3", "mit", None, "",
        "the redistribution and use in source and binary forms with or without modification are "
        "permitted provided that these conditions are met",
        "Apache-License_Version-2", "éunder the mit license", "under the mit licenseé", "\n\n.\n",
    ]
    rows = [(k, t, None, None, "x") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(
        rows, "doc_id long, text string, words string, line string, label string"
    )
    found = scan_licenses(docs)
    assert found.count() == len(texts)
    check(found, docs)
    blocks = matching_blocks(docs)
    assert blocks.filter("doc_id = 4").select("block", "label").collect() == [(0, "gpl")]


def test_tricky_rows(tricky, empty):
    found = scan_licenses(tricky)
    assert found.count() == tricky.count()
    check(found, tricky)
    assert scan_licenses(empty).count() == 0


def test_query(spark, data, documents):
    found = {r.doc_id: r for r in op6_license_scans(spark, data).collect()}
    for row in documents.collect():
        n_words, base = places(row.text)
        one = found[row.doc_id]
        starts = [k for k, _ in base]
        assert (one.n_words, one.n_base) == (n_words, len(base))
        assert (one.first_word, one.last_word) == (
            min(starts, default=None), max(starts, default=None),
        )
        assert one.base_labels == ",".join(sorted({label for _, label in base}))
    assert any(r.labels for r in found.values())


WRAPPED = {
    "mit": "Copyright (c) 2020 A. N. Other\n\nPermission is hereby granted, free of charge, to any "
    "person obtaining a copy\nof this software and associated documentation files (the "
    '"Software"), to deal\nin the Software without restriction',
    "bsd": "# Redistribution and use in source and binary forms, with or without\n"
    "# modification, are permitted provided that the following conditions are met:\n# 1. Keep",
    "gpl": " * This program is free software; you can redistribute it and/or modify\r\n"
    " * it under the terms of the GNU General Public License as published by\r\n *\r\n"
    " * the Free Software Foundation; either version 2 of the License",
    "mpl-2": "/* This Source Code Form is subject to the terms of the Mozilla Public\n"
    " * License, v. 2.0. If a copy of the MPL was not distributed with this file */",
}


def test_statements_across_block_ends(spark):
    one_word_a_line = [(label, "\n".join(text.split())) for label, text in TEMPLATES]
    texts = [*TEMPLATES, *one_word_a_line, *WRAPPED.items()]
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(texts)], "doc_id int, text string")
    found = {r.doc_id: r for r in scan_licenses(docs).collect()}
    for k, (label, text) in enumerate(texts):
        assert label in found[k].labels, text
        if k < 2 * len(TEMPLATES):
            assert found[k].score == 1.0


def test_seams_reach_no_further_than_a_template(spark):
    far = "released " + "under the " * 3 + "x " * 9 + ".\n" + "y " * 9 + "MIT License"
    parts = "We were released.\n" + "z " * 5 + "under the MIT License"
    docs = spark.createDataFrame([(0, far), (1, parts)], "doc_id int, text string")
    assert matching_blocks(docs).count() == 0


def test_blocks_have_one_row_a_template(spark):
    text = "Released under the MIT License.\nReleased under the MIT License."
    docs = spark.createDataFrame([(0, text), (None, text)], "doc_id int, text string")
    blocks = matching_blocks(docs)
    assert blocks.select("doc_id", "block", "template").distinct().count() == blocks.count() == 4
