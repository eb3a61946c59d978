import numpy as np

from plinth.llm import licences as L


def brute(text):
    """The report of one document by plain Python over the fitted model."""
    classes, features, w, temperature = L.fit()
    at = {g: k for k, g in enumerate(features)}
    out = []
    for pos, line in enumerate((text or "").split("\n")):
        gs = L.grams(L.words(line))
        known = [at[g] for g in gs if g in at]
        if not known:
            continue
        z = (w[known].sum(axis=0) + w[-1]) / temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        likely = classes[int(z.argmax())]
        overlap = 0.0
        for t in L.NOTICES.get(likely, []):
            own = L.grams(L.words(t))
            both = len(set(own) & set(gs))
            if both >= min(L.MIN_GRAMS, len(own)):
                overlap = max(overlap, both / min(len(own), len(gs)))
        if likely not in (L.UNKNOWN, L.NONE) and p.max() >= L.MIN_PROBABILITY and overlap >= L.MIN_OVERLAP:
            out.append((pos, likely, round(float(p.max()), 9), round(overlap, 9)))
        elif 1 - p[classes.index(L.NONE)] >= L.MIN_ANY:
            out.append((pos, L.UNKNOWN, round(float(1 - p[classes.index(L.NONE)]), 9), round(overlap, 9)))
    return out


def test_scan_equals_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {}
    for r in L.query(spark, sf).collect():
        got.setdefault(r["doc_id"], []).append((r["pos"], r["family"], round(r["probability"], 9), round(r["overlap"], 9)))
    assert {d: sorted(v) for d, v in got.items()} == {d: b for d, t in rows if (b := brute(t))}


def test_notices_are_found_and_prose_is_not(spark):
    found = [(f, t) for f, ts in L.NOTICES.items() for t in ts]
    prose = ["She studied at MIT.", "Er kam mit dem Zug.", "The public domain of the king.", "A general public meeting.", "", None, "gnu"]
    df = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(found)] + [(1000 + k, t) for k, t in enumerate(prose)], "doc_id long, text string")
    got = {r["doc_id"]: r["family"] for r in L.scan(df).collect()}
    assert sum(got.get(k) == f for k, (f, _) in enumerate(found)) == len(found)
    assert not [k for k in got if k >= 1000]


def test_edge_rows(docs, no_docs, spark):
    L.scan(docs).collect()
    assert L.scan(no_docs).count() == 0
    twice = spark.createDataFrame([(1, "Released under the MIT License."), (1, "Released under the MIT License."), (None, "x\nReleased under the MIT License.")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["pos"]) for r in L.scan(twice).collect()) == [(0, 1), (1, 0)]


# Notices that stand in no training text, as they are found in the wild, and the family of each.
UNSEEN = [
    ("MIT", "Code is made available under the MIT License, see LICENSE."), ("MIT", "the software is distributed under the mit license"),
    ("MIT", "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software."),
    ("GPL", "This file is part of Foo. Foo is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3."),
    ("GPL", "Foo is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL", "All code here is under the GNU GPL, version 2 or later."), ("LGPL", "You may link to this library under the GNU Lesser General Public License, version 3."),
    ("AGPL", "The server code is licensed under the GNU Affero General Public License, version 3 (AGPL-3.0)."),
    ("Apache-2.0", 'Copyright 2019 The Authors. Licensed under the Apache License, Version 2.0 (the "License").'), ("Apache-2.0", "Everything in this repository is covered by the Apache License 2.0."),
    ("Apache-2.0", 'distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following three conditions are met"), ("BSD", "The driver is available under a BSD-style license."),
    ("BSD", "Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("MPL-2.0", "The library is covered by the Mozilla Public License, version 2.0."), ("BSL-1.0", "Use, modification and distribution are subject to the Boost Software License, Version 1.0."), ("ISC", "The package is published under the ISC License."),
    ("Zlib", "Permission is granted to anyone to use this library for any purpose, including commercial applications, and to alter it and redistribute it freely."),
    ("CC-BY", "Photos on this page are licensed under a Creative Commons Attribution 4.0 International License."), ("CC-BY-SA", "The article text is available under CC BY-SA 4.0."), ("CC-BY-NC", "All figures are licensed under CC BY-NC 4.0 unless noted."),
    ("CC0", "The data set is released under CC0 1.0."), ("Unlicense", "This is free and unencumbered software released into the public domain by its authors."),
    ("unknown", "All rights reserved by the publisher."), ("unknown", "Licensed under the Eclipse Public License 1.0."), ("unknown", "This font is licensed under the SIL Open Font License, Version 1.1."),
    ("unknown", "No part of this document may be reproduced without the written permission of the copyright holder."),
]
PROSE = [
    "The notice on the door said the shop was closed.", "Her rights as a tenant were limited by the contract, and the court said so.", "He made a copy of the key without permission.",
    "The distribution of rainfall over the year is uneven.", "Software engineers met to discuss the version of the plan.", "The apache trail runs through the desert.", "The material is provided to students by the school.",
    "Public transport is free for children.", "Conditions of use change with the season.", "The warranty on the fridge expired in June.", "Source of income: none.", "General terms were agreed upon.",
]


def test_unseen_notices_and_prose(spark):
    df = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(UNSEEN)] + [(1000 + k, t) for k, t in enumerate(PROSE)], "doc_id long, text string")
    got = {r["doc_id"]: r["family"] for r in L.scan(df).collect()}
    right = sum(got.get(k) == f for k, (f, _) in enumerate(UNSEEN))
    wrong = [(f, got[k]) for k, (f, _) in enumerate(UNSEEN) if got.get(k, f) not in (f, L.UNKNOWN)]
    assert not wrong and right >= 0.9 * len(UNSEEN)
    assert sum(k >= 1000 for k in got) <= 1


def test_families_left_out_are_seldom_taken_for_others():
    """Of paragraphs of families that a fit hasn't seen, few get another family: those that licences share, such as disclaimers."""
    _, strange, classes = L.left_out(5)
    temperature = L.fit()[3]
    taken = 0
    for z, _ in strange:
        p = np.exp(z / temperature - np.logaddexp.reduce(z / temperature))
        taken += p.max() >= L.MIN_PROBABILITY and classes[int(p.argmax())] not in (L.UNKNOWN, L.NONE)
    assert taken <= 0.2 * len(strange)


def test_wrapped_notices_are_scored_as_blocks(spark):
    text = "Some title\n\nPermission is hereby\ngranted, free of charge,\nto any person\nobtaining a copy\nof this software and\nassociated documentation files\n \t\nEnd.\nReleased under the MIT License.\nmore prose"
    got = [(r["pos"], r["n_lines"], r["family"]) for r in L.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()]
    assert (10, 1, "MIT") in got and (2, 6, "MIT") in got and len(got) == 2


def test_a_long_text_and_clashing_columns(spark):
    long = "word " * 300_000 + "\nLicensed under CC BY-SA 4.0.\n" + "text " * 300_000
    df = spark.createDataFrame([(1, long, "x", 1), (2, None, None, None), (3, "", "", 0)], "doc_id long, text string, line string, pos int")
    assert [(r["doc_id"], r["pos"], r["family"]) for r in L.scan(df).collect()] == [(1, 1, "CC-BY-SA")]
