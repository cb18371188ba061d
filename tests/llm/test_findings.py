"""Rows and texts that the operators once left out or cut short."""

import math
from collections import Counter

import numpy as np
import pytest

from sievework.llm import bpe, common, licenses, ngram_join, ppm, queries, urlfilter, vecdedup


def test_bpe_of_odd_white_space_alone(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    texts = ["a   b", "\u0085", "x   　　 y", "     "]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: tokenizer.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}
    for size in (8 << 20, 4, 1):
        assert {r["doc_id"]: r["ids"] for r in bpe.encode(rows, path, decoded=True, slice_bytes=size).collect()} == want


def _twins():
    """Two unlike words of 1,024 letters whose sums of letters times powers of any number agree modulo 2^64."""
    first = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    return first, first.translate(str.maketrans("ab", "ba"))


def test_words_that_polynomials_confuse(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    texts = [" ".join(f"{w} {x}" for x in "cdefgh") for w in _twins()]
    rows = spark.createDataFrame(list(enumerate([*texts, " ".join(texts)])), "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in bpe.encode(rows, path).collect()}
    assert got == {r["doc_id"]: tokenizer.encode(r["text"], add_special_tokens=False).ids for r in rows.collect()}
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(rows.where("doc_id < 2"), 3, 90).collect()} == {0: 0, 1: 1}


def test_keep_one_decides_by_row(spark):
    words = lambda s, n=40: " ".join(f"{s}{i}" for i in range(n))
    near = words("a") + " end"
    rows = [
        (1, words("a"), "x"), (None, near, "x"),  # linked: the row with an id stays
        (None, words("b"), "x"), (None, words("c"), "x"),  # null ids, each alone
        (2, words("d"), "x"), (3, words("d") + " end", "x"), (3, words("e"), "x"),  # of the two texts of 3 only one links
        (None, words("f"), "x"), (None, words("f"), "y"), (None, words("f") + " end", "x"),  # null ids alone keep one
        (4, words("g"), "x"), (4, words("g"), "y"),  # equal rows keep one
        (5, None, "x"), (5, "", "x"), (None, None, "x"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = ngram_join.keep_one(df)
    assert out.columns == df.columns
    got = [(r["doc_id"], (r["text"] or "")[:1]) for r in out.collect()]
    assert Counter(got) == Counter([(1, "a"), (None, "b"), (None, "c"), (2, "d"), (3, "e"), (None, "f"), (4, "g"), (5, ""), (5, ""), (None, "")])


def test_urls_far_from_all_seeds(spark):
    # distrust runs against links: the last host of each chain links to a blocked page
    rows = [(i, f"http://h{i}.net/", f'<a href="http://h{i + 1}.net/">') for i in range(30)] + [(30, "http://h30.net/", '<a href="http://bad.example.org/es/1">'), (31, "http://bad.example.org/es/1", "")]
    rows += [(32, "http://good.org/", '<a href="http://g0.net/">')] + [(33 + i, f"http://g{i}.net/", f'<a href="http://g{i + 1}.net/">') for i in range(3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: (r["verdict"], r["trust"], r["distrust"]) for r in urlfilter.judge(df, queries.URL_RULES).collect()}
    assert all(got[i][0] == "block" and got[i][2] > 0 for i in range(32)) and all(got[i][0] == "allow" for i in range(32, 36))
    # each link hands on 0.85 of the rank before it
    assert all(abs(got[i][2] / got[i + 1][2] - 0.85) < 1e-5 for i in range(30))


MIT = """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
GPL3 = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not
use this file except in compliance with the License. You may obtain a copy of
the License at

    http://www.apache.org/licenses/LICENSE-2.0
"""


def test_licenses_over_lines(spark):
    comment = lambda mark, t: "".join(f"{mark} {x}".rstrip() + "\n" for x in t.splitlines())
    flat = lambda t: " ".join(t.split())
    known = {
        MIT: "mit", comment("#", MIT): "mit", flat(MIT.partition("One")[2]): "mit", comment(" *", MIT.partition("One")[2]): "mit", "The MIT License (MIT)\n\nCopyright": "mit",
        GPL3: "gpl-3.0", comment("//", GPL3): "gpl-3.0", GPL3.replace(" General", " Affero General"): "agpl-3.0", GPL3.replace("GNU ", "GNU Lesser ").replace("program", "library").replace("version 3", "version 2.1"): "lgpl-2.1",
        "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n": "gpl-3.0", "GNU GENERAL PUBLIC LICENSE\r\nVersion 2, June 1991\r\n": "gpl-2.0", "Apache License\n   Version 2.0, January 2004": "apache-2.0",
        BSD: "bsd", comment("--", BSD): "bsd", flat(BSD): "bsd", ISC: "isc", flat(ISC): "isc", APACHE: "apache-2.0", comment("#", APACHE): "apache-2.0", flat(APACHE.partition("at\n")[0]): "apache-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy": "mpl-2.0", "This is free and\nunencumbered software released into the public domain.": "unlicense",
        **{f"{mark}SPDX-License-Identifier: {x}{end}\nint x;": name for mark, end in (("// ", ""), ("# ", ""), ("/* ", " */"), ("<!-- ", " -->")) for x, name in (("MIT", "mit"), ("Apache-2.0", "apache-2.0"), ("BSD-2-Clause", "bsd"), ("BSD-3-Clause", "bsd"), ("GPL-2.0-only", "gpl-2.0"), ("GPL-3.0-or-later", "gpl-3.0"), ("LGPL-2.1+", "lgpl-2.1"), ("CC-BY-SA-4.0", "cc-by-sa-4.0"), ("ISC", "isc"))},
        "A text about the MIT License and permission to use it.": None, "This is not\na copyright notice, but licensed": None, "SPDX-License-Identifier: \n\nnothing": None,
    }
    texts = list(known)
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {texts[r["doc_id"]]: r["license"] for r in got} == known
    own = {texts[r["doc_id"]]: r["sentence_ids"] for r in got}
    assert own[MIT] == ["MIT-TITLE", "MIT-GRANT", "MIT-KEEP"] and own[BSD] == ["BSD-GRANT", "BSD-SOURCE", "BSD-BINARY"] and own[ISC] == ["ISC-GRANT"]


def _lm_wanted(rows, held, order):
    """doc_id and score by one model of all texts that are not held out, and how many nodes it has."""
    data = [(r["doc_id"], b" ".join((r["text"] or "").encode().lower().split())) for r in rows.collect()]
    grams, begins, lengths = ppm.symbols([t for d, t in data if d not in held], order)
    inside = np.concatenate([np.arange(b, b + n) for b, n in zip(begins, lengths)])
    nodes = [np.unique(grams[inside] & np.uint64((1 << 8 * (k + 1)) - 1), return_counts=True) for k in range(order + 1)]
    return [(d, x) for (d, _), x in zip(data, ppm.Model(nodes).texts([t for _, t in data]))], sum(len(g) for g, _ in nodes)


def _same_scores(got, want):
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    got, want = sorted(((r["doc_id"], r["score"]) for r in got), key=key), sorted(want, key=key)
    assert [d for d, _ in got] == [d for d, _ in want]
    assert np.allclose([x for _, x in got], [x for _, x in want], rtol=1e-6)


@pytest.mark.parametrize("order", [5, 3, 2, 0])
def test_lm_parts_of_the_trie_are_the_whole(spark, monkeypatch, order):
    monkeypatch.setattr(ppm, "SLICE", 20_000, raising=False)
    odd = spark.createDataFrame([(None, "zz q"), (-1, ""), (-2, None), (-3, "\u00e1\u0142 \U0001f600"), (-3, "again")], "doc_id long, text string")
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(odd)
    got = ppm.score(rows, order).collect()
    held = {r["doc_id"] for r in got if r["held_out"]}
    assert held
    _same_scores(got, _lm_wanted(rows, held, order)[0])


def test_lm_keeps_more_than_two_million_nodes(spark):
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789+-*/=%&$", np.uint8)
    texts = np.random.default_rng(2).choice(letters, (1000, 1000))
    rows = spark.createDataFrame([(i, t.tobytes().decode()) for i, t in enumerate(texts)], "doc_id long, text string")
    got = ppm.score(rows).collect()
    want, n = _lm_wanted(rows, {r["doc_id"] for r in got if r["held_out"]}, ppm.ORDER)
    assert n > 2_000_000
    _same_scores(got, want)


def test_quality_sql_on_odd_texts(spark, tmp_path):
    import duckdb

    texts = [None, "", " \t\n", "a b c", "1 2 3 " * 4, "the cat sat on the mat and the dog ate it all up", "- x\n- x\n", "wait...\nthe cat and the dog sat on the mat with a hat...", "x " * 12, "# " * 20, "\u00e1\u0142 \U0001f600 " * 6]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op10_quality_rules(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(queries.ORACLE_SQL["op10_quality_rules"])
    names = [c[0] for c in want.description]
    key = lambda r: r[0]
    assert sorted(map(tuple, got.select(*names).collect()), key=key) == sorted(want.fetchall(), key=key)


def test_vectors_at_and_around_the_threshold(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(150):
        x, y = np.linalg.qr(rng.normal(size=(24, 2)))[0].T
        for j, cosine in enumerate((1.0, 0.98 + 1e-6, 0.98 - 1e-6, 0.99, 0.95)):
            rows.append((10 * i + j, ((cosine * x + math.sqrt(1 - cosine * cosine) * y) * (1 + i)).tolist(), i % 3))
    v = np.array([r[1] for r in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    linked = (v @ v.T >= 0.98) & (label[:, None] == label) & ~np.eye(len(rows), dtype=bool)
    want = {r[0]: int(linked[k].sum()) for k, r in enumerate(rows)}
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, cid string")
    for shard, block in ((1500, 4096), (60, 32)):
        got = {r["vec_id"]: r["n_links"] for r in vecdedup.near_duplicates(df, shard=shard, block=block).collect()}
        assert set(got) == set(want) and all(got[k] <= want[k] for k in want)
        assert sum(got.values()) >= (1.0 if shard > 1000 else 0.9) * sum(want.values())


def test_thresholds_keep_their_bound(spark):
    for counts, bound in (([10_000 + i for i in range(100)], 10), ([5] * 50 + [6], 10), ([1 << 40] * 20 + [3], 20), ([], 5), ([7], 0)):
        df = spark.createDataFrame([(n,) for n in counts], "n long")
        least = common.threshold_for(df, "n", bound)
        kept = [n for n in counts if n >= least]
        assert len(kept) <= bound and (not counts or bound < len(counts) or len(kept) == len(counts))
