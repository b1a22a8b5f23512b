from __future__ import annotations

import textwrap

from semspark.llm import licenses

ISC = """ISC License

Copyright (c) 2020, Some One

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

""" + licenses.KNOWN[3][1].split("appear in all copies.\n")[1]


def test_usual_forms(spark):
    whole = dict(licenses.known_texts()[len(licenses.KNOWN):])
    assert set(whole) == {"Apache-2.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0"}
    rows = [("MIT", "MIT License\n\nCopyright 2019 A. Person\n\n" + licenses.KNOWN[0][1]), ("ISC", ISC), *whole.items()]
    rows += [("Apache-2.0", whole["Apache-2.0"].split("January 2004\n")[1]), (None, "MIT License"), (None, "Copyright law is old.\n" + licenses.KNOWN[0][1])]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r["license"] for r in licenses.scan(df, licenses.known_digests(spark)).collect()}
    assert got == {i: name for i, (name, _) in enumerate(rows)}


def test_wrapping_says_nothing(spark):
    texts = {"MIT": licenses.KNOWN[0][1], "BSD-3-Clause": licenses.KNOWN[2][1], "ISC": ISC.split("\n\n", 2)[2]}
    whole = dict(licenses.known_texts()[len(licenses.KNOWN):])["Apache-2.0"].split("January 2004\n")[1].split("licenses/\n")[1]
    rows = [(name, textwrap.fill(text, width)) for name, text in texts.items() for width in range(40, 101, 3)]
    rows += [("Apache-2.0", "\n\n".join(textwrap.fill(x, width) for x in whole.split("\n\n"))) for width in range(50, 101, 10)]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: (r["license"], r["digest"]) for r in licenses.scan(df, licenses.known_digests(spark)).collect()}
    assert [got[i][0] for i in range(len(rows))] == [name for name, _ in rows]
    assert len({d for _, d in got.values()}) == len({name for name, _ in rows})


def test_spellings(spark):
    pairs = [("one per\ncent of licence licence", "one percent of license license"), ("sub\nlicence", "sublicense"), ("copyright\nowners owners", "copyright holders owners"), ("a  fulfil\n\nfulfil b", "a fulfill fulfill b")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i long, a string, b string")
    from pyspark.sql import functions as F

    got = df.select(licenses.canonical(licenses.bare_lines(F.col("a"))).alias("x"), "b").collect()
    assert all(r["x"] == r["b"] for r in got)
