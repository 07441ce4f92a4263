from pathlib import Path

from compare import duck_rows, rows_of
from helpers import TEXTS, awkward, empty

from siltlog.llm import license_scan as S
from siltlog.llm.queries import op2_licenses, oracle_sql


def test_canonical_text(spark):
    cases = [
        ("MIT Licence\n\nCopyright (c) 2020 Some One\n\n" + S._MIT, "MIT"),
        (S._MIT.replace("sublicense", "sub-license").upper(), "MIT"),
        ("  " + S._MIT.replace(" ", "\n", 40) + "\n\nAll rights reserved.\n", "MIT"),
        ("Copyright 1999, A\n" + S._BSD_HEAD.replace("provided", "Provided") + S._BSD_TAIL, "BSD-2-Clause"),
        (S._MIT + " and more", None),
        ("", None),
        (None, None),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r["doc_id"]: r["license"] for r in S.scan_licenses(df, "doc_id", "text").collect()}
    assert got == {i: w for i, (_, w) in enumerate(cases)}


def test_neighbouring_words_are_both_respelt(spark):
    rows = [("licence licence Licences sub licence\nfavour, favour", "license license licenses sublicense favor favor"), ("unlicence licenceé", "unlicence licenceé")]
    df = spark.createDataFrame(rows, "text string, want string")
    assert [r["c"] for r in df.select(S.canonical(df["text"]).alias("c")).collect()] == [w for _, w in rows]


def test_every_known_text_is_found(spark):
    """Each is planted whole, with another copyright line and in other cases and line breaks."""
    rows = [(i, f"Copyright (c) 20{i:02d} Some One\n\n{(t.upper() if i % 2 else t).replace(' the ', chr(10) + 'the  ')}\n", name) for i, (name, t) in enumerate(S.LICENSES)]
    got = {r["doc_id"]: r["license"] for r in S.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, want string"), "doc_id", "text").collect()}
    assert got == {i: w for i, _, w in rows} and len(set(got.values())) == 9


def test_long_texts_and_other_notices(spark):
    read = lambda name: Path("/usr/share/common-licenses", name).read_text()
    apache = read("Apache-2.0")
    cases = [(apache, "Apache-2.0"), (apache.replace("[yyyy] [name of copyright owner]", "2019 Some One"), "Apache-2.0"), (apache.split("APPENDIX")[0], "Apache-2.0"), (apache + "more", None), (S._MIT, "MIT")]
    cases += [(read(f), w) for f, w in (("GPL-2", "GPL-2.0-only"), ("GPL-3", "GPL-3.0-only"), ("LGPL-2.1", "LGPL-2.1-only"), ("LGPL-3", "LGPL-3.0-only"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0"), ("GFDL-1.3", "GFDL-1.3-only"), ("Artistic", "Artistic-1.0-Perl"))]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    assert {r["doc_id"]: r["license"] for r in S.scan_licenses(df, "doc_id", "text").collect()} == {i: w for i, (_, w) in enumerate(cases)}
    notices = [("// SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0\n# SPDX-License-Identifier: MIT", "GPL-2.0-or-later WITH Classpath-exception-2.0,MIT"), ('#  Licensed under the Apache License, Version 2.0 (the "License");\n# you may not', "Apache-2.0"), ("SPDX-License-Identifier: ", "")]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(notices)], "doc_id long, text string")
    assert {r["doc_id"]: r["notices"] for r in S.scan_licenses(df, "doc_id", "text").collect()} == {i: w for i, (_, w) in enumerate(notices)}


def test_notices_and_awkward_rows(spark):
    df = spark.createDataFrame([(1, "x\nLicensed under CC BY-NC 4.0.\n  released under the MIT LICENCE!\nreleased under the MIT License"), (2, "a license? no")], "doc_id long, text string")
    got = {r["doc_id"]: r["notices"] for r in S.scan_licenses(df, "doc_id", "text").collect()}
    assert got == {1: "CC-BY-NC-4.0,MIT", 2: ""}
    rows = S.scan_licenses(awkward(spark), "doc_id", "text").collect()
    assert len(rows) == len(TEXTS) and {r["license"] for r in rows} == {None}
    assert S.scan_licenses(empty(spark), "doc_id", "text").count() == 0


def test_equals_sql(spark, sf_dir):
    assert rows_of(op2_licenses(spark, sf_dir)) == duck_rows(sf_dir, oracle_sql()["op2_licenses"])


def test_runs_no_python(spark, sf_dir):
    plan = op2_licenses(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
