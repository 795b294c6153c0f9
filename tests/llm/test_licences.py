"""License scans: canonical digests of lines and whole texts, and the SQL on awkward rows."""

import os

import duckdb
import pytest

from kinespark.llm import licences

TEXTS = [
    "CC-BY-4.0",
    "Released under CC-BY-SA-4.0",
    "x\nCC_BY-ND 4.0.\ny",
    "MIT License" + " " * 5000 + ".",
    "  © 2020 A. Body\nCopyright (c) 2019 by B\n" + licences.TEXTS["BSD-3-Clause"].replace("; ", ";\n").replace(" AND ON", "\nAND ON"),
    licences.TEXTS["BSD-2-Clause"] + "\n" + licences.TEXTS["BSD-2-Clause"],
    "mit license\nMIT LICENCE\nApache-2.0 License",
    "copyright notice of no one\nall rights reserved",
    None,
    "",
    "\n\n",
    "word " * 300_000 + "\nLicensed under the MIT License",
]


def test_notices_in_any_spelling_and_whole_texts(spark):
    df = spark.createDataFrame([(k, t, "clash", 1) for k, t in enumerate(TEXTS)] + [(0, TEXTS[0], "clash", 1), (None, TEXTS[0], None, None)], "doc_id long, text string, licence string, _r int")
    got = [tuple(r) for r in licences.scan(df).collect()]
    by = {r[0]: r[2:] for r in got}
    assert len(got) == len(TEXTS) + 2
    assert by[0] == ("CC-BY-4.0", "CC-BY-4.0", 1) == by[None] and by[1] == ("CC-BY-SA-4.0", "CC-BY-SA-4.0", 1)
    assert by[2] == (None, "CC-BY-ND-4.0", 1) and by[3] == ("MIT", "MIT", 1) and by[4] == ("BSD-3-Clause", "", 0)
    assert by[5] == (None, "BSD-2-Clause", 2) and by[6] == (None, "Apache-2.0,MIT", 3) and by[11] == (None, "MIT", 1)
    assert all(by[k] == (None, "", 0) for k in (7, 8, 9, 10))
    documents = df.select("doc_id", "text").toPandas()  # noqa: F841
    want = duckdb.sql(licences.sql()).fetchall()
    assert sorted(want, key=str) == sorted(got, key=str)


def test_more_texts_are_a_parameter(spark):
    df = spark.createDataFrame([(1, "My own TERMS, v1!")], "doc_id long, text string")
    assert licences.scan(df).first()["licence"] is None
    assert licences.scan(df, {"own": "my own terms v1"}).first()["licence"] == "own"


def test_digests_of_long_texts():
    folder = "/usr/share/common-licenses"
    if not os.path.exists(f"{folder}/Apache-2.0"):
        pytest.skip("no licence texts here")
    with open(f"{folder}/Apache-2.0", encoding="utf-8") as f:
        text = f.read()
    found = licences.hashlib.sha256(licences.canonical(text.upper().replace("\n", "\r\n")).encode()).hexdigest()
    assert licences.LONG_TEXTS[found] == "Apache-2.0"
