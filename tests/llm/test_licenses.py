"""Licence scans: planted texts, lines and spellings."""

import os
import time

import pytest

from plantstate.llm import licenses

SCHEMA = "doc_id long, text string, `text.x` string, DIGEST string"
COMMON = "/usr/share/common-licenses"


def scan(spark, texts, known=None):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], SCHEMA)
    return {r.key: r for r in licenses.scanned(df, known).collect()}


def test_entire_texts_in_other_spellings(spark):
    mit = licenses.KNOWN["MIT"]
    texts = [
        mit, mit.upper(), mit.replace("\n\n", " "), "Copyright (c) 2019 A. Person\n\n" + mit, "© Somebody\n(c) another\n" + mit, mit.replace("noninfringement", "non-infringement").replace("sublicense", "sub-licence"),
        mit.replace(", ", " ,\n* "), mit + " And more.", None, "", " ... \n --", "x\n" + mit,
    ]
    got = scan(spark, texts)
    assert [got[i].license for i in range(7)] == ["MIT"] * 7
    assert [got[i].license for i in range(7, 12)] == [None] * 5
    assert len({got[i].digest for i in (8, 9, 10)}) == 1


def test_lines_and_repeated_rows(spark):
    text = "Some prose here.\n  released under the MIT licence!\nLicensed under CC BY-NC 4.0.\nreleased under the MIT License\nReleased under the MIT License, of course"
    got = licenses.scanned(spark.createDataFrame([(1, text, "x", "y"), (1, text, "x", "y"), (2, "GPL", "x", "y")], SCHEMA)).collect()
    assert sorted((r.key, list(r.notices)) for r in got) == [(1, ["CC BY-NC 4.0 notice", "MIT notice"])] * 2 + [(2, [])]
    assert licenses.scanned(spark.createDataFrame([], SCHEMA)).count() == 0


def test_own_table_of_known_texts(spark):
    known = spark.createDataFrame([("house", "Use it as you like. The owner keeps the rights."), ("same", "use it, as you like; the holder keeps the rights")], "name string, text string")
    got = scan(spark, ["Use it as you like.\nThe owner keeps the rights.", licenses.KNOWN["MIT"]], known)
    assert got[0].license == "house" and got[1].license is None


@pytest.mark.skipif(not os.path.isdir(COMMON), reason="no licence files")
def test_shipped_digests(spark):
    names = {"Apache-2.0": "Apache-2.0", "GPL-3": "GPL-3.0", "GPL-2": "GPL-2.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    texts = [open(f"{COMMON}/{n}", encoding="utf-8").read() for n in names]
    got = scan(spark, [t.replace("\n", "\r\n") for t in texts])
    assert [got[i].license for i in range(len(texts))] == list(names.values())


def test_long_text(spark):
    long = "gpl owner https copyright (c) licence\n" * 250_000
    started = time.time()
    got = scan(spark, [long, long + "Released under the MIT License."])
    assert got[1].notices == ["MIT notice"] and got[0].license is None
    assert time.time() - started < 60
