import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeloom.operators import header


@pytest.mark.parametrize(
    "code, want",
    [
        ("#!/usr/bin/env python\n# -*- coding: utf-8 -*-\n# pylint: disable=x\nx = 1", "x = 1\n"),
        ("# coding: utf-8\nx = 1", "# coding: utf-8\nx = 1\n"),
        ("# a\n# All rights reserved\n# b\n\n# c\nx", "\n# c\nx\n"),
        ('"""Apache License"""\n"""doc"""\nx', '"""doc"""\nx\n'),
        ("x\n", "x\n\n"),
        ("# only\n", None),
        ('"""never closed\nx = 1\n', None),
        ("r'''raw'''\nx", "r'''raw'''\nx\n"),
        ("'''a\nb''''''c\n'''\nx", "'''a\nb'''\n'''c\n'''\nx\n"),
        ("# MIT LICENSE\nx", "x\n"),
    ],
)
def test_strip_header(code, want):
    assert header.strip_header(code) == want


def test_kinds_agree_with_expression(spark):
    texts = ["#!python", "# ! /usr/bin/python", "x -*- coding: a", "# coding=utf8", "#x\n# coding=utf8", "# pylint: x", "bsd \n license", "# spdx-license-identifier", "", "# plain", "#pylint", "copyright (c) 2"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", header.comment_kind(F.col("t")).alias("k")).collect()
    assert {r["t"]: r["k"] for r in rows} == {t: header.kind_of(t) for t in texts}


def test_blank_runs(spark):
    texts = ["   a", "    a", "        a", "a    b", "    # c    d", "      ", "", "a\n    b"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", header.mark_blanks(F.col("t")).alias("m")).collect()
    got = {r["t"]: r["m"] for r in rows}
    assert got == {t: "\n".join(map(header.mark_line, t.split("\n"))) for t in texts}
    assert got["        a"] == "<4BLANK><4BLANK>a" and got["      "] == "" and got["    # c    d"] == "    # c    d"
    back = spark.createDataFrame([("<4BLANK>x<8BLANK>y<16BLANK>",)], "t string").select(header.unmark_blanks(F.col("t"))).first()[0]
    assert back == " " * 4 + "x" + " " * 8 + "y" + " " * 16


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="#'\" \nabx=", max_size=60))
def test_header_keeps_the_code(code):
    found, begin = header.leading_comments(code.split("\n"))
    got = header.strip_header(code)
    if begin is None:
        assert got is None
    else:
        assert got.endswith("".join(x + "\n" for x in code.split("\n")[begin:]))
        assert len(header.kept_comments(found)) <= len(found)
