"""A corpus of Python files made from ``documents``, as SQL that Spark and other engines share.

``documents`` is prose, which no parser takes.  A file has features planted by
the modulus of doc_id, so what each operator must find is again plain SQL, and
the document's whole text: each of its lines is an identifier, with ``_`` for
what is no letter.  So files are as long, have as many lines and as frequent
ones as the documents themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NL = "chr(10)"
#: ``documents`` with the column words, for an engine whose regexp_replace asks for a flag to replace all.
SOURCE = "(select *, replace(regexp_replace(coalesce(text, ''), '[^A-Za-z\\n]+', '_', 'g'), chr(10), concat(chr(10), 'v_')) as words from documents)"
FEATURES = {
    "shebang": 2, "license_block": 3, "docstring": 5, "license_docstring": 7, "todo": 11, "syntax": 13, "long_line": 17,
    "empty_function": 19, "han": 23, "invalid": 29, "short": 31, "fstring": 37, "header_only": 41,
}


def has(feature: str) -> str:
    return f"(doc_id % {FEATURES[feature]} = 0)"


def _text(*parts: str) -> str:
    """SQL of a text; a leading ``@`` marks a piece that is SQL, a bare ``/`` a line feed."""
    return "concat('', " + ", ".join(NL if p == "/" else p[1:] if p.startswith("@") else f"'{p}'" for p in parts) + ")"


def _when(feature: str, text: str) -> str:
    return f"case when {has(feature)} then {text} else '' end"


SHEBANG = _text("#!/usr/bin/env python", "/")
LICENSE = _text("# Copyright (C) 2020 Acme", "/", "# All rights reserved.", "/", "/")
DOCSTRING = _text('"""Module number ', "@doc_id", '."""', "/")
LICENSE_DOCSTRING = _text('"""Licensed under the Apache License, Version 2.0."""', "/")
_BODY = [
    _text("import os", "/", "/", "/"),
    _text("def compute_", "@doc_id", "(first, second):", "/", "    total = first * ", "@doc_id", " + second", "/"),
    _text("    for index in range(10):", "/", "        total = total + index * first", "/", "    return total", "/", "/", "/"),
    _text("def describe_", "@doc_id", "(values):", "/", "    result = max(", "/", "        len(values),", "/", "        ", "@doc_id", ",", "/", "    )", "/"),
    _text("    for value in values:", "/", "        result = result + value", "/", "    return result", "/", "/", "/"),
    f"repeat({_text('offset_', '@doc_id', ' = os.getpid() + 1', '/')}, 8)",
    _when("todo", _text("# TODO fix this later", "/")),
    _when("syntax", _text("x = = 1", "/")),
    _when("long_line", _text("value = ", "@repeat('1 + ', 300)", "1", "/")),
    _when("empty_function", _text("def empty():", "/", "    pass", "/")),
    _when("han", _text("# 中文注释", "/")),
    _when("invalid", _text('name = "', "@repeat('é', 40)", '"', "/")),
    _when("fstring", _text('label = f"{os.name} items"', "/")),
    _text("print(compute_", "@doc_id", "(1, 2))", "/"),
    f"concat('v_', words, {NL})",
]
BODY = f"concat({', '.join(_BODY)})"
SHORT = _text("a = 1", "/")
HEADER_ONLY = _text("# only a comment", "/", "# and another one", "/")
FULL = f"(not {has('short')} and not {has('header_only')})"
CONTENT = (
    f"case when {has('header_only')} then {HEADER_ONLY} when {has('short')} then {SHORT} else concat("
    + ", ".join([_when("shebang", SHEBANG), _when("license_block", LICENSE), _when("docstring", DOCSTRING), _when("license_docstring", LICENSE_DOCSTRING), BODY])
    + ") end"
)
#: What is left of a file when its header is stripped; null for a file without code.
STRIPPED = (
    f"case when {has('header_only')} then null when {has('short')} then concat({SHORT}, {NL}) else concat("
    + ", ".join([_when("license_block", NL), _when("docstring", DOCSTRING), BODY, NL])
    + ") end"
)
_COLUMNS = ["doc_id", "concat('', doc_id) as blob_id", f"{CONTENT} as content"]
SQL = f"select {', '.join(_COLUMNS)} from {SOURCE}"

#: Thirds of a document as prefix, middle and suffix, and a completion that is right, cut, wrong or empty by doc_id.
_THIRD = "cast(floor(length(text) / 3) as int)"
_MIDDLE = f"substr(text, {_THIRD} + 1, {_THIRD})"
_ANSWER = f"case doc_id % 4 when 0 then concat({_MIDDLE}, '  ', {NL}) when 1 then substr(text, {_THIRD} + 1, cast(floor(length(text) / 6) as int)) when 2 then concat('x', {_MIDDLE}) else '' end"
_FIM_COLUMNS = [
    "doc_id", f"substr(text, 1, {_THIRD}) as prefix", f"case when doc_id % 9 = 0 then '' else {_MIDDLE} end as middle",
    f"substr(text, 2 * {_THIRD} + 1) as suffix", f"{_ANSWER} as answer",
]
FIM_SQL = f"select {', '.join(_FIM_COLUMNS)} from documents"

#: Bodies of the two functions of a file, between what stands before and after them; null where there is none.
BODIES = [
    (_text("def compute_", "@doc_id", "(first, second):", "/"), _text("    total = first * ", "@doc_id", " + second", "/", "    for index in range(10):", "/", "        total = total + index * first", "/", "    return total", "/")),
    (_text("def describe_", "@doc_id", "(values):", "/"), _text("    result = max(", "/", "        len(values),", "/", "        ", "@doc_id", ",", "/", "    )", "/", "    for value in values:", "/", "        result = result + value", "/", "    return result", "/")),
]


def code_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, blob_id, content for every document."""
    words = r"replace(regexp_replace(coalesce(text, ''), '[^A-Za-z\n]+', '_'), '\n', '\nv_')"
    return spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("words", F.expr(words)).selectExpr(*_COLUMNS)


def fim_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, prefix, middle, suffix, answer for every document."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr(*_FIM_COLUMNS)
