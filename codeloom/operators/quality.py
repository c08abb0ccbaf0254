"""Quality predicates of source files.

Line length, characters and size are built-in expressions; what needs a Python
lexer or parser runs once per document in one Arrow UDF, since two Python
predicates would not short-circuit each other anyway.
"""

from __future__ import annotations

import ast
import io
import tokenize
import warnings

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.functions.text import INVALID, VALID, is_blank, lines

MAX_LINE, MAX_MEAN, MIN_SIZE = 1000, 100, 500
VERDICTS = ("todo_ok", "syntax_ok", "functions_ok")


def line_statistics(text: Column) -> Column:
    """struct(n_lines, max_len, sum_len) over the lines that are not blank."""
    sizes = F.transform(F.filter(lines(text), lambda x: ~is_blank(x)), F.length)
    return F.transform(
        F.array(sizes),
        lambda s: F.struct(
            F.size(s).alias("n_lines"),
            F.coalesce(F.array_max(s), F.lit(0)).alias("max_len"),
            F.aggregate(s, F.lit(0), lambda t, x: t + x).alias("sum_len"),
        ),
    )[0]


def length_ok(stats: Column, longest: int = MAX_LINE, mean: int = MAX_MEAN) -> Column:
    """Some line, none longer than ``longest``, and at most ``mean`` on average."""
    return (stats["n_lines"] > 0) & (stats["max_len"] <= longest) & (stats["sum_len"] <= mean * stats["n_lines"])


def invalid_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, f"{VALID}+", ""))


def characters_ok(text: Column, ratio: float = 0.9) -> Column:
    """Valid characters are strictly more than ``ratio`` of all; false for an empty text."""
    n = F.length(text)
    return (n > 0) & F.coalesce((n - invalid_count(text)) / F.nullif(n, F.lit(0)) > ratio, F.lit(False))


def mark_invalid(text: Column) -> Column:
    """Each invalid character replaced by ``<UNK>``."""
    return F.regexp_replace(text, INVALID, "<UNK>")


def size_ok(text: Column, least: int = MIN_SIZE) -> Column:
    return F.length(text) >= least


def lexes_clean(code: str) -> bool:
    """No comment with TODO, and comments and strings at most half of the characters.

    A whole f-string counts as a string.  What cannot be lexed is not clean.
    """
    if not code:
        return True
    starts = [0]
    for line in io.StringIO(code):
        starts.append(starts[-1] + len(line))
    total, opened = 0, []
    try:
        for t in tokenize.generate_tokens(io.StringIO(code).readline):
            if t.type == tokenize.COMMENT:
                if "TODO" in t.string:
                    return False
                total += len(t.string)
            elif t.type == tokenize.FSTRING_START:
                opened.append(starts[t.start[0] - 1] + t.start[1])
            elif t.type == tokenize.FSTRING_END:
                begin = opened.pop()
                if not opened:
                    total += starts[t.end[0] - 1] + t.end[1] - begin
            elif t.type == tokenize.STRING and not opened:
                total += len(t.string)
    except Exception:
        return False
    return total <= 0.5 * len(code)


def parse(code: str) -> ast.AST | None:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return ast.parse(code)
    except Exception:
        return None


def no_empty_function(tree: ast.AST | None) -> bool:
    """No plain function whose body is a single ``pass``; false without a tree."""
    return tree is not None and not any(
        isinstance(n, ast.FunctionDef) and len(n.body) == 1 and isinstance(n.body[0], ast.Pass) for n in ast.walk(tree)
    )


def _lexical(text: pd.Series) -> pd.DataFrame:
    """The three verdicts that need a lexer or parser; a null text fails all."""
    rows = []
    for code in text:
        if code is None:
            rows.append((False, False, False))
            continue
        tree = parse(code)
        parsed = (tree is not None, no_empty_function(tree))
        del tree  # the lexer does not need it
        rows.append((lexes_clean(code), *parsed))
    return pd.DataFrame(rows, columns=list(VERDICTS))


#: As if not deterministic: a filter on its verdicts then stays above it, and neither it nor the text is computed twice.
lexical = F.pandas_udf(_lexical, T.StructType([T.StructField(k, T.BooleanType()) for k in VERDICTS])).asNondeterministic()


def annotate(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the built-in statistics and verdicts; a narrow, codegen-only plan."""
    s = line_statistics(F.col(text))
    out = docs.withColumn("_s", s)
    return (
        out.withColumn("n_lines", F.col("_s.n_lines"))
        .withColumn("max_len", F.col("_s.max_len"))
        .withColumn("sum_len", F.col("_s.sum_len"))
        .withColumn("n_invalid", invalid_count(F.col(text)))
        .withColumn("pass_length", length_ok(F.col("_s")))
        .withColumn("pass_chars", characters_ok(F.col(text), 0.99))
        .withColumn("pass_size", size_ok(F.col(text)))
        .drop("_s")
    )
