"""File headers: leading comments, their classes, and what of them is kept; blank runs."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.functions.text import SPACE, is_blank, lines

# Phrases of licences, and patterns of comments at the head of a file.
LICENSE = (
    r"(Copyright \(C\)|All rights reserved|THE SOFTWARE IS PROVIDED|Apache License|MIT LICENSE|MIT LICENCE"
    r"|BSD.*License|License.*BSD|SPDX-License-Identifier|GNU General Public License)"
)
#: Kind and pattern, matched at the start of a comment, first match wins.
KINDS = (
    ("shebang", r"#\s*!.*python"),
    ("coding", r".*(coding=|-\*-\s*coding:)"),
    ("copyright", rf"(?is).*{LICENSE}"),
    ("pylint", r"#\s*pylint"),
)
_KINDS = [(k, re.compile(p)) for k, p in KINDS]
BLANK = "<4BLANK>"


def comment_kind(comment: Column) -> Column:
    """Kind of a leading comment, or an empty string."""
    out = None
    for kind, pattern in KINDS:
        flags, body = ("(?is)", pattern[5:]) if pattern.startswith("(?is)") else ("", pattern)
        hit = comment.rlike(f"{flags}^{body}")
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("")


def kind_of(comment: str) -> str:
    return next((k for k, p in _KINDS if p.match(comment)), "")


_QUOTES = {"single": "'''", "double": '"""'}
_OTHER = {"single": "double", "double": "single"}


def leading_comments(rows: list[str]) -> tuple[list[str], int | None]:
    """Comments before the first line of code, and that line's number (None without code)."""
    found: list[str] = []
    inside = ""
    for at, line in enumerate(x.strip() for x in rows):
        if inside:
            own, other = _QUOTES[inside], _QUOTES[_OTHER[inside]]
            # a docstring that ends where another begins splits the line; in a
            # single-quoted one its own quotes are tried first, else the other's
            turns = [(own, inside), (other, _OTHER[inside])]
            for quotes, state in turns if inside == "single" else turns[::-1]:
                k = line.find(own + quotes)
                if k >= 0:
                    found[-1] += "\n" + line[: k + 3]
                    found.append(line[k + 3 :])
                    inside = state
                    break
            else:
                if own in line:
                    inside = ""
                found[-1] += "\n" + line
        elif line.startswith("#") or not line:
            found.append(line)
        elif line.startswith(tuple(_QUOTES.values())):
            found.append(line)
            quotes = line[:3]
            if quotes not in line[3:]:
                inside = "single" if quotes == "'''" else "double"
        else:
            return found, at
    return found, None


def kept_comments(found: list[str]) -> list[str]:
    """Leading comments without shebang, coding, lint and licence parts."""
    keep: list[bool] = []
    run: list[int] = []  # comments of the present run whose fate is open
    licensed = False
    for n, comment in enumerate(found):
        hashed = comment.startswith("#")
        keep.append(True)
        if licensed and hashed:
            keep[n] = False
            continue
        licensed = False
        kind = kind_of(comment)
        if kind in ("shebang", "coding", "pylint"):
            keep[n] = False
        elif kind == "copyright":
            keep[n] = False
            if hashed:
                for k in run:
                    keep[k] = False
                run, licensed = [], True
        elif hashed:
            run.append(n)
        else:
            run = []
    return [c for c, k in zip(found, keep, strict=True) if k]


def strip_header(code: str, blanks: bool = False) -> str | None:
    """The file without header boilerplate; None if it holds no code.

    Every line ends with a line feed, the last one's remainder included.
    """
    rows = code.split("\n")
    found, begin = leading_comments(rows)
    if begin is None:
        return None
    body = rows[begin:]
    if blanks:
        body = [mark_line(x) for x in body]
    return "".join(f"{x}\n" for x in [*(c.strip() for c in kept_comments(found)), *body])


def _stripped(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else strip_header(x))


def _stripped_blanks(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else strip_header(x, blanks=True))


#: As if not deterministic: a filter on what is left then stays above them, and neither they nor the text are computed twice.
header_stripped = F.pandas_udf(_stripped, T.StringType()).asNondeterministic()
header_stripped_blanks = F.pandas_udf(_stripped_blanks, T.StringType()).asNondeterministic()


def mark_line(line: str) -> str:
    bare = line.lstrip()
    if not bare:
        return ""
    return line if bare.startswith("#") else line.replace("    ", BLANK)


def mark_blanks(text: Column) -> Column:
    """Runs of four spaces as tokens, line by line; comments stay, blank lines empty."""

    def one(line: Column) -> Column:
        bare = F.regexp_replace(line, f"^{SPACE}+", "")
        return F.when(is_blank(line), "").when(bare.startswith("#"), line).otherwise(F.replace(line, F.lit("    "), F.lit(BLANK)))

    return F.array_join(F.transform(lines(text), one), "\n")


def unmark_blanks(text: Column) -> Column:
    for n in (4, 8, 16):
        text = F.replace(text, F.lit(f"<{n}BLANK>"), F.lit(" " * n))
    return text
