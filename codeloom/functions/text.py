"""Text building blocks as Column expressions.

Lengths are code points.  ``SPACE`` is the set of characters that count as blank
for stripping; Spark's own trim functions know only U+0020.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# Characters that count as valid are white space, printable ASCII, Han, and these marks.
MARKS = "，。？！：；“”‘’（）【】《》—…"
_ALLOWED = r"\x09-\x0d\x20-\x7e\x{4e00}-\x{9fff}" + MARKS
VALID, INVALID = f"[{_ALLOWED}]", f"[^{_ALLOWED}]"

SPECIAL_TOKENS = ("<EOS>", "<BOS>", "<UNK>", "<PREFIX>", "<SUFFIX>", "<MIDDLE>", "<PAD>", "<MASK>")


def lines(text: Column) -> Column:
    """Pieces between line feeds, empty ones included."""
    return F.split(text, "\n", -1)


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, f"{SPACE}+$(?![\\s\\S])", "")


def strip(text: Column) -> Column:
    return F.regexp_replace(rstrip(text), f"^{SPACE}+", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(f"[^{SPACE[1:-1]}]")


def uniform(seed: int, tag: str, *key: Column) -> Column:
    """A number in [0, 1) that depends on seed, tag and key alone.

    The first 32 bits of an md5, so that SQL engines with md5 agree, and rows
    keep their draw under any partitioning.
    """
    name = F.concat_ws(":", F.lit(str(seed)), F.lit(tag), *[k.cast("string") for k in key])
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def choice(u: Column, n: Column) -> Column:
    """Uniform choice among 0..n-1."""
    return F.floor(u * n).cast("int")
