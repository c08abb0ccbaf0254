"""The three batch pipelines as compositions of operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.operators import fim, header, predict, quality, sampling, tokens


def _once(value: Column, rule: Callable[[Column], Column]) -> Column:
    """A rule that may name its value often, though a filter computes the value once."""
    return F.exists(F.array(value), rule)


def clean(docs: DataFrame, text: str = "text", convert_blanks: bool = False, ratio: float = 0.99, check_functions: bool = False) -> DataFrame:
    """Source files that pass all predicates, with stripped headers.

    Built-in predicates come first and are pushed below the UDFs; those that
    need a lexer or parser share one UDF call.
    """
    rows = docs.where(_once(F.col(text), lambda t: _once(quality.line_statistics(t), lambda s: quality.length_ok(s)) & quality.characters_ok(t, ratio)))
    rows = rows.withColumn("_q", quality.lexical(text)).where("_q.todo_ok and _q.syntax_ok")
    if check_functions:
        rows = rows.where("_q.functions_ok")
    strip = header.header_stripped_blanks if convert_blanks else header.header_stripped
    rows = rows.drop("_q").withColumn(text, strip(text))
    return rows.where(F.col(text).isNotNull() & quality.size_ok(F.col(text)))


def tokenize(docs: DataFrame, tokenizer: tokens.Tokenizer, mode: str = "ntp", sample_ratio: float | None = None, val_size: float = 0.1, seed: int = 42, with_text: bool = False, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Token samples with a ``split`` column; ``mode`` is tokenize, ntp or fim."""
    if mode not in ("tokenize", "ntp", "fim"):
        raise ValueError(f"no such mode: {mode}")
    rows = sampling.shuffle_take(docs.select(key, text), sample_ratio, key, seed)
    if mode == "tokenize":
        out = tokens.encode(rows, tokenizer, key, text, seed).withColumn("sample", F.lit(0))
    else:
        out = fim.samples(rows, tokenizer, key, text, with_text=with_text, fim=mode == "fim", seed=seed, **options)
    name = F.concat_ws("/", F.col(key).cast("string"), F.col("sample").cast("string"))
    return sampling.split(out.withColumn("_key", name), val_size, "_key", seed).drop("_key")


def predict_and_keep(rows: DataFrame, make: Callable[[], predict.Predictor], style: str, which: str, only_prefix: bool = False, with_sequence_id: bool = False) -> DataFrame:
    """Rows whose completion is right, wrong, or all with their completions."""
    return predict.keep(predict.predict(rows, make, style, only_prefix), which, with_sequence_id)
