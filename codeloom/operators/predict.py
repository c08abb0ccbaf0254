"""Prompts, prediction with a pluggable model, and keeping rows by agreement."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.resource import ResourceProfile
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.batches import bounded_batches
from codeloom.functions.text import lines, rstrip

#: Made once in every task; gets prompts, returns for each its completions.
Predictor = Callable[[Sequence[str]], Sequence[Sequence[str]]]


def native_prompt(prefix: Column, suffix: Column, only_prefix: bool = False) -> Column:
    """Suffix first, in the sentinels of the own tokenizer."""
    return F.concat(F.lit("<SUFFIX>"), F.lit("") if only_prefix else suffix, F.lit("<PREFIX>"), prefix, F.lit("<MIDDLE>"))


def external_prompt(prefix: Column, suffix: Column, only_prefix: bool = False) -> Column:
    """Prefix first, in the sentinels of the external model family."""
    begin, hole, end = (f"<｜fim▁{x}｜>" for x in ("begin", "hole", "end"))
    return F.concat(F.lit(begin), prefix, F.lit(hole), F.lit("") if only_prefix else suffix, F.lit(end))


def with_middle(rows: DataFrame) -> DataFrame:
    """Rows with something to predict."""
    return rows.where(F.col("middle") != "")


def predict(rows: DataFrame, make: Callable[[], Predictor], style: str = "native", only_prefix: bool = False, batch: int = 64, shards: int | None = None, profile: ResourceProfile | None = None) -> DataFrame:
    """``rows`` with a middle, and ``prediction``, an array of completions.

    ``make`` builds the model once in every task; rows reach it in batches.
    ``shards`` fixes the number of tasks, and so of models; ``profile`` says what
    each task needs, such as one accelerator of an executor.
    """
    if style not in ("native", "external"):
        raise ValueError(f"no such prompt style: {style}")
    prompt = (native_prompt if style == "native" else external_prompt)(F.col("prefix"), F.col("suffix"), only_prefix)
    asked = with_middle(rows).drop("input_ids", "attention_mask").withColumn("_prompt", prompt)
    asked = asked.repartition(shards) if shards else asked
    kept = [c for c in asked.columns if c != "_prompt"]
    kinds = dict(asked.dtypes)
    bounded_batches(rows.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in batches:
            for k in range(0, len(b), batch):
                part = b.iloc[k : k + batch]
                answers = [list(x) for x in model(part["_prompt"].tolist())]
                yield part[kept].assign(prediction=answers)

    return asked.mapInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", prediction array<string>", profile=profile)


def agrees(prediction: Column, middle: Column) -> Column:
    """Equal line by line over the shorter of both, trailing blanks aside."""

    def rows(text: Column) -> Column:
        return lines(rstrip(text))

    both = F.array(F.struct(rows(prediction).alias("a"), rows(middle).alias("b")))
    return F.transform(both, lambda s: F.slice(s["a"], F.lit(1), F.least(F.size(s["a"]), F.size(s["b"]))) == F.slice(s["b"], F.lit(1), F.least(F.size(s["a"]), F.size(s["b"]))))[0]


def keep(rows: DataFrame, which: str, with_sequence_id: bool = False) -> DataFrame:
    """prefix, middle, suffix of rows whose first completion is ``correct`` or ``incorrect``, or ``all``."""
    if which == "all":
        return rows
    if which not in ("correct", "incorrect"):
        raise ValueError(f"no such choice: {which}")
    ok = F.coalesce(agrees(F.get("prediction", F.lit(0)), F.col("middle")), F.lit(False))
    columns = ["prefix", "middle", "suffix", *(["sequence_id"] if with_sequence_id else [])]
    return rows.where(ok if which == "correct" else ~ok).select(*columns)
