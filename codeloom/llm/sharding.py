"""Sharding by a keyed permutation of global row numbers.

Rows get global numbers 0..n-1 in the order of (doc_id, text_crc32, size); a
Feistel network over the smallest even-bit domain that holds n, walked until
the value falls below n, permutes them.  Row number r goes to shard
``p(r) % shards`` at slot ``p(r) // shards``, so shard sizes differ by one row
at most, slots have no gap, and both can be computed from r alone.

Cases: a null text has no bytes (size 16, crc 0); rows with equal
(doc_id, crc, size) are interchangeable, so their order does not matter; a null
doc_id sorts first; an empty table gives an empty result; other columns of the
input are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .kernel import mix

ROUNDS = 6
ROW_BYTES = 16


def permute(x: np.ndarray, n: int, key: int = 0, rounds: int = ROUNDS) -> np.ndarray:
    """The keyed permutation of range(n) at ``x``, by cycle walking."""
    x = np.asarray(x, dtype=np.uint64)
    if n <= 1:
        return x.astype(np.int64)
    half = np.uint64(max(1, ((n - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = mix(np.arange(1, rounds + 1, dtype=np.uint64) + np.uint64((key * 0x9E3779B97F4A7C15) % 2**64))

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> half, v & mask
        for k in keys:
            left, right = right, left ^ (mix(right ^ k) & mask)
        return (left << half) | right

    out = once(x)
    while len(far := np.flatnonzero(out >= np.uint64(n))):
        out[far] = once(out[far])
    return out.astype(np.int64)


def numbered(df: DataFrame, by: list[str], name: str = "row_number") -> DataFrame:
    """``df`` with global row numbers from 0 in the order of ``by``.

    A range exchange sorts the rows; each partition's rows are counted where
    they lie and only those counts, one for each partition, come to the driver.
    """
    ranked = cut(df.orderBy(*by).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    sizes = {r["p"]: r["n"] for r in ranked.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, rows = 0, []
    for p in sorted(sizes):
        rows.append((int(p), before))
        before += sizes[p]
    starts = df.sparkSession.createDataFrame(rows, "_part long, _before long")
    return (
        ranked.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_at", "_part", "_before")
    )


def shard(docs: DataFrame, shards: int = 40, key: int = 1) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, row_number of each row."""
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    rows = numbered(rows, ["doc_id", "text_crc32", "size"])
    n = rows.count()

    @F.pandas_udf("long")
    def place(r: pd.Series) -> pd.Series:
        return pd.Series(permute(r.to_numpy(), n, key))

    rows = rows.withColumn("_at", place("row_number"))
    return rows.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("_at") % shards).cast("int").alias("shard"),
        F.expr(f"_at div {shards}").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row_number",
    )


def op6_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
