"""Sampling, shuffling, splitting, numbering and sharding, all by keyed hashes.

A row's fate depends on the seed and its key alone, so results are the same
under any partitioning and can be computed again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.functions.durable import cut
from codeloom.functions.text import uniform


#: Ranges of a draw that are counted to find a cut; only rows of one range are ranked.
RANGES = 1 << 12


def _smallest(df: DataFrame, take: Column, group: list[str], u: Column, key: str) -> DataFrame:
    """The rows with the smallest draws of every group, ``take`` of them; ``take`` may use the group's size ``_n``.

    Counts by range of the draw tell where each group's cut lies.  Whole ranges
    below it are taken, and only the rows of the cut's own range are ranked, so
    no task sees a group.  Null groups are groups.
    """
    drawn = df.withColumn("_u", u).withColumn("_k", F.floor(F.col("_u") * RANGES).cast("int"))
    counts = drawn.groupBy(*group, "_k").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*group).orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0))).withColumn("_n", F.sum("_c").over(Window.partitionBy(*group)))
    cuts = counts.withColumn("_take", take).where("_before < _take").groupBy(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)])
    cuts = cuts.agg(F.max("_k").alias("_cut"), F.max_by(F.col("_take") - F.col("_before"), "_k").alias("_rest"))
    if group:
        placed = drawn.join(cuts, [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)])
    else:  # one row
        placed = drawn.join(F.broadcast(cuts), F.col("_k") <= F.col("_cut"))
    rank = F.row_number().over(Window.partitionBy(*[f"_g{i}" for i in range(len(group))], "_k").orderBy("_u", key))
    edge = placed.where("_k = _cut").withColumn("_r", rank).where("_r <= _rest")
    return placed.where("_k < _cut").select(*df.columns).union(edge.select(*df.columns))


def sample_exact(df: DataFrame, fraction: float, group: str, key: str, seed: int = 42) -> DataFrame:
    """round(fraction * n) rows of every group (halves to even), without replacement; a null group is one."""
    take = F.bround(F.col("_n") * F.lit(fraction)).cast("long")
    return _smallest(df, take, [group], uniform(seed, "sample", F.col(key)), key)


def shuffle_take(df: DataFrame, ratio: float | None, key: str, seed: int = 42) -> DataFrame:
    """The first int(ratio * n) rows of a keyed shuffle; all rows for no ratio or 0."""
    if not ratio:
        return df
    return _smallest(df, F.floor(F.col("_n") * F.lit(ratio)).cast("long"), [], uniform(seed, "shuffle", F.col(key)), key)


def split(df: DataFrame, validation: float = 0.1, key: str = "doc_id", seed: int = 42) -> DataFrame:
    """A ``split`` column: validation where the key's hash falls below the share."""
    return df.withColumn("split", F.when(uniform(seed, "split", F.col(key)) < validation, "validation").otherwise("train"))


def number(df: DataFrame, *order: str, name: str = "sequence_id") -> DataFrame:
    """Row numbers from 0 in the order of ``order``; rows that tie are in any order.

    A range exchange sorts the rows, and the sorted table is written, so that the
    sizes of its parts and the rows in them are of one and the same result.  Only
    the sizes, one for each part, meet on the driver.  Rows that tie are spread
    over parts by a hash of the whole row.
    """
    tie, at, part, before = (f"_number_{x}" for x in ("tie", "at", "part", "before"))
    rows = df.withColumn(tie, F.xxhash64(F.lit(0), *[F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]))
    rows = cut(rows.orderBy(*order, tie).drop(tie).withColumn(at, F.monotonically_increasing_id()), "numbered")
    own = F.shiftright(at, 33)
    sizes = sorted((r["p"], r["n"]) for r in rows.groupBy(own.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    starts, total = [], 0
    for p, n in sizes:
        starts.append((p, total))
        total += n
    starts = F.broadcast(df.sparkSession.createDataFrame(starts, f"{part} long, {before} long"))
    numbered = rows.withColumn(part, own).join(starts, part)
    return numbered.withColumn(name, F.col(before) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))).select(*df.columns, name)


def shard(df: DataFrame, shards: int, sequence: str = "sequence_id") -> DataFrame:
    """Round robin: row r goes to shard r mod n."""
    return df.withColumn("shard", F.pmod(sequence, F.lit(shards)).cast("int"))


def concatenate(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def weighted_choice(df: DataFrame, group: str, value: str, weight: str, draw: Column) -> DataFrame:
    """One value of each group, chosen in proportion to its weight (largest u ** (1 / w))."""
    return df.groupBy(group).agg(F.max_by(value, F.pow(draw, 1 / F.col(weight))).alias(value))
