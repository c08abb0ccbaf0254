"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.durable import cut, discard, release  # noqa: F401
from codeloom.shipping import ship

#: Texts that go to Python workers at once, where the session doesn't say.
BATCH_KEY, BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", "1000"


def small_batches(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches of this session unless it does so itself; the JVM and a worker hold one whole."""
    if spark.conf.get(BATCH_KEY, None) is None:
        spark.conf.set(BATCH_KEY, BATCH)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data directory; any path Spark can read."""
    return small_batches(ship(spark)).read.parquet(f"{sf_dir}/{name}.parquet")


def spare(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has."""
    taken, mark = {c.lower() for c in df.columns}, "__"
    while any(f"{mark}{n}" in taken for n in names):
        mark += "_"
    return [f"{mark}{n}" for n in names]


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the quarter of documents that no model learns from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def bounded(df: DataFrame, limit: int) -> bool:
    """Whether ``df`` has at most ``limit`` rows; reads no more than it must."""
    return df.limit(limit + 1).count() <= limit


def small_join(left: DataFrame, right: DataFrame, on, how: str, limit: int) -> DataFrame:
    """Join that broadcasts ``right`` only after its row count was checked.

    Beyond ``limit`` rows it is an ordinary shuffled join, which adaptive
    execution splits where a key is hot.
    """
    return left.join(F.broadcast(right) if bounded(right, limit) else right, on, how)
