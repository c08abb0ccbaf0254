"""Sources and sinks.  Formats are normalised to Parquet; schemas are explicit."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.sources import arrow

RAW = "content STRING, blob_id STRING"


def read_raw(spark: SparkSession, path: str, keep_corrupt: bool = False) -> DataFrame:
    """JSON Lines with ``content`` and ``blob_id``; other keys are ignored.

    A broken line does not lose its file: with ``keep_corrupt`` it is a row
    with ``_corrupt_record``, otherwise it is left out.
    """
    return parse_raw(spark.read.text(path), keep_corrupt)


def parse_raw(lines: DataFrame, keep_corrupt: bool = False) -> DataFrame:
    """``read_raw`` for lines that are there already, as a batch or a stream."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    df = lines.where("trim(value) <> ''").select(F.from_json("value", f"{RAW}, _corrupt_record STRING", options).alias("r")).select("r.*")
    return df if keep_corrupt else df.where("_corrupt_record is null").drop("_corrupt_record")


def to_documents(raw: DataFrame) -> DataFrame:
    """content becomes text."""
    return raw.select(F.col("content").alias("text"), "blob_id")


def write_parquet(df: DataFrame, path: str, files: int | None = None, per_file: int | None = None) -> None:
    """Parquet, in ``files`` files or at most ``per_file`` rows each where asked for."""
    out = (df.repartition(files) if files else df).write.mode("overwrite")
    if per_file:
        out = out.option("maxRecordsPerFile", per_file)
    out.parquet(path)


def output_files(inputs: int, ratio: int = 1) -> int:
    """Files for ``inputs`` files merged ``ratio`` at a time."""
    if ratio < 1:
        raise ValueError("the ratio is 1 or more")
    return -(-inputs // ratio)


def with_file(df: DataFrame, name: str = "file") -> DataFrame:
    """The file each row comes from, for what is done file by file."""
    return df.withColumn(name, F.col("_metadata.file_name"))


def text_name(parquet_name: str) -> str:
    return parquet_name.replace(".parquet", ".txt")


def write_text(df: DataFrame, path: str, text: str = "text") -> None:
    """Each text and a line feed; line feeds inside a text start new lines."""
    df.select(text).write.mode("overwrite").option("lineSep", "\n").text(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """The lines that ``write_text`` wrote."""
    return spark.read.option("lineSep", "\n").text(path)


def read_table(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """A Parquet or Arrow file by its suffix, or a folder.

    A folder holds Arrow files (a saved dataset, with a folder for each split if
    it has several) or else Parquet, with ``split`` as in ``write_split``.
    """
    suffix = PurePosixPath(path).suffix
    if suffix in (".arrow", ".feather"):
        return arrow.read(spark, path)
    if suffix not in ("", ".parquet"):
        raise ValueError(f"unsupported file type: {suffix}")
    if suffix == "" and arrow.files(spark, path):
        return arrow.read(spark, f"{path}/{split}" if split else path)
    return read_split(spark, path, split) if split else spark.read.parquet(path)


def write_split(df: DataFrame, path: str) -> None:
    """Rows by their ``split`` column; reading one split prunes the other."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("split") == split).drop("split")
