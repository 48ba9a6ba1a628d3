"""Review tables as CSV or Parquet, word vectors, seed lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlab.sources.quoted_csv import read_quoted_csv

REVIEW_COLUMNS = ["store", "taste", "quantity", "delivery", "menu", "customer_id", "review", "reply"]


def string_schema(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


REVIEW_SCHEMA = string_schema(REVIEW_COLUMNS)


def _read_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType, multiline: bool,
              file_columns: Mapping[str, Column] | None = None) -> DataFrame:
    if multiline:
        return read_quoted_csv(spark, path, schema, file_columns)
    reader = (spark.read.schema(schema).option("header", True).option("escape", '"').option("enforceSchema", True)
              .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))
    return reader.csv(path if isinstance(path, str) else list(path)).withColumns(dict(file_columns or {}))


def read_reviews(spark: SparkSession, path: str | Sequence[str], schema: T.StructType = REVIEW_SCHEMA,
                 multiline: bool = True) -> DataFrame:
    """CSV with a header line, in UTF-8 with or without a byte order mark.

    Empty cells, quoted or not, are missing values. A file is read by several tasks, quoted line
    breaks or not (see ``quoted_csv``). Where texts hold no line breaks, switch ``multiline``
    off: the file is then scanned once instead of twice.
    """
    return _read_csv(spark, path, schema, multiline)


def read_sharded(spark: SparkSession, folder: str, prefix: str, schema: T.StructType = REVIEW_SCHEMA,
                 multiline: bool = True) -> DataFrame:
    """All files, or folders of part files, whose name starts with ``prefix``.

    Columns are matched by position.
    """
    return _read_csv(spark, f"{folder}/{prefix}*", schema, multiline)


def read_numbered(spark: SparkSession, folder: str, n: int, schema: T.StructType = REVIEW_SCHEMA,
                  stem: str = "review_data", multiline: bool = True) -> DataFrame:
    """Files ``<stem>0.csv`` to ``<stem>n-1.csv``, with the file number in column ``shard``."""
    paths = [f"{folder}/{stem}{i}.csv" for i in range(n)]
    number = F.regexp_extract("_metadata.file_path", rf"{stem}(\d+)\.csv", 1).cast("int")
    return _read_csv(spark, paths, schema, multiline, {"shard": number})


def write_reviews(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header line; rows are found by their id column, no position is written."""
    (df.write.mode(mode).option("header", True).option("escape", '"').option("quoteAll", False)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def write_columnar(df: DataFrame, path: str, partition: str | None = "split", mode: str = "errorifexists") -> None:
    """Parquet, one folder per split."""
    writer = df.write.mode(mode)
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def read_columnar(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Parquet written by ``write_columnar``; a named split reads its folder only."""
    df = spark.read.parquet(path)
    return df if split is None else df.where(F.col("split") == split)


def read_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Text lines ``word v1 .. vd`` as (word, vec); a leading ``count size`` line is skipped."""
    parts = F.split("value", " ")
    lines = spark.read.text(path).where(F.length("value") > 0).select(parts.alias("p")).where(F.size("p") > 2)
    return lines.select(F.col("p")[0].alias("word"), F.slice("p", F.lit(2), F.size("p") - 1).cast("array<float>").alias("vec"))


def write_word_vectors(vectors: DataFrame, path: str) -> None:
    """(word, vec) as text lines ``word v1 .. vd``."""
    line = F.concat_ws(" ", F.col("word"), F.array_join(F.col("vec").cast("array<string>"), " "))
    vectors.select(line.alias("value")).write.text(path)


def seed_list(spark: SparkSession, values: Sequence[str], name: str = "seed") -> DataFrame:
    """Literal list as a table with its order."""
    return spark.createDataFrame(list(enumerate(values)), f"at long, {name} string")
