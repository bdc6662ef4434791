"""Readers and writers of labelled text collections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doctopics.constants import LABEL_NAMES
from doctopics.functions.dateline import dateline_columns
from doctopics.functions.text import full_text_transform
from doctopics.sources.quoted import read_quoted_csv
from doctopics.sources.selection import label_lookup

CSV_OPTIONS = {
    "header": True,
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}

NEWS_SCHEMA = T.StructType(
    [
        T.StructField("Class Index", T.IntegerType()),
        T.StructField("Title", T.StringType()),
        T.StructField("Description", T.StringType()),
    ]
)


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | str,
    encoding: str = "ISO-8859-1",
    multi_line: bool = True,
) -> DataFrame:
    """CSV with an explicit schema (no inference pass), a large file in many tasks.

    ``multi_line`` allows line breaks inside quotes (``quoted``); without them Spark's own reader splits within files.
    """
    if multi_line:
        return read_quoted_csv(spark, path, schema, encoding)
    return spark.read.schema(schema).options(**CSV_OPTIONS).option("encoding", encoding).csv(path)


def write_csv(df: DataFrame, path: str, encoding: str = "UTF-8") -> None:
    """CSV without an index column. CSV cannot tell an empty text from null; use Parquet where that matters."""
    df.write.options(**CSV_OPTIONS).option("encoding", encoding).option("quoteAll", True).csv(path)


def read_labelled_csv(spark: SparkSession, path: str, schema: T.StructType = NEWS_SCHEMA, **kw) -> DataFrame:
    """News split: ``Class Index`` becomes ``labels``."""
    return read_csv(spark, path, schema, **kw).withColumnRenamed("Class Index", "labels")


def read_labelled_union(spark: SparkSession, train_path: str, test_path: str, **kw) -> DataFrame:
    """Train and test as one table with a ``split`` column."""
    train = read_labelled_csv(spark, train_path, **kw).withColumn("split", F.lit("train"))
    test = read_labelled_csv(spark, test_path, **kw).withColumn("split", F.lit("test"))
    return train.unionByName(test)


def read_second_corpus(spark: SparkSession, path: str, schema: T.StructType | str, **kw) -> DataFrame:
    """A collection that already has its ``labels`` column."""
    return read_csv(spark, path, schema, **kw)


def jsonl_to_csv(
    spark: SparkSession, json_path: str, csv_path: str, schema: T.StructType | str, encoding: str = "UTF-8"
) -> None:
    """One JSON object per line to CSV."""
    write_csv(spark.read.schema(schema).json(json_path), csv_path, encoding)


def read_category_corpus(
    spark: SparkSession, path: str, schema: T.StructType | str, encoding: str = "UTF-8", **kw
) -> DataFrame:
    """The converted collection; ``category`` becomes ``labels``."""
    return read_csv(spark, path, schema, encoding, **kw).withColumnRenamed("category", "labels")


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def cleaned_cache(
    spark: SparkSession, base_path: str, build: Callable[[], DataFrame], split_col: str = "split"
) -> DataFrame:
    """Read ``<base>_cleaned`` if complete, else build and write it, partitioned by split.

    Completeness is the commit marker, so a run that lost its executors half-way is not mistaken for a cache.
    """
    path = f"{base_path}_cleaned"
    if not path_exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").partitionBy(split_col).parquet(path)
    return spark.read.parquet(path)


def clean_articles(df: DataFrame, names: dict[int, str] = LABEL_NAMES) -> DataFrame:
    """The full cleaning run: class names, text transform, source, title, location, country.

    ``df``: labels, title, description and more columns. A label without a name becomes null.
    """
    named = df.withColumn("labels", label_lookup(F.col("labels"), names))
    return dateline_columns(full_text_transform(named, ["description"]))


def with_doc_id(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Number rows in file order; write the result before using it twice."""
    return df.withColumn(id_col, F.monotonically_increasing_id())
