"""The given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def table_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int = 1) -> DataFrame:
    """The table as a stream of its files, be it one file or a folder of part files."""
    reader = spark.readStream.schema(table(spark, folder, name).schema).option("maxFilesPerTrigger", files_per_batch)
    # A pattern fits a file as well as a folder; a plain path would have to be a folder.
    return reader.parquet(f"{folder}/{name}.parque[t]")


def program_texts(spark: SparkSession, path: str) -> DataFrame:
    """(name, text) of the model files below a path."""
    reader = spark.read.option("wholetext", True).option("pathGlobFilter", "*.dsl").option("recursiveFileLookup", True)
    return reader.format("text").load(path).selectExpr(
        "regexp_extract(_metadata.file_name, '^(.*)[.]dsl$', 1) AS name", "value AS text"
    )
