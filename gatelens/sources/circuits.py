"""Circuit text files."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_texts(spark: SparkSession, folder: str, lines: bool = False) -> DataFrame:
    """(file, text): one row per circuit file, or (``lines``) per line, the splittable form for large collections.

    A folder that ``write_texts`` wrote names the circuits by its subfolders.
    """
    if lines:
        return spark.read.schema("file STRING, text STRING").json(folder)
    texts = spark.read.text(folder, wholetext=True)
    name = F.col("file").cast("string") if "file" in texts.columns else F.col("_metadata.file_name")
    return texts.select(name.alias("file"), F.col("value").alias("text"))


def match_manifest(texts: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts in the manifest, manifest files without a text)."""
    return texts.join(manifest.select("file").distinct(), "file", "left_semi"), manifest.select("file").distinct().join(texts, "file", "left_anti")


def read_circuit_texts(spark: SparkSession, folder: str, manifest: DataFrame, lines: bool = False) -> DataFrame:
    """A3: texts of the manifest's circuits; missing files are warned about and skipped."""
    texts, missing = match_manifest(read_texts(spark, folder, lines), manifest)
    lost = missing.count()
    if lost:
        warnings.warn(f"{lost} circuit files of the manifest not found, first: {missing.first().file}", stacklevel=2)
    return texts
