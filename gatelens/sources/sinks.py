"""Writers. All write from the executors; a single-document JSON is written as ordered parts that concatenate to it."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_features(frame: DataFrame, path: str, csv: bool = False) -> None:
    """Parquet, and CSV next to it on request."""
    frame.write.mode("overwrite").parquet(path)
    if csv:
        flat = [c for c, t in frame.dtypes if not t.startswith(("array", "struct", "map"))]
        frame.select(*flat).write.mode("overwrite").option("header", True).csv(path.rstrip("/") + "_csv")


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """A7."""
    return spark.read.parquet(path)


def prediction_objects(preds: DataFrame) -> DataFrame:
    """(id, json): one JSON object per prediction; a missing runtime is written as NaN."""
    wall = F.coalesce(F.col("predicted_forward_wall_s"), F.lit(float("nan")))
    body = F.to_json(F.struct(F.col("id").cast("string").alias("id"), F.col("predicted_threshold_min").cast("int").alias("predicted_threshold_min"),
                              wall.alias("predicted_forward_wall_s")))
    return preds.select("id", F.regexp_replace(body, '"NaN"', "NaN").alias("json"))


def write_predictions(preds: DataFrame, path: str, document: bool = False) -> None:
    """JSON lines sorted by id, or (``document``) parts that concatenate to {"predictions": [...]}.

    The document form puts the separator in front of every object but the first, so no task sees all rows.
    """
    objects = prediction_objects(preds)
    if not document:
        objects.orderBy("id").select("json").write.mode("overwrite").text(path)
        return
    first = objects.agg(F.min("id")).first()[0]
    lead = F.when(F.col("id") == first, '{"predictions": [').otherwise(",")
    rows = objects.select("id", F.lit(0).alias("end"), F.concat(lead, "json").alias("line"))
    last = preds.sparkSession.range(1).select(F.lit(None).cast(dict(preds.dtypes)["id"]).alias("id"), F.lit(1).alias("end"), F.lit("]}").alias("line"))
    rows.unionByName(last).orderBy("end", "id").select("line").write.mode("overwrite").text(path)


def read_predictions(spark: SparkSession, path: str, document: bool = False) -> DataFrame:
    """What ``write_predictions`` wrote: (id, predicted_threshold_min, predicted_forward_wall_s)."""
    schema = "id STRING, predicted_threshold_min INT, predicted_forward_wall_s DOUBLE"
    if not document:
        return spark.read.schema(schema).json(path)
    # every line of the document holds one object, with what joins them in front of or after it
    body = F.regexp_extract("value", r"(\{[^{}]*\})", 1)
    return spark.read.text(path).select(F.from_json(body, schema).alias("p")).where("p.id IS NOT NULL").select("p.*")


def write_texts(texts: DataFrame, path: str, lines: bool = False) -> None:
    """A3's input: (file, text) as one folder per circuit, or (``lines``) one document per line; each text ended by a line end."""
    if lines:
        ended = F.struct("file", F.concat("text", F.lit("\n")).alias("text"))
        texts.select(F.to_json(ended)).write.mode("overwrite").text(path)
        return
    texts.select("file", "text").write.mode("overwrite").partitionBy("file").text(path)


def write_splits(splits: DataFrame, path: str, n_samples: int, metadata: dict | None = None) -> None:
    """(row_key, fold, role) in parquet with a one-row metadata table."""
    splits.write.mode("overwrite").partitionBy("fold", "role").parquet(path + "/rows")
    spark = splits.sparkSession
    spark.createDataFrame([(int(n_samples), json.dumps(metadata or {}))], "n_samples long, metadata string").write.mode("overwrite").parquet(path + "/meta")


def read_splits(spark: SparkSession, path: str, n_rows: int | None = None) -> tuple[DataFrame, dict]:
    """Splits and metadata; raises when they were made for another number of rows."""
    meta = spark.read.parquet(path + "/meta").first()
    if n_rows is not None and meta.n_samples != n_rows:
        raise ValueError(f"splits were made for {meta.n_samples} rows, the data has {n_rows}")
    return spark.read.parquet(path + "/rows"), {**json.loads(meta.metadata), "n_samples": meta.n_samples}


def write_score_report(scores: DataFrame, path: str) -> None:
    """Per-task scores as JSON lines and the overall score next to them."""
    scores.write.mode("overwrite").json(path + "/tasks")
    scores.agg(F.avg("task_score").alias("overall_score"), F.count(F.lit(1)).alias("n_tasks")).write.mode("overwrite").json(path + "/overall")
