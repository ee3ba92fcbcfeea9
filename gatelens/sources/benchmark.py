"""Benchmark, task and id-map JSON. Schemas are fixed; nothing is inferred and missing fields become NULL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CIRCUIT = "file STRING, family STRING, n_qubits INT, source STRUCT<name: STRING, url: STRING, notes: STRING>"
POINT = ("threshold: INT, shots: INT, sdk_get_fidelity: DOUBLE, p_return_zero: DOUBLE, run_wall_s: DOUBLE, "
         "peak_rss_mb: DOUBLE, returncode: INT, note: STRING")
RESULT = (
    "file STRING, backend STRING, precision STRING, status STRING, "
    "selection STRUCT<target: DOUBLE, selected_threshold: INT, selected_mirror_metric_value: DOUBLE, stop_when: STRING>, "
    f"threshold_sweep ARRAY<STRUCT<{POINT}>>, "
    "verify STRUCT<p_return_zero: DOUBLE>, "
    "state_setup STRUCT<shots: INT, run_wall_s: DOUBLE, peak_rss_mb: DOUBLE>, "
    "forward STRUCT<shots: INT, threshold: INT, run_wall_s: DOUBLE, unique_outcomes: INT, peak_rss_mb: DOUBLE, "
    "tail_mass: DOUBLE, topk_k: INT, topk: ARRAY<STRUCT<bitstring: STRING, count: BIGINT>>>, "
    "forward_timing_estimates STRUCT<estimated_per_shot_s: DOUBLE, estimated_setup_s: DOUBLE>")
TASK = "id STRING, processor STRING, precision STRING"
ID_ENTRY = "id STRING, qasm_file STRING"


def _array_of(fields: str) -> str:
    """DDL of ARRAY<STRUCT> from a field list: the outer ``name TYPE`` pairs become ``name: TYPE``."""
    out, level = [], 0
    for part in fields.replace(", ", ",\x00").split("\x00"):
        out.append(part.replace(" ", ": ", 1) if level == 0 else part)
        level += part.count("<") - part.count(">")
    return f"ARRAY<STRUCT<{' '.join(out)}>>"


def _read(spark: SparkSession, path: str, schema: str, lines: bool) -> DataFrame:
    """One document per file, or (``lines``) one per line, the splittable form for large collections."""
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def read_benchmark(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """A1: (circuits, results) from documents with two top-level arrays; one document per file or line."""
    doc = _read(spark, path, f"circuits {_array_of(CIRCUIT)}, results {_array_of(RESULT)}", lines)
    return doc.select(F.inline("circuits")), doc.select(F.inline("results"))


def read_result_lines(spark: SparkSession, path: str) -> DataFrame:
    """Results as JSON lines, the splittable form for large collections."""
    return spark.read.schema(RESULT).json(path)


def results_from_documents(df: DataFrame, column: str) -> DataFrame:
    """Results from a string column of result documents."""
    return df.select(F.from_json(column, RESULT).alias("r")).select("r.*")


def circuit_metadata(circuits: DataFrame) -> DataFrame:
    """A2."""
    return circuits.select("file", "family", "n_qubits", F.col("source.name").alias("source_name"))


def read_tasks(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A4: (task_id, processor, precision)."""
    return tasks(_read(spark, path, f"tasks {_array_of(TASK)}", lines).select(F.inline("tasks")))


def tasks(rows: DataFrame) -> DataFrame:
    return rows.withColumnRenamed("id", "task_id")


def read_id_map(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A5: (id, qasm_file). With ``lines``, an id's entries stand in one document."""
    doc = _read(spark, path, f"entries {_array_of(ID_ENTRY)}", lines)
    return id_map(doc.select(F.posexplode("entries").alias("pos", "e")).select("pos", "e.*"))


def id_map(entries: DataFrame) -> DataFrame:
    """Entries (pos, id, qasm_file) with both fields non-empty; the last duplicate wins."""
    full = entries.where((F.col("id") != "") & (F.col("qasm_file") != ""))
    return full.groupBy("id").agg(F.max_by("qasm_file", "pos").alias("qasm_file"))
