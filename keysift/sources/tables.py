"""Reading input tables and writing the three reports."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    """Any Spark-readable table.  Text formats should be given a schema (no inference pass)."""
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def arriving_files(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", **options) -> DataFrame:
    """Files landing in a folder, as a stream.  Streams need a schema up front."""
    return spark.readStream.format(fmt).schema(schema).options(**options).load(path)


def run_stamp(at: datetime | None = None) -> str:
    """The UTC stamp that names the outputs of one run."""
    return (at or datetime.now(timezone.utc)).strftime("%Y%m%dT%H%M%SZ")


def write_findings_json(records: DataFrame, metadata: DataFrame, out_dir: str, stamp: str) -> dict[str, str]:
    """Finding records as JSON lines, the run's metadata as one JSON row beside them."""
    paths = {"findings": f"{out_dir}/findings_{stamp}", "metadata": f"{out_dir}/findings_metadata_{stamp}"}
    records.write.mode("errorifexists").option("ignoreNullFields", "false").json(paths["findings"])
    metadata.write.mode("errorifexists").option("ignoreNullFields", "false").json(paths["metadata"])
    return paths


def write_disclosure_csv(targets: DataFrame, out_dir: str, stamp: str) -> str:
    path = f"{out_dir}/disclosure_targets_{stamp}"
    targets.write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)
    return path


def write_trends(sections: dict[str, DataFrame], out_dir: str, stamp: str) -> dict[str, str]:
    """One JSON table per trend section."""
    paths = {name: f"{out_dir}/trend_analysis_{stamp}/{name}" for name in sections}
    for name, frame in sections.items():
        frame.write.mode("errorifexists").option("ignoreNullFields", "false").json(paths[name])
    return paths
