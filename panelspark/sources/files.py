"""Reading contract CSV and curated parquet, and writing tables with a row-count check."""

import time
import uuid
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from panelspark.functions.ordering import shared_folder
from panelspark.sources.contracts import CONTRACTS

SCHEMA_VERSION = "v1"
#: Fixed columns every curated source file carries.
LINEAGE = ("source_file", "ingestion_timestamp", "pipeline_run_id", "schema_version")


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder on the storage all executors share."""
    return f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"


def read_source(spark: SparkSession, folder: str, source: str) -> DataFrame:
    """One contract source from CSV, columns found by name; a missing or extra one raises.

    The files of one source share one column order, which need not be the contract's.
    """
    path, schema = f"{folder}/{source}.csv", CONTRACTS[source].schema
    header = spark.read.option("header", True).csv(path).columns
    if sorted(header) != sorted(schema.names):
        raise ValueError(f"CSV header does not conform to the contract of {source}: {header}")
    ordered = StructType([schema[name] for name in header])
    rows = spark.read.schema(ordered).option("header", True).option("enforceSchema", False).csv(path)
    return rows.select(*schema.names)


def csv_sources(spark: SparkSession, folder: str):
    """Source provider over a folder of CSV files."""
    return lambda source: read_source(spark, folder, source)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def parquet_sources(spark: SparkSession, folder: str):
    """Source provider over curated parquet, without the lineage columns."""
    return lambda source: read_parquet(spark, f"{folder}/{source}.parquet").drop(*LINEAGE)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header. A blank text reads back as missing: CSV has no way to tell them apart."""
    keep = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode("errorifexists").options(header=True, **keep).csv(path)


def write_counted(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists") -> int:
    """Write and return the number of rows, counted on the same pass."""
    seen = Observation()
    rows = df.observe(seen, F.count(F.lit(1)).alias("n"))
    if kind == "csv":
        write_csv(rows, path)
    else:
        rows.write.mode(mode).option("compression", "zstd").parquet(path)
    return seen.get["n"]


def curate(spark: SparkSession, sources, folder: str, run_id: str) -> DataFrame:
    """CSV-shaped sources to ZSTD parquet with lineage; a row-count difference raises."""
    log = []
    for source in CONTRACTS:
        path = f"{folder}/{source}.parquet"
        curated = sources(source).withColumns(
            {
                "source_file": F.lit(f"{source}.csv"),
                "ingestion_timestamp": F.current_timestamp(),
                "pipeline_run_id": F.lit(run_id),
                "schema_version": F.lit(SCHEMA_VERSION),
            }
        )
        read = write_counted(curated, path)
        written = read_parquet(spark, path).count()
        if written != read:
            raise ValueError(f"{source}: {read} rows read, {written} written")
        log.append((source, f"{source}.csv", run_id, SCHEMA_VERSION, read, written))
    schema = (
        "source_name string, source_file string, pipeline_run_id string, schema_version string, "
        "rows_read bigint, rows_written bigint"
    )
    return spark.createDataFrame(log, schema)


def export_name(table: str) -> str:
    """mart_basket -> Mart_Basket, analysis_root_cause_lmdi -> Analysis_Root_Cause_LMDI."""
    parts = ["LMDI" if p == "lmdi" else p.capitalize() for p in table.split("_")]
    return "_".join(parts)


@dataclass(frozen=True)
class Export:
    folder: str
    report: DataFrame


class QualityGateError(RuntimeError):
    """The quality gate found failures, so nothing is exported."""


def export_tables(
    w, names, kind="parquet", run_id="manual", folder=None, keep_going=False, reuse=False,
    gate=True,
):
    """Write tables under their export names with the run id; one report row per table.

    Money stays DECIMAL in the files, so totals recomputed from them are exact. With ``reuse``
    a written parquet table also serves the tables built from it. Unless ``gate`` is False, a
    failed quality gate stops the export before anything is written.
    """
    if gate and not w["quality_gate"].first()["ready"]:
        raise QualityGateError("the quality gate failed; see quality_gate_findings")
    folder = folder or work_folder(w.spark, "export")
    report = []
    for name in names:
        start, rows, error = time.monotonic(), 0, ""
        out = f"{folder}/{export_name(name)}"
        try:
            stamped = w[name].withColumn("pipeline_run_id", F.lit(run_id))
            rows = write_counted(stamped, out, kind)
            if reuse:
                w.replace(name, read_parquet(w.spark, out).drop("pipeline_run_id"), rows)
        except PySparkException as problem:
            if not keep_going:
                raise
            error = str(problem)
        spent = time.monotonic() - start
        status = "failed" if error else "success"
        report.append((name, export_name(name), run_id, rows, status, error, spent))
    schema = (
        "table_name string, export_name string, pipeline_run_id string, rows_written bigint, "
        "status string, error string, duration_seconds double"
    )
    return Export(folder, w.spark.createDataFrame(report, schema))
