"""Sources and sinks: JSON records, chunk files, markdown folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "demand array<struct<date: date, qty: double>>, pgi array<struct<date: date, qty: double>>, jitcall array<struct<date: date, qty: double>>, ins array<struct<date: date, qty: double>>, beginningInventory double, weekly_demand double, monthly_forecast string, forecast_period int"


def records(spark: SparkSession, path: str, identity: str = "partNo string") -> DataFrame:
    """Forecast records of a JSON file; ``identity`` lists the columns to carry along.

    monthly_forecast is a number or an object by month; it becomes two columns.
    """
    raw = spark.read.schema(f"{identity}, {RECORD}").option("multiLine", True).json(path)
    by_month = F.from_json("monthly_forecast", "map<string, double>")
    return raw.withColumns({"monthly_forecast_total": F.col("monthly_forecast").try_cast("double"), "monthly_forecast_by_month": F.when(F.col("monthly_forecast").startswith("{"), by_month)}).drop("monthly_forecast")


def points(records: DataFrame, column: str, *keys: str) -> DataFrame:
    """An array of points as rows: keys, ds, qty; a missing qty is 0."""
    return records.select(*keys, F.explode(column).alias("p")).select(*keys, F.col("p.date").alias("ds"), F.coalesce("p.qty", F.lit(0.0)).alias("qty"))


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of *.chunks.jsonl files; a missing module or source comes from the file's name."""
    raw = spark.read.schema("chunk_id string, title string, body string, module string, kind string, section string, source string").json(f"{path}/*.chunks.jsonl")
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.chunks\.jsonl$", 1)
    return raw.withColumns({"module": F.coalesce("module", stem), "source": F.coalesce("source", stem)})


def markdown(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of all markdown files below a folder."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def write_chunks(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("overwrite").partitionBy("module").json(path)


def write_snapshot(rows: DataFrame, path: str, version: int) -> None:
    """JSON lines of a new version beside the earlier ones; readers see it when its write is complete."""
    rows.write.mode("errorifexists").json(f"{path}/version={version}")


def complete_versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions below ``path`` whose write was completed, found by listing folders; no data is read."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    marks = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(place, "version=*/_SUCCESS")) or []
    return sorted(int(m.getPath().getParent().getName().partition("=")[2]) for m in marks)


def snapshot(spark: SparkSession, path: str, schema: str, version: int | None = None) -> DataFrame:
    """The rows of the highest complete version below ``path``, or of a given one; other versions are not read."""
    versions = complete_versions(spark, path)
    chosen = max(versions, default=None) if version is None else version
    if chosen not in versions:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(f"{path}/version={chosen}")
