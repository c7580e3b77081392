"""File sinks and sources: one folder of files in the formats that reports and imports use, and reading them back typed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FORMATS = ("csv", "json", "parquet", "orc")
_TIME = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
#: Text files hold empty strings (quoted) and nulls apart, double quotes inside quotes, and times to the microsecond, in both directions.
_OPTIONS = {"csv": _TIME | {"header": "true", "quote": '"', "escape": '"', "nullValue": "\\N"}, "json": _TIME}
_WRITE, _READ = {"json": {"ignoreNullFields": "false"}}, {"csv": {"multiLine": "true"}}


def write(df: DataFrame, path: str, kind: str, partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Writes df below path. Csv takes no lists and structs: Spark raises."""
    if kind not in FORMATS:
        raise ValueError(f"no such format: {kind}")
    writer = df.write.mode(mode).options(**_OPTIONS.get(kind, {}), **_WRITE.get(kind, {}))
    (writer.partitionBy(*partition_by) if partition_by else writer).format(kind).save(path)


def read(spark: SparkSession, path: str, kind: str, schema: str | None = None) -> DataFrame:
    """Reads what write() wrote; text formats take their types from the schema, and are read as strings (csv) or by inference (json) without one."""
    if kind not in FORMATS:
        raise ValueError(f"no such format: {kind}")
    reader = spark.read.options(**_OPTIONS.get(kind, {}), **_READ.get(kind, {}))
    return (reader.schema(schema) if schema else reader).format(kind).load(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """old with the rows of new put in by their keys: a row of new replaces that of old; of new rows with one key the last by `order` counts,
    and without an order the keys have to be unique. Null keys are equal to each other."""
    rank = Window.partitionBy(*keys).orderBy(F.desc("_new"), *([F.col(order).desc_nulls_last()] if order else []))
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return both.withColumn("_rank", F.row_number().over(rank)).where("_rank = 1").drop("_new", "_rank")


def replace_files(df: DataFrame, path: str, file_column: str = "file_name") -> None:
    """Delete-then-insert by file: partitions of the files that df has are overwritten as wholes, all others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(file_column).parquet(path)


def attach(spark: SparkSession, folders: dict[str, str]) -> dict[str, DataFrame]:
    """Dimension tables by name from Parquet folders, each also as a temporary view."""
    out = {name: spark.read.parquet(path) for name, path in folders.items()}
    for name, df in out.items():
        df.createOrReplaceTempView(name)
    return out
