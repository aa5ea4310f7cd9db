"""Tables by path: parquet of the data folder, CSV files, and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table of ``folder``; times without zone are read as UTC instants."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    for f in df.schema.fields:
        if isinstance(f.dataType, TimestampNTZType):
            df = df.withColumn(f.name, _utc(f.name))
    return df


def _utc(name: str):  # noqa: ANN202
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col(name)).cast("timestamp")


def read(spark: SparkSession, source: DataFrame | str, schema: str | None = None) -> DataFrame:
    """A DataFrame as it is; a path as parquet if it ends so, else as CSV with a header.

    ``schema`` saves CSV the reading that infers its types; without one they are inferred from all rows.
    """
    if isinstance(source, DataFrame):
        return source
    if not isinstance(source, str):
        raise TypeError("a table must be a DataFrame or one path")
    if source.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(source)
    return spark.read.csv(source, header=True, schema=schema, enforceSchema=False) if schema else spark.read.csv(source, header=True, inferSchema=True)


def write(df: DataFrame, path: str | None) -> None:
    """Write to ``path`` (parquet if it ends so, else CSV with a header); nothing if it is None."""
    if path is None:
        return
    if path.rstrip("/").endswith(".parquet"):
        df.write.mode("overwrite").parquet(path)
    else:
        df.write.mode("overwrite").csv(path, header=True)
