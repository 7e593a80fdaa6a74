"""A1 / A2: reading and writing stage tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A1: load a parquet stage table, with a declared schema when given (no
    inference pass over the files)."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(path)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir.rstrip('/')}/{name}.parquet")


def register_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Expose the driver tables as temp views so the shared fixture SQL runs
    unchanged in Spark and in DuckDB.  A view already bound to the same file
    in this session is kept (re-creating it would list and footer-read the
    files again)."""
    for name in names:
        path = f"{sf_dir.rstrip('/')}/{name}.parquet"
        conf_key = f"pricewise.view.{name}"
        if spark.conf.get(conf_key, None) == path and spark.catalog.tableExists(name):
            continue
        read_table(spark, path).createOrReplaceTempView(name)
        spark.conf.set(conf_key, path)


def write_stage(df: DataFrame, path: str, partition_by: list[str] | None = None,
                mode: str = "overwrite") -> DataFrame:
    """A2: persist a stage as parquet (the checkpoint between notebooks) and
    return the re-read table, whose lineage starts at the written files."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.parquet(path)
