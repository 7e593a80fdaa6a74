"""Session construction and cluster-safety helpers.

``build_session`` is for tests and the bench only; library code never builds a
session itself and reads every setting from the session it is given.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app: str = "pricewise") -> SparkSession:
    """Local session for tests and the bench (UI off, AQE on)."""
    master = master or os.environ.get("PRICEWISE_MASTER", "local[*]")
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("PRICEWISE_DRIVER_MEM", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package's sources to the executors (once per session), so
    that functions run by Python workers import there whatever folder the
    workers start in.  Spark's own file distribution carries the archive."""
    if spark.conf.get("pricewise.shipped", None):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="pricewise-"), "pricewise-sources.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    spark.sparkContext.addPyFile(archive)
    spark.conf.set("pricewise.shipped", "true")


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting names a shared folder and is used as is.  Only
    when it is unset (local tests) a fresh scratch folder is created.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        configured = tempfile.mkdtemp(prefix="pricewise-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir`` for tables that a later step
    reads again."""
    checkpoint_dir(spark)
    return (spark.conf.get("spark.checkpoint.dir", None)
            or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)).rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives
    executor loss, unlike a local checkpoint)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, per_core: int = 4) -> DataFrame:
    """The same rows dealt out evenly, a few tasks to every core, whatever the
    number of files and row groups they were read from: for steps that cost
    far more than moving their rows."""
    return df.repartition(per_core * df.sparkSession.sparkContext.defaultParallelism)


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """The frame written as Parquet in the shared folder and read again, and
    its path.  Unlike a checkpoint it starts with the true size: in a loop of
    joins the planner's estimates would multiply from round to round."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove_written(spark: SparkSession, path: str) -> None:
    """Delete a table made by ``written`` that nothing reads any more."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a global aggregate (one row by construction) to
    every row of ``df``.

    The row is a scalar subquery, so building the plan runs no job and the
    consumer stays a narrow projection; more than one row is an error when
    the query runs."""
    from pyspark.sql import functions as F

    row = one_row.select(F.struct(*one_row.columns).alias("_row")).scalar()
    return df.withColumns({c: row.getField(c) for c in one_row.columns})

