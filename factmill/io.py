"""Reading tables, and cutting lineage with tables in the shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; only a local session may do without and gets a temporary one."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="factmill-")
        sc.setCheckpointDir(at)
        atexit.register(_delete, spark, at)
    return at


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone, and with it whoever could delete
        pass


_scopes: list[list[str]] = []


@contextmanager
def temporary_tables(spark: SparkSession):
    """Deletes at its end what was materialized inside; results must have been written or collected by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            _delete(spark, path)


def register_temporary(spark: SparkSession, path: str) -> None:
    """The folder goes at the end of the innermost ``temporary_tables``, else when Python exits."""
    if _scopes:
        _scopes[-1].append(path)
    else:
        atexit.register(_delete, spark, path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a Parquet table in the shared folder and read back.

    The rows outlive lost executors and later plans start from the table, which
    carries sizes for the optimizer. The table is deleted at the end of the
    innermost ``temporary_tables``, else when Python exits.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/factmill/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    register_temporary(spark, path)
    return spark.read.schema(df.schema).parquet(path)
