"""Intermediate tables in the folder that all executors share.

Iterative operators cut their lineage by writing Parquet below
``spark.checkpoint.dir``. The setting is read from the session; only where it is
unset and the master is local (tests) is a folder made and set here. Nothing is
kept on one executor, so a lost executor costs a task retry and no rerun of
earlier steps. Results read these tables, so they are deleted when the driver's process ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; set to a new one if unset and local, an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="paraweft-")
        spark.conf.set("spark.checkpoint.dir", named)
        spark.sparkContext.setCheckpointDir(named)
        atexit.register(_delete_quietly, spark, named)
    return named.rstrip("/")


def new_root(spark: SparkSession, name: str) -> str:
    """A new folder's name below the shared one; the folder is deleted when this process ends."""
    root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete_quietly, spark, root)
    return root


def _delete_quietly(spark: SparkSession, path: str) -> None:
    try:
        delete(spark, path)
    except Exception:  # noqa: BLE001  the JVM may be gone at exit
        pass


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system its path names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Tables of one run of an operator, each a Parquet folder below one root."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = new_root(spark, name)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return it as read back: no lineage reaches behind the files."""
        schema = df.schema
        df.write.mode("overwrite").parquet(self.path(name))
        return self.read(name, schema)

    def read(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that nothing will read again."""
        for name in names:
            delete(self.spark, self.path(name))
