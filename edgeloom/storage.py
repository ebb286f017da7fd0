"""Lineage cuts through the shared folder.

Iterative operators cut their lineage by writing a Parquet table below the folder the session names in
``spark.checkpoint.dir`` and reading it back.  Such a table outlives any executor.  A folder of our own is made only when
the setting is empty and Spark runs in one JVM (tests, notebooks).
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None
_live: dict[str, SparkSession] = {}
_tables: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; never a machine-local one on a cluster."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="edgeloom-")
    return f"file://{_own_dir}"


def _delete(spark: SparkSession, path: str) -> None:
    name = _tables.pop(path, None)
    if name:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Tables of one operator call.  ``save`` writes and rereads, ``drop`` deletes a table that is no longer needed.

    Tables not dropped are removed when the Python process ends, since returned DataFrames may still read them.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/edgeloom/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
        self._n = 0
        self._paths: dict[int, str] = {}

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self._n}"
        self._n += 1
        df.write.parquet(path)
        _live[path] = self.spark
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        out._edgeloom_path = path
        return out

    def bucketed(self, df: DataFrame, *keys: str) -> DataFrame:
        """Like ``save``, laid out in buckets of ``keys``, as many as there are shuffle partitions, one file each: joins on the
        keys then read the table where it lies and only the other side is shuffled."""
        path = f"{self.root}/{self._n}"
        self._n += 1
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        name = f"spark_catalog.default.edgeloom_{uuid.uuid4().hex}"
        laid = df.repartition(buckets, *keys).write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
        laid.option("path", path).saveAsTable(name)
        _live[path], _tables[path] = self.spark, name
        out = self.spark.table(name)
        out._edgeloom_path = path
        return out

    def drop(self, *frames: DataFrame | None) -> None:
        for df in frames:
            path = getattr(df, "_edgeloom_path", None)
            if path and _live.pop(path, None):
                _delete(self.spark, path)


@atexit.register
def _cleanup() -> None:
    for path, spark in list(_live.items()):
        try:
            _delete(spark, path)
        except Exception:  # the session may have ended already
            break
    _live.clear()
