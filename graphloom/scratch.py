"""Tables that cut lineage, kept in the folder that all executors share.

The folder is the one the cluster names in spark.checkpoint.dir. Only a local master, where the
driver and the executors are one process, may fall back to a temporary folder of its own.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; raises on a cluster that names none."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _own:
        _own[sc.applicationId] = tempfile.mkdtemp(prefix="graphloom-")
        sc.setCheckpointDir("file://" + _own[sc.applicationId])
    return "file://" + _own[sc.applicationId]


def write_table(df: DataFrame) -> DataFrame:
    """df as a written table: its lineage ends here and a lost executor costs nothing already written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graphloom/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[path] = spark
    table = spark.read.schema(df.schema).parquet(path)
    table._graphloom_path = path
    return table


def drop_table(table: DataFrame | None) -> None:
    """Delete a table of write_table() that no later action reads."""
    path = getattr(table, "_graphloom_path", None)
    if path in _written:
        _delete(path, _written.pop(path))


def _delete(path: str, spark: SparkSession) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may be gone at exit
        pass


@atexit.register
def _drop_all() -> None:
    for path, spark in list(_written.items()):
        if spark.sparkContext._jsc is not None:
            _delete(path, spark)
    import shutil

    for path in _own.values():
        shutil.rmtree(path, ignore_errors=True)
