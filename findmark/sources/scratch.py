"""Intermediate tables in the folder that driver and executors share.

The folder is the session's ``spark.checkpoint.dir``, else the checkpoint folder that the context was given.  On one machine
(a local master) without either, a temporary folder is set for the application; on a cluster that is an error, since the
folders of its machines are not shared.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def scratch_dir(spark: SparkSession) -> str:
    context = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if given:
        return given.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="findmark-"))
    return context.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``df`` as a table that is written once: its lineage is cut, and a lost executor costs no earlier step again."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """No rows, known as such when a statement is planned: joins with it cost no job."""
    return spark.range(1).where("false").select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema)))


def together(spark: SparkSession, *calls: Callable) -> list:
    """Results of calls that do not need each other, each in its own thread: small statements wait for the driver more than for
    tasks."""
    with ThreadPoolExecutor(max(1, len(calls))) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(c)) for c in calls]]


def stored_by_series(df: DataFrame, name: str) -> DataFrame:
    """``stored``, dealt to buckets by ``series_uuid``: joins, windows and groups within series need no shuffle any more.

    There are as many buckets as ``spark.sql.shuffle.partitions``.  Joins on the series and further keys use them only where
    Spark does not ask for buckets by all keys, which is set for the session.  So is that a task may have a few files open: its
    one bucket then needs no sort.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    spark.conf.set("spark.sql.maxConcurrentOutputFileWriters", "4")
    path = new_path(spark, name)
    table = path.rpartition("/")[2].replace("-", "_")
    df.repartition(n, "series_uuid").write.option("compression", "zstd").option("path", path).bucketBy(n, "series_uuid").saveAsTable(table, format="parquet")
    out = spark.table(table)
    out._stored_at = path
    return out


def chosen(table: DataFrame, *columns: str) -> DataFrame:
    """Columns of a table of ``stored``, which count as stored, too."""
    out = table.select(*columns)
    out._stored_at = table._stored_at
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of ``stored`` that nothing reads any more."""
    for t in tables:
        session = t.sparkSession
        path = session._jvm.org.apache.hadoop.fs.Path(t._stored_at)
        path.getFileSystem(session._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
