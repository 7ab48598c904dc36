"""Tables written to the folder that all executors share, to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _local_root(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="eventloom-")


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the place that spark.checkpoint.dir names.

    Where it is unset, a temporary folder does for a session in one process; on a cluster it would be another one on
    each machine, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = _local_root(context.applicationId)
    return f"{root.rstrip('/')}/eventloom-{uuid.uuid4().hex}"


#: Folders that materialize() has made and nothing has removed, by application.
_written: dict[str, set[str]] = {}


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    _written.get(spark.sparkContext.applicationId, set()).discard(path)


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: lineage is cut, lost executors cost no recomputation."""
    path = shared_folder(df.sparkSession)
    _written.setdefault(df.sparkSession.sparkContext.applicationId, set()).add(path)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.eventloom_folder = path
    return out


def materialize_by(df: DataFrame, column: str) -> DataFrame:
    """As materialize(), in as many buckets of a column as shuffles have partitions: joins and groupings by that column
    read it without a shuffle. forget() takes its name out of the catalog; the folder stays, a plain one."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    _written.setdefault(spark.sparkContext.applicationId, set()).add(path)
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"eventloom_{uuid.uuid4().hex}"
    dealt = df.repartition(n, column).write.option("compression", "zstd").option("path", path)
    dealt.format("parquet").bucketBy(n, column).sortBy(column).saveAsTable(name)
    out = spark.table(name)
    out.eventloom_folder, out.eventloom_name = path, name
    return out


def forget(table: DataFrame) -> DataFrame:
    """The rows of a table that materialize_by() gave, which the catalog knows no more."""
    if name := getattr(table, "eventloom_name", None):
        spark, path = table.sparkSession, table.eventloom_folder
        out = spark.read.schema(table.schema).parquet(path)
        spark.sql(f"drop table {name}")
        out.eventloom_folder = path
        return out
    return table


def discard(*tables: DataFrame | None) -> None:
    """Remove the folders of tables that materialize() gave and that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "eventloom_folder", None):
            forget(df)
            _remove(df.sparkSession, path)


def discard_all(spark: SparkSession) -> int:
    """Remove the folders of all tables that this application has written and not discarded; their number. To be called
    when the results that were made of them have been written or are not needed any more."""
    left = list(_written.get(spark.sparkContext.applicationId, ()))
    for path in left:
        _remove(spark, path)
    return len(left)
