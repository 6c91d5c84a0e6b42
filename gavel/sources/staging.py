"""Tables written once and read several times.

A staged table lies in the folder that all executors share (`spark.checkpoint.dir`), so it survives the loss of an
executor and cuts the lineage. Only in local runs without the setting, as in tests, a folder of this machine is used;
a cluster without it is refused.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints, or a temporary one in local runs without the setting."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="gavel-")
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(_own[app])
    return _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; what is written there is deleted with the session's tables."""
    path = f"{shared_folder(spark).rstrip('/')}/gavel-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def stage(df: DataFrame, name: str, codec: str = "zstd", by: list[str] | None = None) -> DataFrame:
    """Writes `df` as a Parquet table in the shared folder and reads it back. Columns and rows stay as they are.

    `by` names columns that become folders, for tables of which each reader wants one kind of row.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", codec)
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Deletes every table that this session has staged."""
    kept = []
    for owner, path in _written:
        if owner is not spark:
            kept.append((owner, path))
            continue
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session may have ended
            pass
    _written[:] = kept


@atexit.register
def _forget_all() -> None:
    for spark in {id(s): s for s, _ in _written}.values():
        forget(spark)
