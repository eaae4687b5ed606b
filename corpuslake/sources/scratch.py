"""Tables kept between steps, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where that is unset, a local folder serves a session on one machine, and a cluster's session is refused."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return os.path.join(tempfile.gettempdir(), f"corpuslake-{os.getuid()}")


_made: list[str] = []


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete folders of ``fresh``; those of a session that has been stopped stay."""
    jvm, context = spark.sparkContext._jvm, spark.sparkContext._jsc
    if jvm is None or context is None:
        return
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(context.hadoopConfiguration()).delete(at, True)
        if path in _made:
            _made.remove(path)


def fresh(spark: SparkSession, label: str) -> str:
    """A new folder name in the shared folder; what is written there goes with ``remove``, or when the driver ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(lambda: remove(spark, *_made))
    _made.append(path)
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and read back from the shared folder: lineage is cut, and a lost executor costs nothing of it. Its files go once the
    table is garbage if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set; else whoever keeps the folder has to clear it."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()
