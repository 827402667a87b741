"""Cutting lineage through the shared folder of ``spark.checkpoint.dir``.

A written table survives the loss of executors, in contrast to a local checkpoint, and keeps its
columns, so that later readers still prune. All tables of an application lie in one folder, which
``clear`` removes when its results have been read, and which is removed at the end of the driver's program otherwise.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_written: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of this process only where the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _own[app] = tempfile.mkdtemp(prefix="tanzaku-")
        atexit.register(shutil.rmtree, _own[app], True)
    return f"file://{_own[app]}"


def _folder(spark: SparkSession) -> str:
    """The folder of this application, noted for its removal."""
    app = spark.sparkContext.applicationId
    if app not in _written:
        _written[app] = f"{shared_dir(spark)}/tanzaku-{app}"
        atexit.register(_remove, app)
    return _written[app]


def _remove(app: str) -> None:
    """Removes the folder of an application, on whatever file system it lies; nothing if the engine is gone."""
    path = _written.pop(app, None)
    gateway = SparkContext._gateway
    if path is None or gateway is None:
        return
    try:
        at = gateway.jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(gateway.jvm.org.apache.hadoop.conf.Configuration()).delete(at, True)
    except Exception:  # a driver that ends must not fail for what is left behind
        pass


def clear(spark: SparkSession) -> None:
    """Removes every table that this application has stored; results that read them must have been used."""
    _remove(spark.sparkContext.applicationId)


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as parquet in the shared folder and read back; see ``clear``."""
    path = f"{_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
