"""Session and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_local_scratch: list[str] = []
#: Folders written inside each open ``scratch`` block, the innermost last.
_open: list[list[str]] = []


def get_session(app: str = "weftline", **conf: str) -> SparkSession:
    """A session with the settings every operator expects; a running one is reused."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return importable(builder.getOrCreate())


def importable(spark: SparkSession) -> SparkSession:
    """Python workers started from now on find this package where the driver found it.

    On a cluster the package must lie at that path, or be installed, on every machine.
    """
    root = str(Path(__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only a local session may go without: it gets a temporary folder. A cluster without the
    setting is an error, since a machine-local folder would be lost with its machine.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local_scratch:
        _local_scratch.append(tempfile.mkdtemp(prefix="weftline-"))
        atexit.register(shutil.rmtree, _local_scratch[0], True)
    return "file://" + _local_scratch[0]


def new_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, as a whole URI that any machine reads in the same way."""
    path = f"{shared_dir(spark)}/weftline-{name}-{uuid.uuid4().hex[:12]}"
    raw = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = raw.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(raw).toString()
    uri = uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri
    if _open:
        _open[-1].append(uri)
    return uri


def materialize(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it again: the lineage is cut, and a lost
    executor costs nothing but its running tasks."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._weftline_folder = path
    return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[..., None]]:
    """A block at whose end the folders written inside are deleted, but for those of the tables
    (as ``materialize`` gave them) that were handed to the function it yields. These pass on to the
    block around it, if there is one."""
    _open.append([])
    kept: set[str] = set()

    def keep(*tables: DataFrame) -> None:
        kept.update(t._weftline_folder for t in tables)

    try:
        yield keep
    finally:
        written = _open.pop()
        if _open:
            _open[-1].extend(f for f in written if f in kept)
        for folder in written:
            if folder not in kept:
                _delete(spark, folder)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def remove(df: DataFrame) -> None:
    """Delete a table made by ``materialize`` that nothing reads any more."""
    _delete(df.sparkSession, df._weftline_folder)
