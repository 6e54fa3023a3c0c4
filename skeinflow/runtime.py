"""Session helpers: table reading and lineage cuts in the cluster's shared folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_LOCAL_FALLBACK: dict[str, str] = {}


def session(app: str = "skeinflow", cores: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the library is tested under."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    here = os.path.dirname(os.path.abspath(__file__))
    if not os.path.isdir(here):
        return  # already running from an archive
    archive = os.path.join(tempfile.mkdtemp(prefix="skeinflow-"), "skeinflow.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(here):
            for f in files:
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.relpath(path, os.path.dirname(here)))
    spark.sparkContext.addPyFile(archive)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data directory."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one where it is unset and all tasks run in this process (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FALLBACK:
        _LOCAL_FALLBACK[app] = "file://" + tempfile.mkdtemp(prefix="skeinflow-")
    return _LOCAL_FALLBACK[app]


_BASES: dict[str, list[str]] = {}


@atexit.register
def _clear_at_exit() -> None:
    """What is left in the shared folder when the driver ends; a folder that can't be reached any more stays."""
    spark = SparkSession.getActiveSession() if _BASES else None
    if spark is not None:
        try:
            clear_scratch(spark)
        except Exception:
            pass


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this application's operators left in the shared folder. Results not yet written can't be read afterwards."""
    for base in _BASES.pop(spark.sparkContext.applicationId, []):
        target = spark._jvm.org.apache.hadoop.fs.Path(base)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Tables written to the shared folder so that a later step, or a retry after a lost executor,
    reads files instead of recomputing a lineage. ``save`` replaces a table's plan by a scan of its
    files; ``drop`` deletes one that no later step reads."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        ship(spark)
        self.spark = spark
        self.base = f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"
        self._n = 0
        _BASES.setdefault(spark.sparkContext.applicationId, []).append(self.base)

    def save(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.base}/{self._n}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_scratch_path", None)
        if path is None:
            return
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
