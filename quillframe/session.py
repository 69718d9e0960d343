"""Session helpers.

The library never creates its own cluster settings: it reads what the
session already has and only fills gaps for local runs (tests, bench).
"""

from __future__ import annotations

import os
import tempfile
import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings we want on every local session; on a cluster these come from the
# job submission and are left alone.
_LOCAL_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "quillframe") -> SparkSession:
    """A local SparkSession for tests and the bench (UI off, UTC, AQE on)."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in _LOCAL_DEFAULTS.items():
        b = b.config(k, v)
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    b = b.config("spark.driver.memory", os.environ.get("QF_DRIVER_MEMORY", "16g"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the session.

    On a cluster ``spark.checkpoint.dir`` must point at shared storage and is
    used as is.  Only a local-mode session without the setting (tests, bench)
    gets a fresh scratch folder of its own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a shared folder (HDFS/S3/...) "
            "so lineage cuts and inference outputs survive executor loss"
        )
    local_dir = tempfile.mkdtemp(prefix="qf-ckpt-")
    sc.setCheckpointDir(local_dir)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A unique path under the checkpoint folder for materialised tables."""
    import uuid

    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    for made in getattr(_SCOPES, "open", ()):
        made.append(path)
    return path


_SCOPES = threading.local()


@contextmanager
def passing_scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that this thread materialises inside are deleted at the end; what is kept must have been written elsewhere by then."""
    made: list[str] = []
    _SCOPES.open = [*getattr(_SCOPES, "open", ()), made]
    try:
        yield
    finally:
        _SCOPES.open = _SCOPES.open[:-1]
        for path in made:
            _delete(spark, path)


def scratch_root(spark: SparkSession) -> str:
    """The folder of this application's materialised tables."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{spark.sparkContext.applicationId}"


def release_scratch(spark: SparkSession) -> None:
    """Delete this application's materialised tables; call it when no result that reads them is needed any more."""
    _delete(spark, scratch_root(spark))


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def rocksdb_state(spark: SparkSession) -> None:
    """Streaming state with lists, timers and more rows than the heap holds needs the RocksDB store."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    # a commit writes what the batch changed; snapshots follow in the background
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``quillframe`` importable in executors' Python workers.

    Operators that run Python on executors (the HTTP completer's
    ``mapInPandas``, the stateful stream assembly) pickle functions by module
    reference, so the package must be on the workers' path.  It is zipped once
    per application and distributed with ``addPyFile`` (Spark's file server
    ships it to every executor, including ones started later).
    """
    import zipfile

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    zpath = os.path.join(tempfile.mkdtemp(prefix="qf-pkg-"), "quillframe.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)
    _SHIPPED.add(app)
