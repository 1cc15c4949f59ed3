"""Session and lineage helpers.

``get_spark`` builds a session for tests and the benchmark. Library functions
never change session settings; they read them.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import time
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


def _driver_memory() -> str:
    """60 % of physical memory, at most 16 GB (local mode: driver = executor)."""
    try:
        total = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
    except (ValueError, OSError, AttributeError):
        return "4g"
    return f"{max(1, min(16, int(total * 0.6 / 2**30)))}g"


def get_spark(master: str | None = None, app: str = "castwise",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Local session for tests and the benchmark (UI off, AQE on, UTC)."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(cpus) * 2
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("CASTWISE_DRIVER_MEM", _driver_memory()))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder there. Only a local master without one
    gets a fresh scratch folder, which is removed when Python ends; on any
    other master a missing setting is an error, because executors could not
    see a folder of this machine.
    """
    sc = spark.sparkContext
    current = None
    try:
        current = spark.conf.get("spark.checkpoint.dir", None)
    except Exception:  # noqa: BLE001 - a session may hide core settings
        current = None
    current = current or sc.getConf().get("spark.checkpoint.dir", None) or _OWN_DIR.get("dir")
    if current is None and not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if current is None:
        current = tempfile.mkdtemp(prefix="castwise-ckpt-")
        _OWN_DIR["dir"] = current
        atexit.register(shutil.rmtree, current, ignore_errors=True)
        try:
            spark.conf.set("spark.checkpoint.dir", current)
        except Exception:  # noqa: BLE001 - read-only core setting: keep our own copy
            pass
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(current)
    return current


_OWN_DIR: dict[str, str] = {}


def materialize(df: DataFrame, name: str | None = None) -> DataFrame:
    """Cut lineage by writing ``df`` as parquet under the shared checkpoint dir.

    Used for intermediate tables that several later stages read (feature
    store, factor tables): a lost executor then re-reads files instead of
    recomputing a long plan.
    """
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark)
    path = os.path.join(base, f"{name or 'table'}-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    out = spark.read.parquet(path)
    _WRITTEN[out] = path
    return out


#: Folder of each table that :func:`materialize` wrote and that is still held.
_WRITTEN: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def discard(*tables: DataFrame) -> None:
    """Removes the files of tables that :func:`materialize` returned and nothing reads any more; other tables stay.

    For loops that write a table a round: what the next round does not read need not wait for the session's end.
    """
    for df in tables:
        path = _WRITTEN.pop(df, None)
        if path:
            p = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_STAGES: dict[tuple, object] = {}
#: Seconds that building each stage took in this process (stages it needs included).
STAGE_SECONDS: dict[str, float] = {}


def _stamp(spark: SparkSession, path: str) -> tuple:
    """Newest modification time and total size of a file or folder, as its own file system tells."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return path, None, None
    files = list(fs.listStatus(p))
    return path, max((f.getModificationTime() for f in files), default=0), sum(f.getLen() for f in files)


def stage(spark: SparkSession, key: tuple, inputs: list[str], build):
    """A stage output reused by later stages of the same application.

    The original system hands stages over by files (the feature store and
    the factor model are written once and read by every later step). Here a
    stage result -- a table already written under the checkpoint dir, or an
    object holding such tables -- is kept per application and keyed by the
    input paths and their modification times, so a changed input rebuilds it.
    """
    stamp = tuple(_stamp(spark, p) for p in inputs)
    k = (spark.sparkContext.applicationId, key, stamp)
    if k not in _STAGES:
        began = time.time()
        _STAGES[k] = build()
        STAGE_SECONDS[" ".join(str(x) for x in key if os.sep not in str(x))] = round(time.time() - began, 3)
    return _STAGES[k]
