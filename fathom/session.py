"""Session helpers: one place for the configuration every job relies on."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings the operators are written against. Everything else is left to the
# cluster's defaults; ``spark.sql.shuffle.partitions`` in particular is only
# set for local runs (the cluster sizes it for its data).
_CORE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # wide feature projections generate methods above the JVM's 8000-bytecode
    # JIT limit; past it Spark falls back to split (JIT-compiled) expression code
    # instead of running one huge interpreted whole-stage method
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # keep hive-style partition values (series ids) as strings
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "fathom") -> SparkSession:
    """A local session for tests and the benchmark."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in _CORE_CONF.items():
        b = b.config(k, v)
    b = (b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
          .config("spark.driver.memory", os.environ.get("FATHOM_DRIVER_MEMORY", "16g")))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def apply_core_conf(spark: SparkSession) -> None:
    """Apply the runtime-settable part of the core configuration to an existing session."""
    for k, v in _CORE_CONF.items():
        if k in ("spark.ui.enabled", "spark.ui.showConsoleProgress"):
            continue
        try:
            spark.conf.set(k, v)
        except Exception:  # static conf on a running session: leave as is
            pass


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder must be on shared storage and is configured by the
    cluster; without one a job that needs it stops. Only a local session (tests, the
    benchmark), where all tasks share the machine, gets a folder of its own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set; it has to name a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="fathom-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names (stable across sessions), or a local session's own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return (named or ensure_checkpoint_dir(spark)).rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (written to the shared checkpoint folder).

    Used between the fit and apply phases of long plans so that a lost executor
    recomputes from the checkpoint instead of from the scan.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_OPEN_COST, _MOST_BYTES = "spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes"
_STORING, _STORED = threading.Lock(), {"blocks": 0, "open_cost": ""}


@contextmanager
def _task_per_file(spark: SparkSession):
    """Meanwhile Spark reads every file by a task of its own. Blocks may overlap, also in other threads; the last one to end
    sets back what the first one found."""
    with _STORING:
        if not _STORED["blocks"]:
            _STORED["open_cost"] = spark.conf.get(_OPEN_COST)
            spark.conf.set(_OPEN_COST, spark.conf.get(_MOST_BYTES))
        _STORED["blocks"] += 1
    try:
        yield
    finally:
        with _STORING:
            _STORED["blocks"] -= 1
            if not _STORED["blocks"]:
                spark.conf.set(_OPEN_COST, _STORED["open_cost"])


@contextmanager
def stored(df: DataFrame, rows_per_file: int = 1_000_000):
    """``df`` in a folder of its own under the shared one, for as long as the block lasts.

    For rows that many passes read and that memory does not hold: the executors' memory is left to what the fits cache.
    Files hold at most ``rows_per_file`` rows, and a task reads one file. Dealt by their bytes, which compression makes
    few, millions of rows would meet in one task.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/fathom-rows-{uuid.uuid4().hex}"
    try:
        df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
        with _task_per_file(spark):
            yield spark.read.schema(df.schema).parquet(path)
    finally:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers (once per application), so that a
    job also runs where the package is not installed on the executors."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    name = os.path.basename(top)
    path = os.path.join(tempfile.mkdtemp(prefix=f"{name}-ship-"), f"{name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(top):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join(name, os.path.relpath(full, top)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)
