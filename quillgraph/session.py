"""Session helpers: local sessions for tests, the shared checkpoint folder, cutting lineage."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", app: str = "quillgraph", **conf: str) -> SparkSession:
    """A session for tests and benches. On a cluster the session is the caller's own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder in which lineage is cut.

    A cluster names a folder that all executors share in ``spark.checkpoint.dir``. Where that setting is
    absent a temporary folder is made if all runs on one machine; elsewhere it would not be shared, so
    that is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    folder = named or tempfile.mkdtemp(prefix=f"quillgraph-{os.getpid()}-")
    sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def shared_folder(spark: SparkSession) -> str:
    """The folder that is named for checkpoints, in which each session has one of its own."""
    return ensure_checkpoint_dir(spark).rsplit("/", 1)[0]


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and return it without its lineage.

    The files outlive any executor, and values that are not deterministic (generated ids) are fixed.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of the session's executors.

    The package is zipped into the driver's own file folder and fetched from there by executors.
    """
    target = Path(SparkFiles.getRootDirectory()) / "quillgraph.zip"
    if target.exists():
        return
    package = Path(__file__).parent
    with zipfile.ZipFile(f"{target}.part", "w") as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    os.replace(f"{target}.part", target)
    spark.sparkContext.addPyFile(str(target))
