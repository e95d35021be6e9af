"""Session helpers: runtime settings and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "sharescope", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are designed for.

    No operator forces a broadcast: `autoBroadcastJoinThreshold` and AQE decide from the
    measured size of each side, and AQE splits skewed partitions when a side is too big.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever the job was started from."""
    context = spark.sparkContext
    if getattr(context, "_sharescope_shipped", False):
        return
    package = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="sharescope-")) / "sharescope.zip"
    with zipfile.ZipFile(archive, "w") as box:
        for source in sorted(package.rglob("*.py")):
            box.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._sharescope_shipped = True


def is_local(spark: SparkSession) -> bool:
    return spark.conf.get("spark.master", "").startswith("local[") or spark.conf.get("spark.master", "") == "local"


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the cluster in `spark.checkpoint.dir`.

    Only a local session may fall back to a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not is_local(spark):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="sharescope-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: computed once, lineage cut, and safe when executors are lost."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Computed once and kept as compressed columns in the shared folder: for many rows, of which Parquet counts without reading them."""
    folder = f"{shared_folder(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Reliable checkpoints need a directory; keep the one already set on the context, if any."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
