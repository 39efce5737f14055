"""Session helpers: a local session for tests, table loading, lineage cutting."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def local_session(cpus: str | int = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the engine is tested with."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("gridwright")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables in a directory of Parquet files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.

    Only a local session without that setting gets a temporary one; on a cluster a machine-local folder would be lost with
    its machine, so that is an error.
    """
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if spark.sparkContext.master.split("[")[0] != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="gridwright-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return context.getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder (:func:`shared_folder`) and read it from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once an application, so its kernels run wherever the driver was started.

    The archive is written to the shared folder, so executors that come later find it too.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root, packed = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, str(Path(root.name) / file.relative_to(root)))
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark), f"{root.name}.zip")
    out = path.getFileSystem(context._jsc.hadoopConfiguration()).create(path, True)
    out.write(bytearray(packed.getvalue()))
    out.close()
    context.addPyFile(path.toString())
    _shipped.add(context.applicationId)
