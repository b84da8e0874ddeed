"""Sessions, and how the package reaches the executors."""

from __future__ import annotations

import hashlib
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "lattice", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution; a cluster's own settings win over these where they are set."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false", **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application, so that their Python workers can import it."""
    context = spark.sparkContext
    if getattr(context, "_lattice_shipped", False):
        return
    root = Path(__file__).resolve().parent
    files = sorted(p for p in root.rglob("*.py"))
    digest = hashlib.sha256(b"".join(p.read_bytes() for p in files)).hexdigest()[:16]
    archive = os.path.join(tempfile.mkdtemp(prefix="lattice-ship-"), f"lattice-{digest}.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for p in files:
            out.write(p, str(p.relative_to(root.parent)))
    context.addPyFile(archive)
    context._lattice_shipped = True


#: Rows of one Arrow batch. A batch of very long texts must still fit in a Python worker.
BATCH_ROWS = 256


def python_ready(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Sends the package to the executors and lowers the session's Arrow batch size to ``rows``, as texts may be very long."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) not in range(1, rows + 1):
        spark.conf.set(key, str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir that driver and executors share; one is made only where none is set."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="lattice-checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Computes ``df`` once and cuts its lineage, by a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
