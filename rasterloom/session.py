"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, memory: str = "12g") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("rasterloom")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.extraJavaOptions", "-Xss8m")
        .getOrCreate()
    )


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder named by ``spark.checkpoint.dir``.

    Only a local master without that setting falls back to a fresh temporary
    folder, because there the driver's disk is the shared disk.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a shared folder")
            folder = tempfile.mkdtemp(prefix="rasterloom-ckpt-", dir=os.environ.get("TMPDIR"))
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder on shared storage for data that is written and read back."""
    import uuid

    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        folder = re.sub("^file:(//)?(?=/)", "", folder).rstrip("/")
        if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", folder):
            raise RuntimeError(f"a chunk store needs a mounted folder, not {folder}")
    elif spark.sparkContext.master.startswith("local"):
        folder = tempfile.gettempdir()
    else:
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    path = os.path.join(folder, f"rasterloom-{name}-{uuid.uuid4().hex}")
    os.makedirs(path, exist_ok=True)
    return path
