"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Kept alive for the life of the interpreter; removed when it ends.
_local_scratch: dict[str, tempfile.TemporaryDirectory] = {}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks. Clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("millrace")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession, label: str = "run") -> str:
    """A new folder name under the cluster's ``spark.checkpoint.dir``.

    Every executor has to see the folder, so a machine-local one is made only
    when the session itself is local and names none.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(
                "set spark.checkpoint.dir to a folder all executors can reach"
            )
        app = spark.sparkContext.applicationId
        if app not in _local_scratch:
            _local_scratch[app] = tempfile.TemporaryDirectory(prefix="millrace-")
        base = _local_scratch[app].name
    return f"{base.rstrip('/')}/millrace-{label}-{uuid.uuid4().hex}"
