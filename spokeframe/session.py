"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

MIB = 1024**2


def cluster_settings(input_bytes: int) -> dict[str, str]:
    """Settings for a run over ``input_bytes`` of trip files.

    Shuffles here carry ride ids and station names at most, well below the
    input, so one initial shuffle partition per 512 MiB of input keeps each
    within executor memory; adaptive execution merges what turns out small.
    Scan splits grow with the input so that the cleaned table gets files of a
    useful size and the task count stays manageable.
    """
    partitions = max(200, input_bytes // (512 * MIB))
    split = max(128 * MIB, input_bytes // 200_000)
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 * MIB),
        "spark.sql.files.maxPartitionBytes": str(split),
    }


def local_session(cores: int | str = "*", name: str = "spokeframe", **settings: str) -> SparkSession:
    """A single-machine session, for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str | None:
    """Where intermediate tables may be written, seen by every executor.

    The session's ``spark.checkpoint.dir`` decides. Only a local-mode session
    without one gets a temporary folder; on a cluster there is none then, and
    callers compute instead of storing. A folder of the local disk is refused on a
    cluster: each executor would write to a disk of its own, and later reads would
    miss what the others wrote.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    local = spark.sparkContext.master.startswith("local")
    if not configured:
        return tempfile.mkdtemp(prefix="spokeframe-") if local else None
    if configured.startswith("file:") and not local:
        raise ValueError(f"spark.checkpoint.dir is {configured}, which executors do not share")
    return configured
