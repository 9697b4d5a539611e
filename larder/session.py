"""SparkSession settings and the shared scratch location.

Every job in the package reads its knobs from the session it is given; the
builder here is only for tests, benchmarks and the command line.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Fixed session defaults: UTC business dates, ANSI arithmetic, AQE with
# partition coalescing and skew-join splitting.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.parquet.datetimeRebaseModeInRead": "CORRECTED",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "larder", extra: dict | None = None) -> SparkSession:
    """Local or cluster session with the package defaults applied.

    Partition counts and memory follow the cluster unless given."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(SESSION_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if os.environ.get("LARDER_DRIVER_MEMORY"):
        conf["spark.driver.memory"] = os.environ["LARDER_DRIVER_MEMORY"]
    if extra:
        conf.update(extra)
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting must point at shared storage and is used as is.
    Only a local session (tests) without it gets a private folder.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not configured and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="larder-ckpt-"))
    return configured or sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for written intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


#: Session setting under which an execution removes its own shuffle files when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Jobs started inside run under these session settings."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def shuffles_dropped(spark: SparkSession):
    """Jobs started inside leave no shuffle files behind: for jobs whose result is written, as nobody asks for their shuffles again."""
    return settings(spark, {SHUFFLE_CLEANUP: "true"})


def stored(df: DataFrame, name: str, file_rows: int = 0) -> DataFrame:
    """Write a table under the shared checkpoint folder and read it back: cuts the lineage, survives lost executors.

    The shuffles that made it are dropped. ``file_rows``: most rows of a file, for tables whose rows are much work to read."""
    path = scratch_path(df.sparkSession, f"tables/{name}-{uuid.uuid4().hex}")
    with shuffles_dropped(df.sparkSession):
        df.write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", file_rows).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Input bytes that one shuffle partition should stand for (Parquet; several times as many in memory).
PARTITION_INPUT = 4 << 20


def fit_partitions(spark: SparkSession, folder: str) -> int:
    """Let the shuffle partitions grow with the input, so that a task's share does not; never below the session's number.

    Adaptive execution still joins small ones. Returns the number in force."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    now = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = -(-fs.getContentSummary(path).getLength() // PARTITION_INPUT) if fs.exists(path) else 0
    if wanted > now:
        spark.conf.set("spark.sql.shuffle.partitions", str(wanted))
    return max(now, wanted)
