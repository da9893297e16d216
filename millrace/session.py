"""Session settings the engine relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Event times are written and read as UTC; strings carry no zone.
TIME_ZONE = "UTC"

RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": TIME_ZONE,
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A skewed join is split even if its result has to be shuffled once more for that.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Sessions are merged inside each map task before they are shuffled.
    "spark.sql.sessionWindow.merge.sessions.in.local.partition": "true",
}

# Can only be set while a session is built. Building a plan then skips recording the Python line of every expression.
BUILD_SETTINGS = {"spark.python.sql.dataFrameDebugging.enabled": "false"}

STREAMING_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Counting the rows of a store costs a read before every write.
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    # Both sides of a stream-stream join share a store, not four.
    "spark.sql.streaming.join.stateFormatVersion": "3",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for name, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)
    return spark


def configure_streaming(spark: SparkSession) -> SparkSession:
    """Settings for stateful streaming jobs on top of the runtime ones."""
    configure(spark)
    for name, value in STREAMING_SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints: the cluster's own when it names one."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return os.path.join(tempfile.gettempdir(), "millrace-checkpoints")


def build_local(cores: int = 8, shuffle_partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("millrace")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
    )
    for name, value in BUILD_SETTINGS.items():
        builder = builder.config(name, value)
    return configure(builder.getOrCreate())
