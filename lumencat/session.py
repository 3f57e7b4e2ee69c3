"""Session settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


# A shuffle is planned for tasks of this size and at most this many of them; runtime re-planning
# merges what turns out smaller.
SHUFFLE_TASK_BYTES = 128 << 20
MOST_SHUFFLE_TASKS = 100_000
# Re-planning merges shuffled parts up to this size. Keys and counts are some 30 times as large in a
# hash table as shuffled and compressed, so Spark's 64 MB would be gigabytes in one task.
MERGED_TASK_BYTES = 4 << 20


def shuffle_partitions(data_bytes: int) -> int:
    """Shuffle tasks for jobs that move up to ``data_bytes``."""
    return min(MOST_SHUFFLE_TASKS, max(200, data_bytes // SHUFFLE_TASK_BYTES))


def bound_tasks(spark: SparkSession) -> None:
    """Lower the size up to which re-planning merges shuffled parts, where the session's is larger."""
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    given = spark.conf.get(name, None)
    as_bytes = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    if given is None or as_bytes(given) > MERGED_TASK_BYTES:
        spark.conf.set(name, str(MERGED_TASK_BYTES))


def configure(builder: SparkSession.Builder, data_bytes: int | None = None) -> SparkSession.Builder:
    """UTC timestamps, runtime re-planning and skew handling; ``data_bytes`` sizes the shuffles."""
    if data_bytes is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions(data_bytes)))
    return (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        # As in the documents' store: of members of one name, the last counts.
        .config("spark.sql.variant.allowDuplicateKeys", "true")
        .config("spark.ui.enabled", "false")
    )


def local_session(cores: int | str = "*", app: str = "lumencat", driver_memory: str = "8g") -> SparkSession:
    """A session for tests and the benchmark on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    spark = (
        configure(builder)
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
