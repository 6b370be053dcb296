"""Session settings the library counts on at scale."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Adaptive execution picks the number of reduce tasks, broadcasts a side only after measuring it,
# and splits hot partitions. ``forceOptimizeSkewedJoin`` lets it split them also where an aggregate
# on the same key follows the join, at the price of one more shuffle for that join. Rows of text keys
# are many times larger in memory than as compressed shuffle files: partitions of 64 MB, the default,
# are more than a task's share of an executor sorts or groups without spilling. The last setting lets
# it hash a shuffled side instead of sorting both when every partition of that side was
# measured to be small.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16MB",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "32MB",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings to a running session. Partition counts and memory are the cluster's."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark
