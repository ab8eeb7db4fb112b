"""What a session must be set to for right results."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Spark 4.1 may take the rows of a union as dealt by the children's key. Where children read one shuffle again and adaptive
#: execution merges its partitions differently for each, rows of a key then lie in several tasks and groups
#: come out twice (``tests/test_operators.py`` has the case). Without it a union is dealt anew where that is needed.
UNIONS = "spark.sql.unionOutputPartitioning"


def guarded(spark: SparkSession) -> SparkSession:
    """The session, with the setting off."""
    if spark.conf.get(UNIONS, "true") != "false":
        spark.conf.set(UNIONS, "false")
    return spark
