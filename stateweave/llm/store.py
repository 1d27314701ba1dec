"""Intermediate tables in the folder that the cluster shares."""

import gc

from pyspark.sql import SparkSession

from ..sources.interim import discard, shared_folder, stored

__all__ = ["discard", "free_shuffles", "shared_folder", "stored"]


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished jobs, which it does when the driver collects its garbage.

    Called between steps whose results are stored, so that an operator's disk is that of its largest step, not the sum.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
