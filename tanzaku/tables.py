"""Loading of the parquet tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from tanzaku.shipping import ship


def load(spark: SparkSession, sf_dir: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """One table of ``sf_dir``; ``columns`` prunes early so that other columns can never clash."""
    ship(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


SMALL_SCAN = 16  #: a scan of fewer splits, 2 GB with the usual ones, is small enough to be dealt out anew


def spread(scan: DataFrame) -> DataFrame:
    """A scan of so few splits that most cores would idle over all of them, ahead of costly functions; any other stays as it is."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < min(cores // 2, SMALL_SCAN) else scan
