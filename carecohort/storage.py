"""Where intermediate tables go, and how lineage is cut.

Several reports read the same scored table, and iterative fits read theirs many
times.  Such a table is written once as parquet to the cluster's shared folder
(``spark.checkpoint.dir``) and read back: later readers prune columns, and a
lost executor costs a re-read of a file, not a rebuild of the cohort.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """Shared folder named by the session, else one in the warehouse, which executors share too."""
    named = spark.conf.get(_SETTING, None)
    if named:
        return named.rstrip("/")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_intermediate"


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of what was written."""
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    path = f"{shared_folder(spark)}/{app}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.mode("errorifexists").parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)
