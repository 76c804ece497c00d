"""Tables that iterations keep in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder on a local master. Executors of a cluster would not see that, so there it is an error."""
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    base = sc.getConf().get("spark.checkpoint.dir") or (known.get() if known.isDefined() else None)
    if not base and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not base:
        base = tempfile.mkdtemp(prefix="lodestone-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A folder of its own in the shared one."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df and read it back: a cut of the lineage that survives the loss of executors."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
