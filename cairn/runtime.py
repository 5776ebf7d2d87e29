"""Session helpers shared by every operator: table access and durable cut points."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory (one file or a folder of files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder, named in ``spark.checkpoint.dir``. A folder of our own is made only where none is
    named and all work is done on this machine; on a cluster that raises an error, as executors could not share it.

    Sessions that set ``spark.cleaner.referenceTracking.cleanCheckpoints`` have what is no longer used removed.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="cairn-checkpoint-"))


def settle(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder, so that what follows survives lost executors
    and does not compute ``df`` again for each of its uses."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
