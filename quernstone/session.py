"""Session helpers: table access, reliable checkpoints and size checks."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Upper bound, in rows, of anything this library broadcasts on purpose.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for checkpoints: the shared folder that the cluster names in
    ``spark.checkpoint.dir``.  Where none is set, a session on one machine (``local[...]``)
    gets a temporary one; on a cluster that raises, as no other machine could read it."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    wanted = spark.conf.get("spark.checkpoint.dir", None)
    if not wanted and not re.match(r"local(\[|$)", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    sc.setCheckpointDir(wanted or tempfile.mkdtemp(prefix="quernstone-ckpt-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores, for per-row work that
    is heavy for its bytes.  A large input has more partitions than that and is left as
    it is, so this shuffles small inputs only (a table of one file, say)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.isStreaming or df.rdd.getNumPartitions() >= cores else df.repartition(cores)
