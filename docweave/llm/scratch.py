"""Tables written to the folder that driver and executors share.

A table that is written and read again cuts lineage: a lost executor costs a re-read, not a recomputation.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a local folder only where none is set and all runs on one machine, as in tests."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="docweave-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/docweave/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the reread table."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._docweave_path = path
    return out


def drop(table: DataFrame) -> None:
    """Delete a table made by ``materialise`` that nothing reads any more."""
    path = getattr(table, "_docweave_path", None)
    if path:
        spark = table.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_batches(df: DataFrame, size: str = "8m") -> DataFrame:
    """``df``, with Arrow batches of about ``size`` for it and what follows in the session, unless the cluster sets a size.

    A batch exists twice, in the JVM and in Python, next to what is computed from it.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not df.sparkSession.sparkContext.getConf().contains(key):
        df.sparkSession.conf.set(key, size)
    return df


def small_enough(df: DataFrame, rows: int) -> bool:
    """True if ``df`` has at most ``rows`` rows; counts no further than that."""
    return df.limit(rows + 1).count() <= rows


def apart(df: DataFrame, *own: str) -> DataFrame:
    """``df`` with the columns ``own``, and all others in one struct, so that no name made later clashes with them."""
    others = [F.col(f"`{c}`") for c in df.columns if c not in own]
    return df.select(*own, F.struct(F.lit(0).alias("__none"), *others).alias("__others"))


def together(rows: DataFrame, like: DataFrame, *own: str) -> DataFrame:
    """The columns of ``like`` again, from ``rows`` that came of ``apart(like, *own)``."""
    return rows.select(*(F.col(c) if c in own else F.col("__others").getField(c).alias(c) for c in like.columns))
