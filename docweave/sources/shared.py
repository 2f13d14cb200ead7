"""Tables in the folder that driver and executors share: written, reread, and so free of what led to them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; a temporary one only where all is one machine."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="docweave-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def held(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written and reread: a lost executor costs a reread, not the steps before."""
    path = shared_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
