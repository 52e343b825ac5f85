"""Tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where that is unset, a local master (tests) gets a temporary one; a cluster is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        context = spark.sparkContext
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = getattr(context, "_eqspark_shared", None) or tempfile.mkdtemp(prefix="eqspark-shared-")
        context._eqspark_shared = where
    return where.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends in files that outlive executors.

    Every call has a folder of its own, so no two runs meet; ``cleanup`` drops the session's folders.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/eqspark/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cleanup(spark: SparkSession) -> None:
    """Delete what ``materialize`` wrote in this application. Call it once results are written: frames that came from an operator read these files.

    ``bench.py`` and the tests' session call it at their end.
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/eqspark/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
