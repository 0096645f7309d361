"""What the operators of this package share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame

from stacklight.session import checkpoint_dir


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back: the lineage ends here, the loss of an
    executor costs nothing, and the columns stay compressed and prunable. The table goes when the driver ends."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/stacklight-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_drop, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _drop(spark, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone already
        pass


def keep_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns with clashing names can do no harm."""
    return df.select(*[df[n] for n in names])
