"""Reading inputs and cutting lineage with tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir``, a path of any file system Spark knows."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset in a local session, as in tests, a temporary folder is made and set; on
    a cluster that is an error, since executors would write to disks of their own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-tidemark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialise(df: DataFrame, *by: str) -> DataFrame:
    """Write ``df`` once to the shared folder, in folders ``by`` value of columns if asked, and return the written table.

    Its readers depend on files alone, so a lost executor costs no recomputation
    of what came before, and statistics of the written files steer later joins. Nothing deletes the table, since a lazy result may
    read it after the query has returned: whoever owns the shared folder clears it after the job.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*by) if by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions_for(spark: SparkSession, rows: int, per_task: int = 500_000) -> int:
    """Shuffle partitions for ``rows``: those of the session, and more where a task would get above ``per_task`` rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand whole texts to Python in batches of ``rows``: Spark's default of 10,000 long texts is much to hold at once."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
