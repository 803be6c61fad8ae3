"""Tables in the folder that driver and executors share: what is read more than once is written once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows from which a table is dealt into three pieces for each core.
MANY = 1_000_000


def over_all_cores(rows: DataFrame, *by: str) -> DataFrame:
    """rows dealt by key over all cores where one task would read over 1.5 times a core's share; else as they are, without a shuffle.

    A table of few row groups is read by as few tasks, however dear what is done with its rows, and however many splits its
    files have: the splits without a row group's middle are empty. So rows are counted by task, from the files' footers.
    Pieces are a third of a core's share, so that no core waits long for the last.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    held = rows.groupBy(F.spark_partition_id().alias("_p")).agg(F.count("*").alias("_n")).agg(F.max("_n"), F.sum("_n")).first()
    most, total = held[0] or 0, held[1] or 0
    if most * cores <= 1.5 * total:
        return rows
    return rows.repartition(cores * (3 if total > MANY else 1), *by)


class SharedTables:
    """Parquet tables under spark.checkpoint.dir; they outlive lost executors and cut lineage.

    Where the session does not name that folder, a local master uses a temporary one (tests); on any other master that
    is an error, as executors would not see the driver's folders. Tables go with drop(), or else when the session's JVM ends.
    """

    def __init__(self, spark: SparkSession):
        root = spark.conf.get("spark.checkpoint.dir", None)
        made = not root
        if made:
            if spark.sparkContext.master.split("[")[0] != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            root = tempfile.mkdtemp(prefix="folioweave-")
        self.spark = spark
        self.root = f"{root.rstrip('/')}/folioweave-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
        jvm = spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs.deleteOnExit(self._path(root) if made else path)

    def write(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """df, written once and read again; by: a column whose values get folders of their own, so filters on it skip files."""
        at = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).parquet(at)
        table = self.spark.read.schema(df.schema).parquet(at).select(*df.columns)
        table._folioweave_at = at
        return table

    def path(self, name: str) -> str:
        """A path for files that an operator writes by other means."""
        return f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._fs.delete(self._path(t._folioweave_at), True)
