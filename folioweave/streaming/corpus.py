"""Streams of documents: passages as they come, running totals, an index that grows by batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from folioweave.functions import text as T
from folioweave.operators.retrieval import append_to_index
from folioweave.plans.corpus import passages


def read_documents(spark: SparkSession, folder: str, schema: str | StructType, files: int = 1) -> DataFrame:
    """Parquet files of a folder as they arrive, so many to a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def write_passages(docs: DataFrame, out: str, state: str, size: int = 100) -> StreamingQuery:
    """Passages of everything there is, appended as Parquet; a restart goes on where it ended."""
    return passages(docs, size).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()


def running_totals(docs: DataFrame, min_words: int = 10) -> DataFrame:
    """Documents, short documents and words so far, for a complete-mode sink."""
    n = T.word_count(F.col("text"))
    return docs.groupBy().agg(F.count("*").alias("docs"), F.count_if(n < min_words).alias("short"), F.sum(n).alias("words"))


def grow_index(docs: DataFrame, out: str, state: str, order: list[str]) -> StreamingQuery:
    """A chunk table numbered on from batch to batch; a batch that is run again replaces its own part."""
    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        jvm = spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(out)
        parts = [p for p in (path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(jvm.org.apache.hadoop.fs.Path(f"{out}/batch=*")) or [])]
        earlier = [s.getPath().toString() for s in parts if int(s.getPath().getName().split("=")[1]) < number]
        index = spark.read.parquet(*earlier) if earlier else None
        before = index.agg(F.coalesce(F.max("chunk_id"), F.lit(-1)).alias("n")).first().n if index is not None else -1
        if not batch.isEmpty():
            append_to_index(index, batch, order).where(F.col("chunk_id") > before).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", state).trigger(availableNow=True).start()
