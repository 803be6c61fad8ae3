"""Record files: JSON lines and Parquet with declared schemas, chunk tables, metric files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Declared record schemas; readers never infer.
SCHEMAS = {
    "multiple_choice": "_id string, context string, question string, choice_A string, choice_B string, choice_C string, choice_D string, answer string",
    "multi_task": "id long, context string, input string, answer array<string>, options array<string>",
    "reports": "id string, level long, set long, length long, type string, language string, question string, instruction string, prompt_template string, doc array<string>, answer string, shuffle_doc boolean, docs string",
    "retrieved_qa": "id string, question string, answers array<string>, ctxs array<struct<id:string,psg_id:string,score:double,text:string,has_answer:boolean>>, positive_ctxs array<struct<psg_id:string>>",
    "cited_qa": "question string, docs array<struct<title:string,text:string,sent:string>>, qa_pairs array<struct<question:string,short_answers:array<string>>>, annotations array<struct<long_answer:string>>, answer string, answers array<array<string>>, claims array<string>",
    "multi_hop": "id string, question string, answer string, supporting_facts struct<title:array<string>,sent_id:array<int>>, context struct<title:array<string>,sentences:array<array<string>>>",
    "passage": "pid long, title string, passage string",
    "hits": "id string, chunks array<string>",
    "chunks": "chunk_id long, text string, embedding array<float>",
}


def read_json(spark: SparkSession, path: str, schema: str | StructType, whole: bool = False) -> DataFrame:
    """JSON lines, or with `whole` files of one array; schema by name or as given."""
    return spark.read.schema(SCHEMAS.get(schema, schema) if isinstance(schema, str) else schema).option("multiLine", whole).json(path)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, "reports").withColumnRenamed("docs", "context")


def read_retrieved(spark: SparkSession, folder: str, split: str, name: str) -> DataFrame:
    """JSON lines for split kilt, a JSON array for split alce."""
    if split == "kilt":
        return read_json(spark, f"{folder}/{name}.jsonl", "retrieved_qa")
    return read_json(spark, f"{folder}/{name}.json", "cited_qa", True)


def read_bounded(spark: SparkSession, path: str, schema: str, length: str, bounds: int | tuple[int, int] | None) -> DataFrame:
    """Rows of a length: at most a number, or within a closed pair."""
    rows = read_json(spark, path, schema)
    if bounds is None:
        return rows
    return rows.where(F.col(length) <= bounds) if isinstance(bounds, int) else rows.where(F.col(length).between(*bounds))


def read_ordered(rows: DataFrame, name: str = "ordinal") -> DataFrame:
    """rows with an increasing ordinal in file order (gaps between partitions)."""
    return rows.withColumn(name, F.monotonically_increasing_id())


def read_tree(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """Metric files of a folder tree, each row with its file's path."""
    return spark.read.schema(schema).option("multiLine", True).json(glob).withColumn("path", F.col("_metadata.file_path"))


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_splits(rows: DataFrame, path: str) -> None:
    """Parquet under a folder per value of split."""
    rows.write.mode("overwrite").partitionBy("split").parquet(path)


def write_both(rows: DataFrame, path: str) -> None:
    """JSON lines and Parquet of the same rows, computed once."""
    kept = rows.persist()
    try:
        write_jsonl(kept, f"{path}/jsonl")
        kept.write.mode("overwrite").parquet(f"{path}/parquet")
    finally:
        kept.unpersist()


def write_metrics(rows: DataFrame, path: str, lo: int | None = None, hi: int | None = None) -> None:
    """One JSON file folder whose name carries the length range."""
    name = "metrics" if lo is None else f"metrics_{lo}_{hi}"
    rows.coalesce(1).write.mode("overwrite").json(f"{path}/{name}")


def write_index(chunks: DataFrame, path: str) -> None:
    chunks.select("chunk_id", "text", "embedding").write.mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """A chunk table; an error if its folder or a column is missing."""
    rows = spark.read.parquet(path)
    want = StructType.fromDDL(SCHEMAS["chunks"])
    if [(f.name, f.dataType) for f in rows.schema] != [(f.name, f.dataType) for f in want]:
        raise ValueError(f"{path} holds {rows.schema.simpleString()}, not {want.simpleString()}")
    return rows
