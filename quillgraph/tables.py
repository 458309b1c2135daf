"""Schemas of the graph tables and reading and writing of them as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_L, _S, _TS = T.LongType(), T.StringType(), T.TimestampType()


def _struct(**cols: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v, True) for k, v in cols.items()])


SCHEMAS: dict[str, T.StructType] = {
    "repositories": _struct(id=_L, path=_S, name=_S, indexed_at=_TS, manifest_json=_S),
    "nodes": _struct(id=_L, repository_id=_L, node_type=_S, name=_S, file_path=_S, metadata_json=_S),
    "edges": _struct(id=_L, repository_id=_L, source_node_id=_L, target_node_id=_L, edge_type=_S, metadata_json=_S),
    "node_vectors": _struct(node_id=_L, model=_S, vector=T.ArrayType(T.FloatType())),
    "commits": _struct(id=_L, repository_id=_L, hash=_S, author=_S, email=_S, message=_S, committed_at=_S),
    "commit_files": _struct(commit_id=_L, file_path=_S, change_type=_S),
    "commit_authors": _struct(id=_L, repository_id=_L, name=_S, email=_S, commit_count=_L),
    "architecture": _struct(repository_id=_L, layer=_S, pattern=_S, description=_S),
    "source_heads": _struct(repository_id=_L, file_path=_S, n_bytes=_L, n_lines=_L, longest_line=_L, head=_S),
    "documents": _struct(
        doc_id=_L, text=_S, lang=_S, source=_S, n_chars=_L, doc_kind=_S, repository_id=_L, collected_at=_TS
    ),
    "eval_items": _struct(item_id=_L, suite=_S, text=_S),
}


def load(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Read the Parquet table ``name`` below ``root`` (a file or a folder)."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def empty(spark: SparkSession, name: str) -> DataFrame:
    """An empty table with the declared schema, for tests and first runs."""
    return spark.createDataFrame([], SCHEMAS[name])


def save(df: DataFrame, root: str, name: str, *partition_by: str) -> None:
    """Write a table, replacing only the partitions that ``df`` holds rows of."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{root}/{name}.parquet")


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def replace_repository(df: DataFrame, root: str, name: str, repository_id: int) -> None:
    """Put the rows of one repository in place of those stored; without rows its partition goes."""
    if not df.isEmpty():
        return save(df, root, name, "repository_id")
    spark = df.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}.parquet/repository_id={repository_id}")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
