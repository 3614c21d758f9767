"""Tables of the store. Keys are hashes of natural keys, as Spark has no sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK_METADATA = "struct<node_type:string,depth:int,chunk_id:int,total_lines:int,name:string,recent_edit:boolean,repository_id:bigint>"
RELATION_METADATA = "struct<symbol:string,source_file:string,target_file:string>"

DDL = {
    "repositories": "id long, url string, name string, local_path string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "files": "id long, repository_id long, path string, language string, size_bytes int, fingerprint string, content_hash string, modified_at timestamp_ntz, created_at timestamp_ntz, updated_at timestamp_ntz",
    "chunks": f"id long, file_id long, content string, skeleton_content string, start_line int, end_line int, start_byte long, end_byte long, chunk_type string, language string, metadata {CHUNK_METADATA}, embedding array<float>, created_at timestamp_ntz",
    "commits": "id long, repository_id long, commit_hash string, author string, message string, commit_time timestamp_ntz, created_at timestamp_ntz",
    "file_commits": "id long, file_id long, commit_id long, change_type string, created_at timestamp_ntz",
    "relations": f"id long, source_chunk_id long, target_chunk_id long, relation_type string, metadata {RELATION_METADATA}, created_at timestamp_ntz",
    "global_symbols": "id long, file_id long, chunk_id long, name string, file_path string, created_at timestamp_ntz",
}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(DDL[name])


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], schema(name))


def key(*cols: str | Column) -> Column:
    """The id of a row: a hash of its natural key, the same on every run."""
    return F.xxhash64(*[F.col(c) if isinstance(c, str) else c for c in cols])


def conform(df: DataFrame, name: str) -> DataFrame:
    """Columns of a table in order, cast to its types; missing ones are null, others dropped. Reads older, narrower tables."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(name)])
