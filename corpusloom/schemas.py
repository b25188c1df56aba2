"""Row shapes shared by sources, operators and sinks."""

from pyspark.sql import types as T

CHUNK = T.StructType(
    [T.StructField(n, T.StringType(), False) for n in (
        "id", "path", "file_name", "extension", "folder", "language",
        "file_type", "class_name", "method_name", "project_type")]
    + [T.StructField(n, T.IntegerType(), False) for n in (
        "chunk_index", "chunk_count", "chunk_start", "chunk_end")]
    + [T.StructField("content", T.StringType(), False),
       T.StructField("keyword_entities", T.StringType(), False)]
)

ATTACHMENT = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("is_automatic", T.BooleanType()),
    T.StructField("is_repository", T.BooleanType()),
])

ATTACHMENTS = T.ArrayType(ATTACHMENT)

# Stored messages name their fields in camel case.
STORED_FILES = "array<struct<name:string,content:string,isAutomatic:boolean,isRepository:boolean>>"

REPLY_FRAGMENT = (
    "choices array<struct<delta:struct<content:string>,text:string>>,"
    "usage struct<completion_tokens:bigint>,_corrupt_record string"
)

SPAN = "struct<start:int,end:int>"
