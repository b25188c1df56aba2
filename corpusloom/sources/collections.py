"""Collections: a folder with one partition per collection id."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.filters import path_in_filter
from corpusloom.operators.prefix import with_prefix_sums

PARTITION = "collection_id"


def _folder(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


# Characters that Spark escapes in the name of a partition folder, besides control characters.
ESCAPED = "\"#%'*/:=?\\{[]^\x7f"


def _of(path: str, collection_id: str) -> str:
    """Folder of a collection; the id is escaped as Spark's writer does."""
    name = "".join(f"%{ord(c):02X}" if c in ESCAPED or c < " " else c for c in collection_id)
    return f"{path.rstrip('/')}/{PARTITION}={name}"


def collection_exists(spark: SparkSession, path: str, collection_id: str) -> bool:
    fs, folder = _folder(spark, _of(path, collection_id))
    return fs.exists(folder)


def drop_collection(spark: SparkSession, path: str, collection_id: str) -> None:
    """Delete one collection; an absent one is an error."""
    fs, folder = _folder(spark, _of(path, collection_id))
    if not fs.delete(folder, True):
        raise ValueError(f"collection {collection_id!r} does not exist")


def replace_collection(
    rows: DataFrame, path: str, collection_id: str, previous_id: str | None = None
) -> None:
    """Replace a collection wholesale, then drop the one it succeeds.

    Only the partition of this collection is overwritten, and only at commit:
    readers of other collections are not disturbed.
    """
    spark = rows.sparkSession
    (
        rows.drop(PARTITION)
        .withColumn(PARTITION, F.lit(collection_id))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(PARTITION)
        .parquet(path)
    )
    if previous_id and previous_id != collection_id and collection_exists(spark, path, previous_id):
        drop_collection(spark, path, previous_id)


def list_collections(spark: SparkSession, path: str) -> DataFrame:
    """Ids of all collections below ``path``, from the names of their folders; no data file is opened."""
    fs, folder = _folder(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(folder) if s.isDirectory()]
    ids = [unquote(n.removeprefix(f"{PARTITION}=")) for n in names if n.startswith(f"{PARTITION}=")]
    return spark.createDataFrame([(i,) for i in ids], f"{PARTITION} string")


def read_collection(spark: SparkSession, path: str, collection_id: str) -> DataFrame:
    """Records of one collection. Reads its folder alone; other ids are not listed."""
    return spark.read.parquet(_of(path, collection_id)).withColumn(PARTITION, F.lit(collection_id))


def collection_get(
    records: DataFrame,
    paths: DataFrame | None = None,
    limit: int | None = None,
    offset: int = 0,
    columns: list[str] | None = None,
) -> DataFrame:
    """A page of records in id order: a distributed top-n when limited.

    An offset without a limit numbers the records by ranges of their id, which
    has to be unique, so that what is left never goes through one task.
    """
    found = records if paths is None else path_in_filter(records, paths)
    if limit is None and offset:
        numbered = with_prefix_sums(found, ["id"], {"_place": F.lit(1)})
        found = numbered.where(F.col("_place") > offset).drop("_place")
    elif limit is not None:
        found = found.orderBy("id")
        if offset:
            found = found.offset(offset)
        if limit is not None:
            found = found.limit(limit)
    return found.select(*columns) if columns else found
