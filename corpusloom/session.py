"""Session defaults and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "corpusloom", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators rely on; AQE does the sizing."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only on one machine is a temporary folder made where the session names
    none; on a cluster its executors would not share it, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="corpusloom-"))
        current = spark.sparkContext.getCheckpointDir()
    return current


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other run uses."""
    return f"{shared_dir(spark).rstrip('/')}/corpusloom/{name}-{uuid.uuid4().hex}"


def checkpoint(df, name: str = "step"):
    """Write a step to the shared folder and go on from there.

    Survives the loss of executors and cuts the lineage. A written table also
    has a known size, by which Spark picks the joins that follow; estimates
    carried on from step to step would grow without bound.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the executors of a session, once."""
    import pathlib
    import zipfile

    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = pathlib.Path(__file__).resolve().parent
    target = pathlib.Path(tempfile.mkdtemp(prefix="corpusloom-src-")) / "corpusloom.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, source.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


# Inputs up to this size may sit in very few row groups.
SMALL_INPUT_BYTES = 512 << 20
# Least input per task when a small input is spread.
SPREAD_BYTES = 128 << 10


def spread(df):
    """Spread a small input over all cores in front of heavy per-row work.

    A small file is often one row group and so one task, however many cores
    wait. Larger inputs have enough splits of their own and are left alone:
    at scale this adds no shuffle.
    """
    if df.isStreaming:
        return df
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    try:
        size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    except ValueError:  # an estimate of thousands of digits: not known, so not small
        return df
    tasks = min(df.sparkSession.sparkContext.defaultParallelism, size // SPREAD_BYTES + 1)
    return df.repartition(tasks) if size <= SMALL_INPUT_BYTES and tasks > 1 else df
