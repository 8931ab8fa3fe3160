"""Session settings that every query of this library expects."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "glintfield", master: str | None = None, **extra: str) -> SparkSession:
    """A session with SETTINGS; `extra` names use double underscores for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the driver's tables, as a DataFrame over its Parquet files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Temporary folders of sessions that run on one machine and name no shared one, by application.
_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines of the session see: spark.checkpoint.dir, or the context's checkpoint folder.

    Only a session on one machine (master local) may leave both unset; it gets a temporary folder.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", "") or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="glint-shared-")
    return _LOCAL[context.applicationId]


def settled(df: DataFrame) -> DataFrame:
    """The same rows from Parquet files in the shared folder: lineage is cut, columns still prune, lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes the files of settled tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        root = shared_folder(spark)
        for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            if f"/{spark.sparkContext.applicationId}-" in folder and root.rsplit("/", 1)[-1] in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
