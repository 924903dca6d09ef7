"""Session set-up: the settings the engine expects, and the package on the executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
#: Rows of an Arrow batch, where the session has Spark's default: texts are kilobytes, and a batch of
#: the default's 10000 is held several times over, by the JVM and by each Python worker.
BATCH_KEY, BATCH_DEFAULT, BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000"


def session(name: str = "tarnflow", **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution; a cluster's own settings win where they are given."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once an application, so that their Python workers can import it; set the batch size."""
    if spark.conf.get(BATCH_KEY, BATCH_DEFAULT) == BATCH_DEFAULT:
        spark.conf.set(BATCH_KEY, BATCH)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="tarnflow-ship-")) / "tarnflow.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, Path(root.name) / f.relative_to(root))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``.  Where it is unset, a temporary folder in local mode; elsewhere executors could not read it, and this raises."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tarnflow-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def write_through(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written as Parquet in the folder that driver and executors share, and read back.

    It cuts the lineage: what was computed survives the loss of any executor and is computed once, however many
    branches read it.  The files belong to the shared folder's retention policy.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
