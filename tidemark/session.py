"""Session settings, and the shared scratch folder that jobs write intermediate tables to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_DELETED: set[str] = set()


def local_session(cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benches on one machine."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tidemark")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_path(spark: SparkSession) -> str:
    """A fresh path that every executor can reach.

    It lies in ``spark.checkpoint.dir``. Where that is unset, a local session (one JVM) gets a temporary folder of its machine
    and a cluster gets a folder of its warehouse, which is shared too. All paths of an application lie in one folder, which is
    deleted when its driver ends, as results are read from there until then.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            app = spark.sparkContext.applicationId
            base = _LOCAL.setdefault(app, _LOCAL.get(app) or tempfile.mkdtemp(prefix="spark-"))
        else:
            base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    app = f"{base.rstrip('/')}/scratch-{spark.sparkContext.applicationId}"
    if app not in _DELETED:
        _DELETED.add(app)
        path = spark._jvm.org.apache.hadoop.fs.Path(app)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return f"{app}/{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared scratch folder and reads it back, which cuts its lineage.

    The copy survives lost executors, which a cache or a local checkpoint does not.
    """
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
