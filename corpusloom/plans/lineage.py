"""Cutting lineage by tables written to the cluster's shared checkpoint folder.

Iterative operators write each round as parquet below ``spark.checkpoint.dir``
and read it back: compressed, columnar, and still there when an executor is
lost.  The folder is read from the session; only a local session without the
setting gets a temporary one.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

KEY = "spark.checkpoint.dir"
_written: dict[str, SparkSession] = {}
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder; a temporary one only for an unset local master."""
    at = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY)
    if at:
        return at.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"{KEY} must name a folder that all executors share")
        _own[app] = tempfile.mkdtemp(prefix="corpusloom-")
        atexit.register(shutil.rmtree, _own[app], True)
    return f"file://{_own[app]}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, deleted when the session's program ends."""
    path = f"{shared_dir(spark)}/corpusloom/{name}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df to the shared folder and return the written table."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._corpusloom_path = path
    return out


def counted(df: DataFrame, name: str = "t") -> tuple[DataFrame, int]:
    """materialize(df) and its number of rows, which the write itself counts."""
    seen = Observation()
    out = materialize(df.observe(seen, F.count(F.lit(1)).alias("rows")), name)
    return out, seen.get["rows"]


def release(*tables: DataFrame | None) -> None:
    """Delete tables of materialize() that nothing will read again."""
    for t in tables:
        path = getattr(t, "_corpusloom_path", None)
        if path and _written.pop(path, None) is not None:
            _delete(t.sparkSession, path)


@atexit.register
def _sweep() -> None:
    for path, spark in list(_written.items()):
        try:
            _delete(spark, path)
        except Exception:  # the session is already gone
            pass
        _written.pop(path, None)
