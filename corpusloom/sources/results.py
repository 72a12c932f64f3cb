"""The store of experiment results: one JSON document for each experiment, variant and split."""

from __future__ import annotations

import hashlib
import json
import platform
import subprocess
import time
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_numbers = T.MapType(T.StringType(), T.DoubleType(), True)
SCHEMA = T.StructType(
    [
        T.StructField("experiment", T.StringType()),
        T.StructField("variant", T.StringType()),
        T.StructField("split", T.StringType()),
        T.StructField("config", T.StringType()),
        T.StructField("metrics", _numbers),
        T.StructField("timings", _numbers),
        T.StructField("resources", _numbers),
        T.StructField("n_examples", T.LongType()),
        T.StructField("notes", T.StringType()),
        T.StructField("git_sha", T.StringType()),
        T.StructField("created_at", T.DoubleType()),
        T.StructField("env", T.MapType(T.StringType(), T.StringType())),
    ]
)


def revision() -> str:
    try:
        return subprocess.run(["git", "rev-parse", "--short", "HEAD"], capture_output=True, text=True, timeout=10).stdout.strip() or "unknown"
    except OSError:
        return "unknown"


def config_hash(config: dict) -> str:
    """12 hex digits that equal configurations share, whatever the order of their keys."""
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:12]


@dataclass
class Result:
    experiment: str
    variant: str
    split: str
    config: dict = field(default_factory=dict)
    metrics: dict = field(default_factory=dict)
    timings: dict = field(default_factory=dict)
    resources: dict = field(default_factory=dict)
    n_examples: int = 0
    notes: str = ""
    git_sha: str = field(default_factory=revision)
    created_at: float = field(default_factory=time.time)
    env: dict = field(default_factory=lambda: {"python": platform.python_version(), "platform": platform.platform()})

    def save(self, spark: SparkSession, root: str) -> str:
        """Write root/experiment/variant__split.json, sorted and indented; an older one is replaced."""
        path = f"{root}/{self.experiment}/{self.variant}__{self.split}.json"
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
        out.write(bytearray(json.dumps(asdict(self), indent=2, sort_keys=True).encode()))
        out.close()
        return path


def load_results(spark: SparkSession, root: str, experiment: str | None = None) -> DataFrame:
    """All results below root, or one experiment's, in the order of their paths; none if there is no such folder.  config stays JSON text."""
    path = f"{root}/{experiment}" if experiment else root
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path).orderBy("_metadata.file_path")


def write_report(lines: list[str], spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(("\n".join(lines) + "\n").encode()))
    out.close()
