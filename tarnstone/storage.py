"""Reading tables and cutting lineage.

``cut`` writes a frame as Parquet below the cluster's shared folder (``spark.checkpoint.dir``) and reads it back, so
that a lost executor never forces an iterative job to replay all its earlier rounds. Only where the session names no
such folder and runs on this machine alone (unit tests) a folder of this process is used and set; on a cluster that is
an error, for each executor would write to its own disk and rows would be lost without a word.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
_MADE: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder; column pruning and filters reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tables_in(spark: SparkSession, sf_dir: str) -> list[str]:
    """The names of the Parquet tables of a folder of any file system."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/*.parquet")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(f.getPath().getName().removesuffix(".parquet") for f in found)


def open_store(spark: SparkSession, sf_dir: str, prefix: str = "") -> dict[str, DataFrame]:
    """The tables of a folder by name, each also a temporary view (``prefix`` keeps stores apart)."""
    store = {name: table(spark, sf_dir, name) for name in tables_in(spark, sf_dir)}
    for name, df in store.items():
        df.createOrReplaceTempView(prefix + name)
    return store


def probe(spark: SparkSession, sf_dir: str, names: list[str]) -> dict[str, bool]:
    """Which of the tables a folder has; nothing is opened or made."""
    known = set(tables_in(spark, sf_dir))
    return {n: n in known for n in names}


def repo_store(chunks: DataFrame, repo_id: int) -> DataFrame:
    """The rows of one repository; the filter reaches the scan."""
    return chunks.where(F.col("repo_id") == repo_id)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        folder = tempfile.mkdtemp(prefix="tarnstone-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _OWN[app] = f"file://{folder}"
        spark.sparkContext.setCheckpointDir(_OWN[app])
    return _OWN[app]


def cut(df: DataFrame, tag: str = "step") -> DataFrame:
    """``df`` written once to the shared folder and read back: its plan is then a plain scan."""
    spark = df.sparkSession
    path = folder(spark, tag)
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tarnstone_path = path  # type: ignore[attr-defined]
    return out


def folder(spark: SparkSession, tag: str) -> str:
    """A folder of its own in the shared one, removed at the end of the program."""
    path = f"{shared_dir(spark)}/tarnstone-{tag}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def drop(df: DataFrame) -> None:
    """Remove the files of a frame made by ``cut`` that nothing reads any more."""
    path = getattr(df, "_tarnstone_path", None)
    if path:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _tidy() -> None:
    """At the end of the program the tables it cut are removed from the shared folder; none outlives it for long."""
    from pyspark import SparkContext

    gateway = SparkContext._gateway
    for path in _MADE:
        try:
            if path.startswith(("file:", "/")):
                shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)
            elif gateway is not None:
                p = gateway.jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(gateway.jvm.org.apache.hadoop.conf.Configuration()).delete(p, True)
        except Exception:  # noqa: BLE001 - the JVM may be gone; what is left is named after this package
            return


atexit.register(_tidy)
