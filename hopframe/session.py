"""Session helpers shared by the entry point, the tests and the benchmark."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh directory name under the folder all executors can reach.

    The cluster names that folder in ``spark.checkpoint.dir``.  Only a session
    whose executors are threads of this machine may go without; elsewhere a
    missing setting is an error, since a local folder would not be shared.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="hopframe-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def materialized(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table to the shared folder and read it again, so that later plans do not repeat its work."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_helpers() -> None:
    """Send the small Arrow helpers with each task instead of importing them.

    Python workers then need no copy of this package on their path.
    """
    from pyspark import cloudpickle

    from hopframe.functions import sequence, stemming, tokens
    from hopframe.operators import analysis, ranks

    for module in (sequence, stemming, tokens, ranks, analysis):
        cloudpickle.register_pickle_by_value(module)


def local_session(cores: str | int = 8, memory: str = "16g") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("hopframe")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def complete_folders(spark: SparkSession, root: str, kind: str) -> list[int]:
    """Numbers of the folders ``<root>/<kind>=<number>`` whose write ended."""
    jvm = spark._jvm
    home = jvm.org.apache.hadoop.fs.Path(root)
    files = home.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not files.exists(home):
        return []
    names = [s.getPath().getName() for s in files.listStatus(home)]
    whole = [n for n in names if n.startswith(f"{kind}=") and files.exists(jvm.org.apache.hadoop.fs.Path(f"{root}/{n}/_SUCCESS"))]
    return sorted(int(n.split("=")[1]) for n in whole)
