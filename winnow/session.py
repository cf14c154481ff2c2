"""Session helpers: sane defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", app: str = "winnow") -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set("spark.winnow.testdata.spread", str(spark.sparkContext.defaultParallelism))
    return tune(spark)


def tune(spark: SparkSession) -> SparkSession:
    """Session settings the wide projections here need; safe to call again.

    The JVM never compiles a method above 8,000 bytes, so a generated method that
    large runs interpreted.  With the limit at that size Spark generates many
    small methods instead, which is several times faster on wide rows.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    # split a hot join key even where that costs one more exchange
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    # shuffle files go when their job is done, not when the driver happens to collect its garbage
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    A cluster names it in ``spark.checkpoint.dir``.  Only a local master, where
    all tasks share this machine, may fall back to a temporary folder.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="winnow-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss and stops plan growth in loops."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
