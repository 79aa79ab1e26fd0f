"""Session settings, table access and lineage cuts shared by every operator."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A relation may be broadcast once it was measured and has at most this many rows and characters.
BROADCAST_ROWS = 200_000
BROADCAST_CHARS = 20_000_000


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(master)
        .appName("anchorline")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Just these columns, also if df has others of the same name or one that differs in letter case only; of equal names the first counts."""
    if len({c.lower() for c in df.columns}) < len(df.columns):
        first = {n: df.columns.index(n) for n in names}
        df = df.toDF(*[n if (n := c) in first and first[n] == i else f"__other{i}" for i, c in enumerate(df.columns)])
    return df.select(*names)


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from the files, so that a lost executor costs no recomputation.

    The folder is the one in spark.checkpoint.dir. Only where that is unset (tests on one machine) a temporary one is made.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            shared = os.path.join(tempfile.gettempdir(), f"anchorline-{os.getpid()}")
        sc.setCheckpointDir(shared)
    return df.checkpoint(eager)


def release(df: DataFrame) -> None:
    """Delete what cut wrote for df, which nothing may read any more: iterations keep one state and not one for every round."""
    spark = df.sparkSession
    plan = df._jdf.queryExecution().analyzed()
    file = plan.rdd().getCheckpointFile() if plan.getClass().getSimpleName() == "LogicalRDD" else None
    if file is not None and file.isDefined():
        path = spark._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS, chars: int = BROADCAST_CHARS) -> bool:
    """Whether df, which should be cut or small to compute, has at most so many rows and so many characters; reads no more than it needs to tell."""
    size = F.coalesce(F.sum(F.length(F.struct("*").cast("string")).cast("long")), F.lit(0))
    n, c = df.limit(rows + 1).agg(F.count(F.lit(1)), size).first()
    return n <= rows and c <= chars


def broadcast_if_bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if the rows of df were counted and are few, else df itself, for a shuffle join under AQE."""
    return F.broadcast(df) if bounded(df, rows) else df


def parallelism(spark: SparkSession) -> int:
    """Shuffle partitions asked for by the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
