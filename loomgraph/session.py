"""Session construction and the shared scratch area.

Iterative operators cut their lineage by writing tables below the folder that
the cluster names in ``spark.checkpoint.dir``. Those files outlive executors, so
a lost executor costs a task retry and never a recomputation from the source.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "loomgraph", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults the operators expect; ``conf`` overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in {**base, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, read from the session.

    Only a local session without the setting gets a folder of its own (tests);
    on a cluster the setting is required.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="loomgraph-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of joins that is never broadcast: for tables that grow with the data."""
    return df.hint("merge")


class Scratch:
    """Tables written during one operator call.

    ``keep(df)`` writes the plan once as Parquet and returns a scan of it along
    with its row count (gathered by the write itself). ``drop`` deletes tables
    that later steps no longer read; what the result depends on stays.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def keep_with(self, df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
        """Write ``df``; besides the scan, return aggregates gathered by the write."""
        self._n += 1
        path = f"{self.root}/{self._n:04d}"
        seen = Observation()
        rows = F.count(F.lit(1)).alias("n")
        df.observe(seen, rows, *(c.alias(k) for k, c in metrics.items())).write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._loom_path = path
        return out, seen.get

    def keep(self, df: DataFrame) -> tuple[DataFrame, int]:
        out, seen = self.keep_with(df)
        return out, int(seen["n"])

    def drop(self, *tables: DataFrame | None) -> None:
        for table in tables:
            path = getattr(table, "_loom_path", None)
            if path:
                _delete(self.spark, path)

    def release(self) -> None:
        """Let Spark free the shuffle files of plans that nothing refers to."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate; 0 where it knows none (its default is near 2**63)."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0
