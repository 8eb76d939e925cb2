"""Session construction, the shared scratch folder and size-checked broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only while Catalyst's size estimate stays at or under this many bytes.
BROADCAST_BYTES = 32 << 20


def build_session(cores: str = "*", shuffle_partitions: int = 8, driver_memory: str = "4g", app: str = "seqloom") -> SparkSession:
    """A local session with UTC time, AQE and skew handling, for tests and the bench."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in ``spark.checkpoint.dir``.

    A local session that leaves it unset gets a temporary folder; on a cluster it must be set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if spark.sparkContext.applicationId not in _local:
        _local[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="seqloom-")
    return _local[spark.sparkContext.applicationId]


_scratch: set[str] = set()


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder; it is removed when the driver ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex[:12]}"
    if not _scratch:
        atexit.register(_drop_all, spark)
    _scratch.add(path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hpath, True)
    _scratch.discard(path)


def _drop_all(spark: SparkSession) -> None:
    for path in list(_scratch):
        try:
            drop_path(spark, path)
        except Exception:  # the session may be gone already
            return


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lineage cut that survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop_table(df: DataFrame) -> None:
    """Remove what :func:`materialise` wrote, once nothing reads it any more."""
    drop_path(df.sparkSession, df._scratch)


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the optimised plan (for a scan: the bytes of its files)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def source_bytes(df: DataFrame) -> int:
    """Catalyst's size estimates of all that ``df`` reads, added up.

    :func:`estimated_bytes` multiplies the sides of a join unless it knows the keys of one to be
    distinct.  A cached frame counts as what it was made from, an RDD as unknown (2 ** 63): of one that
    is a checkpoint Catalyst repeats what it said of the plan.
    """
    size, plans = 0, [df._jdf.queryExecution().optimizedPlan()]
    while plans:
        leaves = plans.pop().collectLeaves()
        for leaf in (leaves.apply(i) for i in range(leaves.size())):
            kind = leaf.getClass().getSimpleName()
            if kind == "InMemoryRelation":
                plans.append(leaf.cacheBuilder().logicalPlan())
            else:
                size += 1 << 63 if kind == "LogicalRDD" else int(str(leaf.stats().sizeInBytes()))
    return size


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast when the estimate is within ``limit``; beyond it Spark joins by shuffle."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df
