"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_local_roots: dict[str, str] = {}
_named: ContextVar[list[str] | None] = ContextVar("named", default=None)  # by ``scratch``, inside the innermost ``swept``


def local_session(cpus: int = 8, name: str = "tidemark", **conf: str) -> SparkSession:
    """A session for tests and the benchmark; on a cluster the caller brings a session."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="tidemark-wh-"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder every executor reaches, named by ``spark.checkpoint.dir``.

    Only a local session may go without it; there a folder is made once per application.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    if sc.applicationId not in _local_roots:
        _local_roots[sc.applicationId] = tempfile.mkdtemp(prefix="tidemark-")
    return _local_roots[sc.applicationId]


def scratch(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    if (named := _named.get()) is not None:
        named.append(path)
    return path


@contextmanager
def swept(spark: SparkSession):
    """Folders that ``scratch`` names inside are deleted at the end, but for those of the frames that were given to what this yields.

    For a step whose result is stored and whose inner rounds nobody reads again. Other threads' folders stay.
    """
    named: list[str] = []
    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.extend(df.inputFiles())
        return df

    token = _named.set(named)
    try:
        yield keep
    finally:
        _named.reset(token)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in named:
            if any(f"/{path.rpartition('/')[2]}/" in f for f in kept):
                if (outer := _named.get()) is not None:
                    outer.append(path)
                continue
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: keeps partitions and row order, and survives lost executors."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write as parquet in the shared folder and read back.

    Cuts the plan in loops, and gives the next plan true sizes for its join choice.
    """
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A session setting for the jobs run inside, put back afterwards."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def small_batches(spark: SparkSession):
    """For jobs inside that send whole texts to Python: batches of 8 MB, as each of 64 MB is held several times by both sides."""
    return setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", "8m")


@contextmanager
def shuffled_joins(spark: SparkSession):
    """For loops: joins inside shuffle both sides, as a broadcast in every round adds up on the driver."""
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"), setting(spark, "spark.sql.adaptive.autoBroadcastJoinThreshold", "-1"):
        yield


def rounds(limit: int | None = None) -> Iterator[int]:
    """0, 1, 2, ... for loops that end by themselves; a caller's limit that is reached before that raises."""
    n = 0
    while limit is None or n < limit:
        yield n
        n += 1
    raise RuntimeError(f"the loop isn't done after {limit} rounds")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
