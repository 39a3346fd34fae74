"""Session helpers: shared storage for cut lineage, and shipping the package to Python workers."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)
#: Spark fills an Arrow batch for a Python worker up to so many bytes; the JVM and the worker hold whole batches, several at once.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_OWNED: set[str] = set()
#: Folders that the innermost :func:`scratch` releases when it ends.
_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import the package from where the driver did (clusters use --py-files or an image), and bound
    the session's Arrow batches by bytes: 10,000 rows, Spark's other bound, are as large as their texts.  A smaller bound stays."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    bound = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH, "1g"))
    if not 0 < bound <= BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    return spark


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores at its end as it takes to differ from those that are taken."""
    out, low = [], {c.lower() for c in taken}
    for name in wanted:
        while name.lower() in low:
            name += "_"
        low.add(name.lower())
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a local one where it is unset (tests)."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isDefined():
        return context.getCheckpointDir().get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="seqloom-"))
    return context.getCheckpointDir().get().rstrip("/")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in any store that Spark reads."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def materialize(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts lineage and survives the loss of any executor.

    The folder goes when the driver ends, or earlier by :func:`release`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/seqloom/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _OWNED:
        atexit.register(_release_all, spark)
    _OWNED.add(path)
    if (held := _SCRATCH.get()) is not None:
        held.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._seqloom_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete what :func:`materialize` wrote for this frame; nothing may read it afterwards."""
    if (path := getattr(df, "_seqloom_path", None)) in _OWNED:
        _OWNED.discard(path)
        _delete(df.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator:
    """Tables that are written inside go when the block ends; what it yields writes a frame that stays."""
    outer = _SCRATCH.get()
    mine: list[str] = []
    token = _SCRATCH.set(mine)

    def keep(df: DataFrame) -> DataFrame:
        out = materialize(df)
        mine.remove(out._seqloom_path)
        if outer is not None:
            outer.append(out._seqloom_path)
        return out

    try:
        yield keep
    finally:
        _SCRATCH.reset(token)
        for path in mine:
            if path in _OWNED:
                _OWNED.discard(path)
                _delete(spark, path)


def _release_all(spark: SparkSession) -> None:
    for path in list(_OWNED):
        try:
            _delete(spark, path)
        except Exception:  # the session has ended before the interpreter
            return
        _OWNED.discard(path)
