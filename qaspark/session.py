"""Session set-up and the shared scratch folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("qaspark")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back on a temporary folder: on a cluster a machine-local path would
    be lost with its machine.
    """
    configured = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="qaspark-"))
    return spark.sparkContext.getCheckpointDir()


_MADE: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    _MADE.append(f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}")
    return _MADE[-1]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables made inside are removed at its end: write or collect results before.

    ``with scratch(spark): extract(qa).templates.write.parquet(out)``. Outside of it they are left to the folder's
    own clean-up, as a lazy result may still need them.
    """
    mark = len(_MADE)
    try:
        yield
    finally:
        for path in _MADE[mark:]:
            _delete(spark, path)
        del _MADE[mark:]


def materialize(df: DataFrame, label: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write an intermediate table once, with the writer's options, and go on from the files.

    Lineage ends here, so a lost executor costs a re-read and not a recomputation; later plans see
    real file sizes and may prune columns.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.options(**options or {}).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def release(table: DataFrame) -> None:
    """Remove a table that ``materialize`` made; nothing that is still to be computed may read it."""
    _delete(table.sparkSession, table.scratch_path)
    _MADE.remove(table.scratch_path)


def _delete(spark: SparkSession, path: str) -> None:
    system, where = _file_system(spark, path)
    system.delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything under a path of any store that Spark reads."""
    system, where = _file_system(spark, path)
    return system.exists(where)


def _file_system(spark: SparkSession, path: str) -> tuple:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where
