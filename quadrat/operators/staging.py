"""Materialisation helpers: tables written once in the shared folder.

Catalyst chooses a broadcast join only when it knows that a side is small. A side that was
aggregated out of a large table carries the large table's size estimate, so the join would shuffle
the large side. A written table has the size of its files, and Catalyst decides by
``spark.sql.autoBroadcastJoinThreshold``. No operator forces a broadcast, and no table passes through the driver.
"""

from __future__ import annotations

import logging
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

logger = logging.getLogger(__name__)

_local_roots: dict[str, str] = {}


@dataclass
class Scope:
    """Folders and catalog tables written since the scope was entered."""

    folders: list[str] = field(default_factory=list)
    tables: list[str] = field(default_factory=list)


_scopes: list[Scope] = []


@contextmanager
def staging_scope(spark: SparkSession) -> Iterator[Scope]:
    """Everything staged inside is removed at the end, also after a failure.

    Results that are still needed must be written or collected inside, as DataFrames read the removed tables. Scopes nest; each removes its
    own. Folders are deleted through Spark's file system of their scheme; one that cannot be deleted is logged and left.
    """
    scope = Scope()
    _scopes.append(scope)
    try:
        yield scope
    finally:
        _scopes.remove(scope)
        for name in scope.tables:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        for folder in scope.folders:
            remove_folder(spark, folder)


def remove_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    try:
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001 - the work is done; a folder that stays must not undo it
        logger.warning("Could not remove %s", folder, exc_info=True)


def staging_root(spark: SparkSession) -> str:
    """Shared folder for written intermediates, taken from ``spark.checkpoint.dir``."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/") + "/quadrat"
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder that every executor can reach.")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _local_roots[app]


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared one; the innermost scope owns it."""
    path = f"{staging_root(spark)}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].folders.append(path)
    return path


def own_table(spark: SparkSession, name: str) -> None:
    """Have the innermost scope drop a catalog table."""
    if _scopes:
        _scopes[-1].tables.append(name)


def stage(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once and continue from the written table; survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pin(df: DataFrame) -> DataFrame:
    """Evaluate a table that is read several times or joined as a side of unknown size."""
    return stage(df, "pinned")
