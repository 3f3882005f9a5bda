"""Tables written between jobs.

A staged table cuts the lineage and lives in the shared folder the cluster
names in `spark.checkpoint.dir`, so losing an executor never loses it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_root: dict[str, str] = {}
_tables: dict[tuple[str, str], DataFrame] = {}


def staging_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that every executor can reach")
    if context.applicationId not in _local_root:
        _local_root[context.applicationId] = tempfile.mkdtemp(prefix="pairlens-")
    return _local_root[context.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    """A folder that does not exist yet, unique per call."""
    app = spark.sparkContext.applicationId
    return f"{staging_root(spark)}/pairlens-{app}/{name}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write `df` once and return a scan of what was written; `codec` zstd takes less room where texts repeat."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for jobs that run inside the block."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder of this application's staging area that nothing will read any more."""
    own = f"{staging_root(spark)}/pairlens-{spark.sparkContext.applicationId}/"
    if not path.startswith(own) or path == own:
        raise ValueError(f"{path} is not a staged table of this application")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def staged_once(spark: SparkSession, key: str, build: Callable[[], DataFrame], staged: bool = False) -> DataFrame:
    """Stage a table shared by several queries of one application; `staged` if `build` does so itself."""
    slot = (spark.sparkContext.applicationId, key)
    if slot not in _tables:
        _tables[slot] = build() if staged else stage(build(), key.rsplit("/", 1)[-1])
    return _tables[slot]
