"""The shared folder of the cluster: where stages are cut and operators put their files.

Every path comes from ``spark.checkpoint.dir``.  Only a local session that leaves it unset (tests) falls back to a folder
of this machine; any other is refused.  Tables that nothing reads any more go when their ``scratch`` ends.
"""

from __future__ import annotations

import threading
import uuid
from weakref import WeakKeyDictionary

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

LOCAL_FALLBACK = "file:///tmp/checkpoints/flowmill"
_open = threading.local()
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (root or LOCAL_FALLBACK).rstrip("/")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared root; nothing is created."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a lost executor costs a reread."""
    path = shared_dir(df.sparkSession, name)
    if scopes := getattr(_open, "scopes", []):
        scopes[-1].mine.append(path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


class scratch:
    """Tables that ``materialize`` writes within this scope are deleted at its end; those of ``keep`` pass to the scope
    around it, or stay where there is none."""

    def __init__(self, spark: SparkSession):
        self.spark, self.mine, self.kept = spark, [], set()

    def __enter__(self) -> scratch:
        _open.scopes = [*getattr(_open, "scopes", []), self]
        return self

    def keep(self, *tables: DataFrame) -> None:
        self.kept.update(_paths[t] for t in tables)

    def __exit__(self, kind, *_) -> None:
        _open.scopes = _open.scopes[:-1]
        for path in self.mine:
            if kind is None and path in self.kept:
                if _open.scopes:
                    _open.scopes[-1].mine.append(path)
            else:
                delete(self.spark, path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(table: DataFrame) -> None:
    """Delete a table of ``materialize`` that nothing reads any more."""
    delete(table.sparkSession, _paths[table])


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI or a plain path, for code that runs in Python workers."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)
