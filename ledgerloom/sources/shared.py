"""Files that the driver and all tasks see: where scratch tables go, and whole files put in place in one step."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterable

from pyarrow import fs as pafs
from pyspark.sql import SparkSession

from ledgerloom.shipping import ship

ship(__name__)

#: Folder of files that are not whole yet. Spark's readers pass over names that begin so.
STAGING = "_staging"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the folder that driver and executors share (``spark.checkpoint.dir``); in local mode a temporary one if none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="ledgerloom-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def opened(root: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder and its path there; tasks use it too. A path without a scheme is local."""
    return pafs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else os.path.abspath(root))


def put_in_place(fs: pafs.FileSystem, moves: Iterable[tuple[str, str]]) -> None:
    """Move whole files to their names, over what is there."""
    for old, new in moves:
        fs.create_dir(new.rpartition("/")[0], recursive=True)
        fs.move(old, new)
