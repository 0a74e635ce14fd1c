"""Advisory locks: a file in a shared folder that only one holder can make."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from .tables import hadoop_path


class Locked(RuntimeError):
    """Someone else holds the lock."""


@contextmanager
def lock(spark: SparkSession, folder: str, name: str, stale_seconds: float | None = None) -> Iterator[str]:
    """Holds the lock of that name for the block, or raises Locked at once; gives the holder's mark.

    The file system makes a file only if there is none, in one step; object stores that cannot are no place for it. A
    lock older than stale_seconds is taken to be left behind, and is broken.
    """
    path, system = hadoop_path(spark, f"{folder.rstrip('/')}/{uuid.uuid5(uuid.NAMESPACE_OID, name).hex}.lock")
    if stale_seconds is not None and system.exists(path) and time.time() - system.getFileStatus(path).getModificationTime() / 1000 > stale_seconds:
        system.delete(path, False)
    if not system.createNewFile(path):
        raise Locked(name)
    try:
        yield path.toString()
    finally:
        system.delete(path, False)
