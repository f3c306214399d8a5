"""Files that tasks write and other tasks map or read, in the folder that ``spark.checkpoint.dir`` names."""

from __future__ import annotations

import os
import uuid
from urllib.parse import urlparse

from pyspark.sql import SparkSession

from hirecube.session import scratch_path


def mounted(path: str) -> str:
    """The path as an ordinary file name.

    Executors open these files themselves, so the shared folder must be a
    mounted file system (a plain path or ``file:``); other stores are refused.
    """
    parsed = urlparse(path)
    if parsed.scheme not in ("", "file"):
        raise ValueError(f"{path}: token files and model arrays need a mounted shared folder in spark.checkpoint.dir")
    return parsed.path


def folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared one; each writing task makes it where it isn't there yet."""
    return mounted(scratch_path(spark, name))


def publish(path: str, write) -> None:
    """Write under a private name, then rename: a repeated or lost attempt leaves no half file."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    own = f"{path}.{uuid.uuid4().hex}"
    with open(own, "wb") as out:
        write(out)
        out.flush()
        os.fsync(out.fileno())
    os.replace(own, path)
