"""Files in the shared folder, opened by tasks through Arrow's file systems (local, HDFS, object stores)."""

from __future__ import annotations

import uuid

import pyarrow.fs


def opened(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system and the path of a URI or plain path."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return pyarrow.fs.FileSystem.from_uri(uri)


def task_file(folder: str, suffix: str) -> str:
    """A name for what the running task attempt writes.

    Attempts never share a name: a lost or repeated attempt leaves a file that no index mentions.
    """
    from pyspark import TaskContext

    context = TaskContext.get()
    return f"{folder}/part-{context.partitionId() if context else 0:06d}-{uuid.uuid4().hex[:12]}{suffix}"
