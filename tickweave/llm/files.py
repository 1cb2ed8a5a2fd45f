"""Files that executors write to and read from the shared folder, by URI: local, HDFS or object store."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark import TaskContext


def attempt_name(folder: str, suffix: str) -> str:
    """A file name of this task attempt alone: a repeated or speculative task never touches another's file. Only files
    whose names a finished task has returned are read."""
    context = TaskContext.get()
    return f"{folder}/part-{context.partitionId():06d}-{context.taskAttemptId()}{suffix}"


@contextlib.contextmanager
def writer(uri: str) -> Iterator:
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_output_stream(path, buffer_size=1 << 20) as out:
        yield out


@contextlib.contextmanager
def reader(uri: str) -> Iterator:
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    with system.open_input_stream(path, buffer_size=1 << 20) as source:
        yield source
