"""Files in the shared folder, read and written inside tasks through pyarrow."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyarrow import fs


def opened(uri: str):
    """(filesystem, path) of an absolute path or URI that pyarrow knows: file, hdfs, s3, gs, abfs."""
    return fs.FileSystem.from_uri(uri)


def new_name(kind: str) -> str:
    """A name no other attempt of a task uses; only names that a finished task returns are ever read."""
    return f"{kind}-{uuid.uuid4().hex}"


def mapped(uri: str):
    """A random-access file: memory-mapped where the shared folder is mounted."""
    where, path = opened(uri)
    if isinstance(where, fs.LocalFileSystem):
        return pa.memory_map(path)
    return where.open_input_file(path)
