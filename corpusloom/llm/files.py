"""Files that executors write and read directly, in the shared folders, by byte ranges."""

from __future__ import annotations

import uuid

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path in it; hdfs, s3 and gs URIs work as file ones do."""
    if "://" not in uri and not uri.startswith("/"):
        uri = f"file://{uri.removeprefix('file:')}"
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = f"file://{uri.removeprefix('file:')}"
    return fs.FileSystem.from_uri(uri)


def new_file(folder: str, suffix: str) -> tuple[fs.FileSystem, str, str]:
    """(file system, path, URI) of a new file; each attempt of a task has its own, so a repeated task harms none."""
    uri = f"{folder.rstrip('/')}/{uuid.uuid4().hex}{suffix}"
    system, path = opened(uri)
    return system, path, uri
