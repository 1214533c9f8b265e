"""Files that executors write to, and read from, the shared folder.

Paths are URIs of any store that the cluster's workers reach through Arrow's file systems (a plain or
``file:`` path, ``hdfs:``, ``s3:``, ``gs:``). A file appears under its name only when it is whole: it is
written under a name of this attempt and then moved, so a task that runs again leaves the same file.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


@contextmanager
def whole_file(uri: str):
    """A binary output stream; the file gets its name when the block ends well."""
    store, path = store_of(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    own = f"{path}.{uuid.uuid4().hex}.part"
    try:
        with store.open_output_stream(own, compression=None) as out:
            yield out
    except BaseException:
        store.delete_file(own)
        raise
    store.move(own, path)


def opened(uri: str):
    """A seekable binary input file."""
    store, path = store_of(uri)
    return store.open_input_file(path)


def remove(uri: str) -> None:
    store, path = store_of(uri)
    store.delete_file(path)
