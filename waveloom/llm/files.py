"""Files that tasks write to and read from the shared folder, wherever it is.

Paths are URIs (file, hdfs, s3, gs). Each attempt of a task writes files under new names and returns
those names as rows; only the rows of attempts that succeed are kept, so a lost executor or a
speculative copy leaves unused files and never mixed or missing ones.
"""

from __future__ import annotations

from typing import BinaryIO


def _at(uri: str):
    from pyarrow import fs

    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri[5:])
    return fs.LocalFileSystem(), uri


def open_write(uri: str) -> BinaryIO:
    store, path = _at(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    return store.open_output_stream(path, compression=None)


def open_read(uri: str) -> BinaryIO:
    """A file with seek, tell, read and size()."""
    store, path = _at(uri)
    return store.open_input_file(path)


def delete_folder(uri: str) -> None:
    store, path = _at(uri)
    store.delete_dir(path)
