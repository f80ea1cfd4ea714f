"""Files that the library reads and writes itself, under the URIs that Spark uses: local, HDFS and object stores."""

from __future__ import annotations

import re

import pyarrow.fs

# Spark's scheme, and the one that the file library knows.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}


def open_fs(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path, and the path there; a plain path is local."""
    scheme, mark, rest = uri.partition("://")
    if not mark:
        if re.match(r"[a-z][a-z0-9+.-]*:/", uri):  # file:/tmp, as Hadoop writes it
            scheme, _, rest = uri.partition(":")
        else:
            return pyarrow.fs.LocalFileSystem(), uri
    return pyarrow.fs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}://{rest}")


def size_of(uri: str) -> int:
    files, path = open_fs(uri)
    info = files.get_file_info(path)
    if info.type != pyarrow.fs.FileType.File:
        raise FileNotFoundError(uri)
    return info.size


def read_bytes(uri: str, start: int = 0, count: int | None = None) -> bytes:
    files, path = open_fs(uri)
    with files.open_input_file(path) as f:
        f.seek(start)
        return f.read(count) if count is not None else f.read()


def write_bytes(uri: str, *parts: bytes) -> None:
    files, path = open_fs(uri)
    with files.open_output_stream(path, compression=None) as f:
        for p in parts:
            f.write(p)


def put_in_place(files: pyarrow.fs.FileSystem, temporary: str, path: str) -> None:
    """Move a finished file to its name; one that an earlier run of the task left there goes."""
    try:
        files.move(temporary, path)
    except OSError:  # some stores don't move onto a file that is there
        if files.get_file_info(path).type == pyarrow.fs.FileType.NotFound:
            raise
        files.delete_file(path)
        files.move(temporary, path)
