"""Byte access to files from tasks and the driver: local paths and every store that pyarrow reads by its URI."""

from __future__ import annotations

from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def size_of(path: str) -> int:
    store, own = opened(path)
    info = store.get_file_info(own)
    if info.type != fs.FileType.File:
        raise FileNotFoundError(path)
    return info.size


def read_range(path: str, start: int, end: int) -> bytes:
    """Bytes [start, end) of a file; past its end there is what there is."""
    store, own = opened(path)
    with store.open_input_file(own) as f:
        f.seek(start)
        return f.read(max(0, end - start))


def read_all(path: str) -> bytes:
    return read_range(path, 0, size_of(path))


def exists(path: str) -> bool:
    store, own = opened(path)
    return store.get_file_info(own).type == fs.FileType.File
