"""Byte ranges of files, for readers of formats that Spark can't split by itself."""

from __future__ import annotations

import re

from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if re.match(r"[a-z0-9]+:", path):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return fs.LocalFileSystem(), path


def files_of(path: str, suffix: str = "") -> list[tuple[str, int]]:
    """Path and size of a file, or of a folder's files that end in ``suffix``, by name; hidden ones are left out."""
    system, at = opened(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else [x for x in system.get_file_info(fs.FileSelector(at)) if x.type == fs.FileType.File and x.base_name.endswith(suffix) and x.base_name[0] not in "._"]
    whole = (lambda p: path) if info.type == fs.FileType.File else (lambda p: f"{path.rstrip('/')}/{p.rsplit('/', 1)[-1]}")
    return sorted((whole(x.path), x.size) for x in found)


class Bytes:
    """Reads of one file by position."""

    def __init__(self, path: str):
        self.path = path
        system, at = opened(path)
        self.file = system.open_input_file(at)
        self.size = self.file.size()

    def read(self, begin: int, end: int) -> bytes:
        begin, end = max(0, begin), min(end, self.size)
        if begin >= end:
            return b""
        self.file.seek(begin)
        return self.file.read(end - begin)
