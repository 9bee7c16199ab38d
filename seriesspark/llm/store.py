"""Files in the shared folder, for tasks that write their own formats.

Paths are URIs; ``pyarrow.fs`` opens local, HDFS and object stores alike. A file
is written under a temporary name and renamed when whole, so a reader never
meets a part of one, and a task that is run again writes a new file.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyarrow import fs


def _resolve(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


class Reader:
    """Range reads of one file."""

    def __init__(self, uri: str):
        where, path = _resolve(uri)
        self.file = where.open_input_file(path)
        self.size = self.file.size()

    def read_at(self, offset: int, length: int) -> bytes:
        return bytes(self.file.read_at(length, offset)) if length > 0 else b""

    def __enter__(self) -> Reader:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()


class Store:
    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")

    def make_folder(self) -> None:
        where, path = _resolve(self.folder)
        where.create_dir(path, recursive=True)

    def write(self, name: str, parts: Iterable[bytes]) -> str:
        """Write a file and return its URI."""
        where, path = _resolve(f"{self.folder}/{name}")
        temporary = f"{path}.{uuid.uuid4().hex[:8]}.part"
        with where.open_output_stream(temporary) as out:
            for part in parts:
                out.write(part)
        where.move(temporary, path)
        return f"{self.folder}/{name}"

    @staticmethod
    def reader(uri: str) -> Reader:
        return Reader(uri)
