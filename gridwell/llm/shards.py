"""Files that executors write to and read from the shared folder.

They go through pyarrow's file systems, so the folder may be a local one that
all machines mount or any store that pyarrow knows (HDFS, S3, GCS, ...).
"""

from __future__ import annotations

import uuid

from pyarrow import fs


class Folder:
    def __init__(self, uri: str):
        self.uri = uri.rstrip("/")

    def _at(self, name: str) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(f"{self.uri}/{name}")

    def make(self) -> None:
        system, path = fs.FileSystem.from_uri(self.uri)
        system.create_dir(path, recursive=True)

    def new_name(self, partition: int, suffix: str) -> str:
        """Unlike any other attempt's: a task that runs again leaves the files
        alone to which another attempt's rows may point."""
        return f"{partition:06d}-{uuid.uuid4().hex}{suffix}"

    def create(self, name: str):
        system, path = self._at(name)
        return system.open_output_stream(path)

    def open(self, name: str):
        system, path = self._at(name)
        return system.open_input_file(path)
