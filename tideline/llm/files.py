"""Files of our own in the shared folder, written and read by tasks."""

from __future__ import annotations

import uuid

from pyarrow import fs as pafs


def place(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if uri.startswith("/"):
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


class Finished:
    """A file that appears under its name only when it is complete: a task that is
    repeated, or runs twice at a time, leaves one whole file."""

    def __init__(self, folder: str, name: str):
        self.fs, self.folder = place(folder)
        self.final = f"{self.folder}/{name}"
        self.draft = f"{self.folder}/.{name}-{uuid.uuid4().hex}"

    def __enter__(self):
        self.fs.create_dir(self.folder, recursive=True)
        self.stream = self.fs.open_output_stream(self.draft)
        return self.stream

    def __exit__(self, kind, error, trace):
        self.stream.close()
        if kind is not None:
            self.fs.delete_file(self.draft)
            return
        if not isinstance(self.fs, pafs.LocalFileSystem) and self.fs.get_file_info(self.final).type != pafs.FileType.NotFound:
            self.fs.delete_file(self.final)
        self.fs.move(self.draft, self.final)
