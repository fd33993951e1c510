"""Files in the shared folder, written by tasks."""

from __future__ import annotations

import contextlib
import uuid

import pyarrow.fs as pafs


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI; Hadoop writes local ones with a single slash."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return pafs.FileSystem.from_uri(uri)


def make_dir(uri: str) -> None:
    fs, path = filesystem(uri)
    fs.create_dir(path, recursive=True)


@contextlib.contextmanager
def whole_file(uri: str):
    """A file that appears under its name only when complete: a task that is run twice leaves one whole file."""
    fs, path = filesystem(uri)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part, compression=None) as out:
        yield out
    fs.move(part, path)
