"""Files of the shared folder, from driver and executors alike."""

from __future__ import annotations

from contextlib import contextmanager

import pyarrow.fs as pafs


def resolve(uri: str) -> tuple[pafs.FileSystem, str]:
    """file:, hdfs:, s3:, gs: or a plain path."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return (pafs.LocalFileSystem(), uri) if uri.startswith("/") else pafs.FileSystem.from_uri(uri)


@contextmanager
def opened(uri: str, mode: str = "r"):
    """For reading at any place, or for writing: the file appears under its name when it is complete."""
    fs, path = resolve(uri)
    if mode == "r":
        with fs.open_input_file(path) as f:
            yield f
        return
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(f"{path}.part") as f:
        yield f
    fs.move(f"{path}.part", path)
