"""Files in the shared folder from Python: any file system that pyarrow can open by URI (file, hdfs, s3, gs, abfs)."""

from __future__ import annotations

import contextlib
import uuid

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI or an absolute path."""
    return fs.FileSystem.from_uri(uri) if "://" in uri else fs.FileSystem.from_uri("file://" + uri.removeprefix("file:"))


@contextlib.contextmanager
def writing(uri: str):
    """A stream to a file that appears whole at the end: under another name first, so that a retried or doubled task leaves one complete file."""
    where, path = opened(uri)
    where.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with where.open_output_stream(part) as f:
        yield f
    where.move(part, path)


def write_bytes(uri: str, data: bytes) -> None:
    with writing(uri) as f:
        f.write(data)
