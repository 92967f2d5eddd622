"""Files that tasks write to and read from the shared folder, on any store pyarrow can open."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow.fs as pafs


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


@contextmanager
def written_whole(uri: str) -> Iterator:
    """A stream to ``uri`` whose file appears under that name only when it is complete.

    A task that runs twice, or dies half way, thus leaves either a whole file or none.
    """
    fs, path = opened(uri)
    part = f"{os.path.dirname(path)}/.{os.path.basename(path)}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part, compression=None) as out:
        yield out
    fs.move(part, path)
