"""Binary files in the shared folder, written and read by tasks.

Paths are URIs (``file:``, ``hdfs:``, ``s3:``, ``gs:``) that pyarrow opens on
any executor.  A file is written under a name of the attempt's own and then
moved to its final name, so a task that is run again replaces its file and a
lost one leaves none under that name.
"""

from __future__ import annotations

import uuid

from pyarrow import fs


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri)


def put(uri: str, data: bytes | memoryview) -> None:
    where, path = open_fs(uri)
    folder = path.rpartition("/")[0]
    where.create_dir(folder, recursive=True)
    draft = f"{folder}/.draft-{uuid.uuid4().hex}"
    with where.open_output_stream(draft) as out:
        out.write(data)
    where.move(draft, path)


def opened(uri: str):
    """A random-access file."""
    where, path = open_fs(uri)
    return where.open_input_file(path)
