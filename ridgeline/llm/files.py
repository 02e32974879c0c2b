"""Binary files in the shared folder, written and read by tasks.

The folder is a URI, so the same code serves a mounted folder and any store that Arrow opens
(HDFS, S3, GCS).  A task writes under a name no other attempt uses; which files count is said
by the index that Spark's own writer commits, so files of lost or repeated attempts are never
read.
"""

from __future__ import annotations

import uuid

from pyarrow import fs


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    store, path = fs.FileSystem.from_uri(uri)
    return store, path.rstrip("/")


def attempt_name(part: int, suffix: str) -> str:
    return f"part-{part:06d}-{uuid.uuid4().hex}{suffix}"
