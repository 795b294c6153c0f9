"""Files of a shared store by path, for what Spark's own readers can't cut or list: byte ranges and archive members."""

from __future__ import annotations

import re

from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system that a path or URI names (local, hdfs, s3, gs), and the path within it."""
    if re.match(r"^file:/", path):
        path = re.sub(r"^file:/+", "/", path)
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files below a path, or of the file itself, in order; hidden ones are left out, as Spark does."""
    store, within = opened(path)
    info = store.get_file_info(within)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(within, recursive=True))
    return sorted((x.path, x.size) for x in found if x.type == fs.FileType.File and x.base_name[0] not in "._" and x.size)
