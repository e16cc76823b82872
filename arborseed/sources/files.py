"""Files as the sources' partitions read them: any store that pyarrow's file systems reach, in byte ranges."""

from __future__ import annotations

import fnmatch
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import InputPartition


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """(file system, path on it) of a URI or a plain path."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def listed(path: str, ending: str = "") -> list[tuple[str, int]]:
    """(path, bytes) of a file, of those in a folder, or of those whose name fits a pattern; hidden ones are left out, in order of name."""
    fs, at = opened(path)
    scheme = path[: len(path) - len(at)] if path.endswith(at) else ""
    folder, _, name = at.rpartition("/")
    if any(c in name for c in "*?["):
        found = [x for x in fs.get_file_info(pafs.FileSelector(folder)) if fnmatch.fnmatch(x.base_name, name)]
    else:
        info = fs.get_file_info(at)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = fs.get_file_info(pafs.FileSelector(at)) if info.type == pafs.FileType.Directory else [info]
    return sorted((scheme + x.path, x.size) for x in found if x.type == pafs.FileType.File and x.base_name[0] not in "._" and x.base_name.endswith(ending))


@dataclass
class Split(InputPartition):
    """Bytes begin to end of a file; whole: it can't be cut."""

    path: str
    begin: int
    end: int
    whole: bool = False


def splits(files: list[tuple[str, int]], size: int, whole=lambda path: False) -> list[Split]:
    out = []
    for path, total in files:
        if whole(path):
            out.append(Split(path, 0, total, True))
        else:
            out += [Split(path, a, min(total, a + size)) for a in range(0, total, size)]
    return out


def taken(data: np.ndarray, begin: np.ndarray, end: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """The byte ranges of data as a column of strings, copied once."""
    size = np.maximum(0, end - begin)
    off = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=off[1:])
    at = np.arange(off[-1]) + np.repeat(begin - off[:-1], size)
    column = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data[at])))
    return column.cast(kind or pa.string())
