"""The folder that the driver and all executors share, written tables, and files read by offset or map.

The folder comes from ``spark.checkpoint.dir``; only where that is unset (tests on one machine) a
temporary one is made. Files are written under a name of their own and renamed, so a task that runs
twice leaves the same file. Other than local file systems are reached through pyarrow.fs.

Maps hold no file open (from Python 3.13 on), and a process keeps ``MAPS`` files of arrays mapped at most, whatever the number
of files: systems allow it about 65,000 maps, and often far fewer open files.
"""

from __future__ import annotations

import functools
import mmap
import os
import sys
import tempfile
import uuid
from urllib.parse import urlparse

import numpy as np
from pyspark.sql import DataFrame, SparkSession

MAPS = 16_384
UNTRACKED = {"trackfd": False} if sys.version_info >= (3, 13) else {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """URI of a new folder for ``name`` below the shared folder of this session."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith(("local[", "local*")) and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="homelens-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it: lineage is cut, lost executors cost nothing."""
    path = shared_folder(df.sparkSession, name)
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _split(uri: str):
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if urlparse(uri).scheme == "file":
        return fs.LocalFileSystem(), urlparse(uri).path
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, *parts: bytes | np.ndarray) -> None:
    """Write the parts as one file; it appears whole or not at all."""
    system, path = _split(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as out:
        for part in parts:
            out.write(part if isinstance(part, bytes) else np.ascontiguousarray(part).view(np.uint8).data)
    system.move(draft, path)


def map_array(uri: str, dtype: str) -> np.ndarray:
    """A read-only memory map of a file of numbers; a remote file is copied next to the worker and unlinked."""
    system, path = _split(uri)
    if system.type_name != "local":
        with system.open_input_stream(path) as src, tempfile.NamedTemporaryFile() as out:
            while block := src.read(1 << 24):
                out.write(block)
            out.flush()
            return _mapped(out.name, dtype)
    return _mapped(path, dtype)


def _mapped(path: str, dtype: str) -> np.ndarray:
    if os.path.getsize(path) == 0:
        return np.empty(0, dtype)
    with open(path, "rb") as file:
        return np.frombuffer(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ, **UNTRACKED), dtype)


def write_arrays(uri: str, *arrays: np.ndarray) -> None:
    """Write arrays as one file: their sizes in bytes, then each of them from a multiple of 8 bytes."""
    write_file(uri, np.array([a.nbytes for a in arrays], "<i8"), *(part for a in arrays for part in (a, b"\0" * (-a.nbytes % 8))))


@functools.lru_cache(maxsize=MAPS)
def map_arrays(uri: str, dtypes: tuple[str, ...]) -> list[np.ndarray]:
    """The arrays of a file written by ``write_arrays``, as parts of one memory map. Maps used last are kept for the process."""
    raw, at, out = map_array(uri, "u1"), 8 * len(dtypes), []
    for size, dtype in zip(raw[:at].view("<i8").tolist(), dtypes, strict=True):
        out.append(raw[at : at + size].view(dtype))
        at += size + -size % 8
    return out


def read_range(uri: str, offset: int, length: int) -> bytes:
    """Some bytes of a file."""
    system, path = _split(uri)
    with system.open_input_file(path) as src:
        src.seek(offset)
        return src.read(length)
