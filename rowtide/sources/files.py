"""Listing and opening logs on any file system that Arrow knows."""

from __future__ import annotations

import tempfile
import uuid
from typing import BinaryIO

import pyarrow.fs as pafs
from pyspark.sql import SparkSession

from .events import name_key


def system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))


def open_log(path: str) -> BinaryIO:
    fs, p = system(path)
    return fs.open_input_file(p)


def list_logs(folder: str, like: str | None) -> list[tuple[str, str]]:
    """(name, path) of the logs in a folder in their order; given a name, those of the same base only."""
    return [x[:2] for x in sized_logs(folder, like)]


def sized_logs(folder: str, like: str | None) -> list[tuple[str, str, int]]:
    """The same, with each log's length."""
    fs, p = system(folder)
    scheme = folder.partition("://")[0] + "://" if "://" in folder and not folder.startswith("file://") else ""
    found = [(f.base_name, scheme + f.path, f.size or 0) for f in fs.get_file_info(pafs.FileSelector(p)) if f.type == pafs.FileType.File and name_key(f.base_name)[1] >= 0]
    if like is not None:
        found = [x for x in found if name_key(x[0])[0] == name_key(like)[0] or x[0] == like]
    return sorted(found, key=lambda x: name_key(x[0]))


def next_name(name: str) -> str | None:
    """The number behind the last point plus one, six digits at least."""
    base, number = name_key(name)
    return f"{base}.{number + 1:06d}" if number >= 0 else None


_own: dict[str, str] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that ``spark.checkpoint.dir`` names; below a temporary one only in local mode, where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="rowtide-"))
    folder = f"{root.rstrip('/')}/rowtide/{name}-{uuid.uuid4().hex}"
    fs, p = system(folder)
    fs.create_dir(p, recursive=True)
    return folder.removeprefix("file://")


def put(path: str, data: bytes) -> None:
    fs, p = system(path)
    with fs.open_output_stream(p) as f:
        f.write(data)
