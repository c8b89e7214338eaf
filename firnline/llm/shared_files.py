"""Files that tasks write to and map from the shared folder.

The folder is the one the cluster names in ``spark.checkpoint.dir``. A local mount of it is
mapped into memory; any other file system is read through pyarrow.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession

from firnline.session import scratch_dir


def new_folder(spark: SparkSession) -> str:
    """Address of a folder of its own in the shared folder."""
    return f"{scratch_dir(spark)}/{uuid.uuid4().hex}"


def create(address: str) -> pa.NativeFile:
    """Stream to a new file, whose folders are made as needed."""
    where, path = fs.FileSystem.from_uri(address)
    where.create_dir(path.rpartition("/")[0], recursive=True)
    return where.open_output_stream(path)


def open_mapped(address: str) -> pa.NativeFile:
    """The file for random access; without copies where it is mounted."""
    where, path = fs.FileSystem.from_uri(address)
    if isinstance(where, fs.LocalFileSystem):
        return pa.memory_map(path)
    return where.open_input_file(path)


def write_array(address: str, values: np.ndarray) -> None:
    """The bare values, little-endian."""
    with create(address) as out:
        out.write(np.ascontiguousarray(values).data)


def mapped_array(address: str, dtype: str) -> np.ndarray:
    """What ``write_array`` wrote, mapped read-only."""
    source = open_mapped(address)
    return np.frombuffer(source.read_buffer(source.size()), dtype)
