"""The shared folder: where jobs cut their lineage and keep models.

Everything that one stage leaves for another goes below ``spark.checkpoint.dir``,
the folder that the driver and all executors share, so that a lost executor
loses nothing. Where a session on one machine names none (tests, a laptop), a temporary folder is
made and set once; on a cluster that is an error. Tables that are superseded within a job are deleted (``drop``);
what results may still read stays until the user clears the folder.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from urllib.parse import urlparse
from urllib.request import url2pathname

import numpy as np
from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The URI of the shared folder; one is made only where the session names none."""
    folder = spark.conf.get(KEY, None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError(f"{KEY} must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="batchlens-")
        spark.conf.set(KEY, folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back: the lineage ends there."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a table that ``saved`` wrote and that nothing will read again."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_name(name: str, columns: list[str]) -> str:
    """``name``, or one like it that none of ``columns`` has; Spark doesn't tell capitals apart."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def mounted(uri: str) -> bool:
    """Whether the file can be memory-mapped."""
    return _local(uri) is not None


def _local(uri: str) -> str | None:
    parts = urlparse(uri)
    return url2pathname(parts.path) if parts.scheme in ("", "file") else None


def put_bytes(uri: str, parts: list) -> None:
    """Write one file; a second attempt of the task replaces it by the same content."""
    if path := _local(uri):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        own = f"{path}.{uuid.uuid4().hex}"
        with open(own, "wb") as out:
            for x in parts:
                out.write(x)
        os.replace(own, path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    own = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(own) as out:
        for x in parts:
            out.write(x)
    store.move(own, path)


def mapped(uri: str) -> np.ndarray:
    """The file's bytes: memory-mapped from a mounted folder, else read from the store."""
    if path := _local(uri):
        return np.memmap(path, dtype=np.uint8, mode="r") if os.path.getsize(path) else np.zeros(0, np.uint8)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), np.uint8)
