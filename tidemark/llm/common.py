"""Small pieces that every operator here shares: the shared folder, tables that cut lineage, column guards."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where that is unset a temporary folder takes its place if everything runs on one machine; on a cluster it is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; the caller's write creates it."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: later jobs no longer depend on any executor."""
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, df: DataFrame) -> None:
    """Delete a table that stored() wrote and that no later job reads."""
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if re.search(r"-[0-9a-f]{32}$", folder) and _plain(folder).startswith(_plain(shared_dir(spark)) + "/"):
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _plain(path: str) -> str:
    return re.sub(r"^file:/+", "/", path)


def unused(columns: list[str], name: str) -> str:
    """name, with underscores before it as long as a column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_bytes(text: str = "text") -> Column:
    """UTF-8 bytes of a text column; null counts as the empty text."""
    return F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """df.mapInArrow(run, schema) whose workers give memory back to the machine.

    Spark keeps Python workers for later tasks, and by default a worker keeps what it has freed, up to the most that any
    earlier task of it needed. Here arrays of a megabyte and more are mapped, so that they go when they are freed, and the rest goes
    at the end of each task.
    """

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        libc = _libc()
        pa.set_memory_pool(pa.system_memory_pool())
        if libc:
            libc.mallopt(_MAP_FROM, 1 << 20)
        try:
            yield from run(batches)
        finally:
            if libc:
                libc.malloc_trim(0)

    return df.mapInArrow(lean, schema)


#: The C library's number for the size from which memory is mapped.
_MAP_FROM = -3


def _libc() -> ctypes.CDLL | None:
    """The C library, where it is one that can do this."""
    libc = ctypes.CDLL(None)
    return libc if hasattr(libc, "mallopt") and hasattr(libc, "malloc_trim") else None
