"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: list[str] = []
_made: dict[str, SparkSession] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under the one all executors share, which ``spark.checkpoint.dir`` names.

    Where that is unset, a local session (tests, one machine) gets a temporary folder of its own;
    on a cluster it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own_dir:
            _own_dir.append(tempfile.mkdtemp(prefix="tarkash-"))
        base = "file://" + _own_dir[0]
    path = f"{base.rstrip('/')}/tarkash-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def made() -> list[str]:
    """The folders this program has made and not yet released."""
    return list(_made)


@atexit.register
def release(*paths: str) -> None:
    """Deletes folders made here; at exit, without names, all that are left.

    A frame that reads a folder must not be used afterwards.
    """
    for path in paths or made():
        spark = _made.pop(path, None)
        with contextlib.suppress(Exception):  # the session may be gone
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def cut(df: DataFrame) -> DataFrame:
    """The frame as written to the shared folder: later reads need no earlier stage."""
    return stored(df)[0]


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """As ``cut``, with the folder, so that it can be released once nothing reads it."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of the frame has it; case does not count."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def packed_row(df: DataFrame) -> Column:
    """All columns as one struct, so that an operator's own names cannot clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]) if df.columns else F.lit(None)


def unpacked_row(df: DataFrame, row: str) -> list[Column]:
    """The columns that ``packed_row`` put away."""
    return [F.col(f"`{row}`.`{c}`").alias(c) for c in df.columns]


def with_side(rows: DataFrame, side: DataFrame, keys: list[str], small: bool, spread: Column, how: str = "inner", salt: int = 32) -> DataFrame:
    """``rows`` joined with a side of one row a key: broadcast if it is small, else by key and salt.

    The salt (``spread``, an expression of the rows) deals a key that holds a large share of the
    rows to ``salt`` tasks; the side is repeated for each.
    """
    if small:
        return rows.join(F.broadcast(side), keys, how)
    rows = rows.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salt)).cast("int"))
    side = side.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    return rows.join(side, [*keys, "__salt"], how).drop("__salt")


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def remainder(column: str, divisor: int) -> Column:
    """crc32 of the id's decimal text, modulo ``divisor``; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(divisor))


def filesystem(uri: str):
    """(pyarrow file system, path) of a folder in the shared store."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def put(uri: str, name: str, data: bytes) -> None:
    """Writes a whole file or none: retried and speculative tasks overwrite with the same bytes."""
    store, base = filesystem(uri)
    store.create_dir(base, recursive=True)
    part = f"{base}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, f"{base}/{name}")


def mapped(uri: str, name: str):
    """A file of the store as a read-only memory map, None if there is none.

    A local or mounted store is mapped in place. From any other store the file is read into
    memory: nothing is copied to a machine's own disk.
    """
    import mmap

    from pyarrow import fs

    store, base = filesystem(uri)
    if isinstance(store, fs.LocalFileSystem):
        if not os.path.exists(f"{base}/{name}"):
            return None
        with open(f"{base}/{name}", "rb") as handle:
            return mmap.mmap(handle.fileno(), os.fstat(handle.fileno()).st_size, access=mmap.ACCESS_READ)
    if store.get_file_info(f"{base}/{name}").type == fs.FileType.NotFound:
        return None
    with store.open_input_stream(f"{base}/{name}") as src:
        return src.read()
