"""Lines of the members of ZIP and TAR files, one archive a task, in bounded Arrow batches."""

from __future__ import annotations

import io
import re
import tarfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

BATCH = 20_000
SCHEMA = "path string, member string, value string"


def _zip_members(data: bytes) -> Iterator[tuple[str, io.BufferedIOBase]]:
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        for info in archive.infolist():
            if not info.is_dir():
                with archive.open(info) as stream:
                    yield info.filename, stream


def _tar_members(data: bytes) -> Iterator[tuple[str, io.BufferedIOBase]]:
    with tarfile.open(fileobj=io.BytesIO(data)) as archive:
        for info in archive:
            if info.isfile():
                yield info.name, archive.extractfile(info)


def _lines(stream: io.BufferedIOBase, guess: bool) -> Iterator[str]:
    """Text lines; with ``guess`` the stream is UTF-8 if all of it is valid, else UTF-16."""
    if not guess:
        yield from (line.rstrip("\r\n") for line in io.TextIOWrapper(stream, "utf-8", errors="ignore"))
        return
    data = stream.read()
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        text = data.decode("utf-16", errors="ignore")
    yield from text.splitlines()


def _read(spark: SparkSession, path: str, members: Callable, pattern: str, guess: bool) -> DataFrame:
    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, rows = re.compile(pattern), []
        for batch in batches:
            for file in batch.to_pylist():
                for member, stream in members(file["content"]):
                    if not wanted.search(member):
                        continue
                    for line in _lines(stream, guess):
                        rows.append({"path": file["path"], "member": member, "value": line})
                        if len(rows) == BATCH:
                            yield pa.RecordBatch.from_pylist(rows, batch_schema)
                            rows = []
        yield pa.RecordBatch.from_pylist(rows, batch_schema)

    batch_schema = pa.schema([(n, pa.string()) for n in ("path", "member", "value")])
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(expand, SCHEMA)


def zip_lines(spark: SparkSession, path: str, pattern: str = "", guess: bool = False) -> DataFrame:
    """(path, member, value) of members whose name matches; Spark reads files of up to 2 GB this way."""
    return _read(spark, path, _zip_members, pattern, guess)


def tar_lines(spark: SparkSession, path: str, pattern: str = "", guess: bool = False) -> DataFrame:
    return _read(spark, path, _tar_members, pattern, guess)
