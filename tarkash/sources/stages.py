"""Frames that several steps of a plan read, written once to the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame

_own: list[str] = []


class Stages:
    """Writes frames and reads them back: later steps plan from the written rows, and a lost executor costs no earlier step.

    The folder is ``spark.checkpoint.dir``; a local session without one gets a temporary folder, a
    cluster without one is an error. ``release`` deletes what was written; at exit all is deleted.
    """

    def __init__(self) -> None:
        self.written: list[tuple[DataFrame, str]] = []
        atexit.register(self.release)

    def __call__(self, df: DataFrame) -> DataFrame:
        spark = df.sparkSession
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            if not _own:
                _own.append(tempfile.mkdtemp(prefix="tarkash-"))
                atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
            base = "file://" + _own[0]
        path = f"{base.rstrip('/')}/stage-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.written.append((df, path))
        return spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        """Deletes what was written; frames read from it must not be used afterwards."""
        while self.written:
            df, path = self.written.pop()
            with contextlib.suppress(Exception):  # the session may be gone
                folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
                folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)
