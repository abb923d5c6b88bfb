"""Session helpers: configuration of our own sessions, and tables in the shared folder that cut lineage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession

from tidemark.errors import ConfigError


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A session for tests and benches on one machine. On a cluster the submitting side configures the session."""
    settings = {
        "spark.master": f"local[{cpus}]",
        "spark.driver.memory": memory,
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
    } | conf
    spark = SparkSession.builder.config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share.

    It is the one in spark.checkpoint.dir. Only where that is unset and the session runs on this machine (local[N], as
    in tests) a folder of our own is set; on a cluster an unset folder is an error, as no machine-local one would do.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
        return named.rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise ConfigError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='tidemark-')}")
    return context.getCheckpointDir().rstrip("/")


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Actions inside send at most `rows` rows at once to a Python worker, which bounds what long texts need there."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Scratch:
    """Tables of one run, written to the shared folder.

    A written table survives the loss of executors and has a size that Spark knows from its files, so that a later
    join broadcasts it only if it is below spark.sql.autoBroadcastJoinThreshold. Tables stay until the process ends, as
    results read them lazily; a session that runs many queries should write each result and then close its scratch,
    or use it in a `with` block, and Scratch.close_all deletes those of all runs.
    """

    opened: ClassVar[list[Scratch]] = []


    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
        self._made: dict[str, list[str]] = {}
        self._tables = 0
        self.__class__.opened.append(self)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and return it as read back. A name that is used again gets another path, so earlier results stay."""
        paths = self._made.setdefault(name, [])
        paths.append(self.path(f"{name}-{self._tables}"))
        self._tables += 1
        df.write.mode("overwrite").parquet(paths[-1])
        return self.spark.read.schema(df.schema).parquet(paths[-1])

    def drop(self, name: str) -> None:
        """Delete the table last written under the name."""
        if self._made.get(name):
            self._delete(self._made[name][-1])

    def drop_before(self, name: str) -> None:
        """Delete the tables written under the name but the last."""
        for path in self._made.get(name, [])[:-1]:
            self._delete(path)
        self._made[name] = self._made.get(name, [])[-1:]

    def close(self) -> None:
        """Delete all tables of the run; results that still read them are then no longer readable."""
        self._delete(self.root)
        if self in self.opened:
            self.opened.remove(self)

    @classmethod
    def close_all(cls) -> None:
        for s in list(cls.opened):
            s.close()

    def _delete(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:
            if path.startswith("file:") and os.path.isdir(path[5:]):
                import shutil

                shutil.rmtree(path[5:], ignore_errors=True)


atexit.register(Scratch.close_all)
