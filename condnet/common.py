"""Helpers shared by all operators: table access, cut lineage, keys."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []
#: The tables of this thread's scope().
_own = threading.local()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: what the cluster names in spark.checkpoint.dir. Only where that is unset and everything runs in one process (tests) a temporary one."""
    conf = spark.sparkContext.getConf()
    there = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if not there:
        master = conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        there = "file://" + tempfile.mkdtemp(prefix="condnet-")
        spark.conf.set("spark.checkpoint.dir", there)
    return there.rstrip("/")


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage is cut, the result survives lost executors. The table goes when the process ends, or the enclosing scope()."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for what its caller writes; it goes like a table of materialize()."""
    path = f"{shared_dir(spark)}/condnet-{name}-{uuid.uuid4().hex}"
    mine = getattr(_own, "tables", None)
    (_written if mine is None else mine).append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where it isn't there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []


@contextmanager
def scope() -> Iterator[None]:
    """Tables that this thread writes inside are removed at the end: for work whose result has been written elsewhere."""
    outer = getattr(_own, "tables", None)
    _own.tables = []
    try:
        yield
    finally:
        mine, _own.tables = _own.tables, outer
        for spark, path in mine:
            remove(spark, path)


@atexit.register
def _remove_all() -> None:
    for spark, path in _written:
        try:
            remove(spark, path)
        except Exception:
            return


def dest_key(c: Column | str) -> Column:
    """dest without blanks and tabs around it, in lower case; null where nothing is left."""
    return F.nullif(F.lower(F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(" \t"))), F.lit(""))


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
