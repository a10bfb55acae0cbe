"""Session helpers: shared storage for intermediate tables.

Iterative operators cut their lineage by writing a table to the folder that
the cluster names in ``spark.checkpoint.dir``.  Only where that setting is
absent (a single machine, as in tests) is a folder of our own used.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_OWN_ROOT: dict[str, str] = {}
_LEFT: dict[str, SparkSession] = {}


def shared_root(spark: SparkSession) -> str:
    """Folder all executors can read and write; never machine-local on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN_ROOT:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor shares")
        _OWN_ROOT[app] = "file://" + tempfile.mkdtemp(prefix="knotwork-")
    return _OWN_ROOT[app]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _sweep() -> None:
    for path, spark in list(_LEFT.items()):
        try:
            _delete(spark, path)
        except Exception:  # the JVM may be gone already
            pass
    _LEFT.clear()


class Scratch:
    """Intermediate tables of one operator run.

    ``put`` writes a DataFrame as a table of the shared folder and returns the
    DataFrame that reads it: a lost executor costs no recomputation and the
    plan starts anew.  ``drop`` removes a table that a later one has replaced;
    what is left when Python ends is removed then, since the lazy result may
    still read it.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{shared_root(spark)}/knotwork/{label}-{uuid.uuid4().hex}"
        self._n = 0
        self._paths: dict[int, str] = {}
        _LEFT[self.base] = spark

    def put(self, df: DataFrame, by: str | None = None) -> DataFrame:
        """``by`` splits the table into folders by that column, so that a filter on it is a choice of folders."""
        self._n += 1
        path = f"{self.base}/{self._n}"
        schema = df.schema
        writer = (df.hint("rebalance", by).write.partitionBy(by) if by else df.write).option("compression", "zstd")
        writer.parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        self._paths[id(out)] = path
        out._knotwork_path = path
        return out

    def put_counted(self, df: DataFrame, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
        """``put``, and aggregates of the rows taken while they are written (no second job).

        A task that is run again may count its rows twice, so only the
        difference between none and some is exact.
        """
        seen = Observation()
        out = self.put(df.observe(seen, *[c.alias(k) for k, c in counts.items()]))
        return out, {k: v or 0 for k, v in seen.get.items()}

    def drop(self, df: DataFrame | None) -> None:
        path = getattr(df, "_knotwork_path", None)
        if path:
            _delete(self.spark, path)


def location(df: DataFrame) -> str:
    """Where ``Scratch.put`` wrote the table, as a URI that tasks can open by themselves."""
    spark = df.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._knotwork_path)
    uri = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri


_SHARED: dict[tuple[str, str], DataFrame] = {}


def shared_table(spark: SparkSession, name: str, make: Callable[[Scratch], DataFrame]) -> DataFrame:
    """A table that several operators need, written once per application and kept until it ends.

    ``make`` returns what ``Scratch.put`` gave.  If somebody has cleared the
    shared folder meanwhile, the table is written again.
    """
    key = (spark.sparkContext.applicationId, name)
    if key not in _SHARED or not _there(spark, f"{_SHARED[key]._knotwork_path}/_SUCCESS"):
        _SHARED[key] = make(Scratch(spark, "shared"))
    return _SHARED[key]


def _there(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))
