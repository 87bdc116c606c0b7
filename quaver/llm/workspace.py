"""Where intermediate tables live: the folder that driver and executors share.

``spark.checkpoint.dir`` of the session names it. Only where it is unset (local
runs, tests) a folder of our own is set. Nothing here uses a machine-local
temporary folder on a cluster.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: How tables in buckets are written: Zstandard packs lists of numbers by a fifth more than Snappy in the same time, and Parquet's
#: second version can hold numbers in order as their differences.
PACKED = {"compression": "zstd", "parquet.writer.version": "v2"}
#: Files of buckets that a task may have open: its rows are then not sorted by bucket. Where there are more, Spark sorts the rest.
OPEN_BUCKETS = 4

_made: list[tuple[SparkSession, str]] = []
_tables: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; on a local master one is made if the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = f"file://{tempfile.mkdtemp(prefix='quaver-')}"
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def materialize(df: DataFrame, name: str = "t", by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the lineage, survives lost executors.

    ``by``: a column whose few values get a folder each.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quaver-{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def settings(spark: SparkSession, given: dict[str, object]) -> Iterator[None]:
    """The session with other settings for a while."""
    before = {name: spark.conf.get(name) for name in given}
    for name, value in given.items():
        spark.conf.set(name, str(value))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def bucketed(df: DataFrame, by: str, name: str = "t", spread: int = 1, rising: str | None = None) -> DataFrame:
    """The same as a table in buckets of a column: windows, joins and groups by it, or by it and more, need no shuffle.

    Rows of a task keep their order where it fills few buckets. ``spread``: buckets for each shuffle partition. ``rising``: a column in whose order
    rows come, kept as differences and not as numbers of a dictionary. The files lie in the shared folder; the session's catalog names them until ``release``.
    """
    spark = df.sparkSession
    known = f"quaver_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/quaver-{name}-{known}"
    buckets = spread * int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = PACKED | ({f"parquet.enable.dictionary#{rising}": "false"} if rising else {})
    with settings(spark, {"spark.sql.maxConcurrentOutputFileWriters": OPEN_BUCKETS}):
        df.write.bucketBy(buckets, by).options(**packed).option("path", path).saveAsTable(known)
    _made.append((spark, path))
    _tables[path] = known
    return spark.table(known)


def made(spark: SparkSession) -> int:
    """How many tables of this session there are."""
    return sum(x[0] is spark for x in _made)


def release(spark: SparkSession, since: int = 0, keep: int = 0) -> int:
    """Delete the tables that ``materialize`` has written in this session, once their results are no longer read.

    ``since``: all but the first so many, as ``made`` has counted them; ``keep``: nor the last so many.
    """
    mine = [x for x in _made if x[0] is spark]
    gone = mine[since : len(mine) - keep]
    for _, path in gone:
        if path in _tables:
            spark.sql(f"DROP TABLE IF EXISTS {_tables.pop(path)}")
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _made[:] = [x for x in _made if all(x is not g for g in gone)]
    return len(gone)
