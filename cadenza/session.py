"""Session helpers: building a local session for tests/bench, and the shared
checkpoint folder every lineage cut and derived table goes to.

On a cluster the folder comes from ``spark.checkpoint.dir`` (a shared
filesystem named by the cluster). We only pick our own when it is unset,
as in tests on one machine.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the bench: AQE on, UI off, Arrow on."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("cadenza")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_root(spark)
    return spark


def _context(spark: SparkSession):
    """The SparkContext, or None on a Spark Connect session."""
    try:
        return spark.sparkContext
    except Exception:  # noqa: BLE001 - Connect sessions have no context
        return None


class _Held:
    """Stands in for a broadcast variable where there is no SparkContext: the
    value travels with the task closure (callers bound its size first)."""

    def __init__(self, value):
        self.value = value


def broadcast_value(spark: SparkSession, value):
    sc = _context(spark)
    return sc.broadcast(value) if sc is not None else _Held(value)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and derived tables.

    Reads ``spark.checkpoint.dir`` from the session; picks a temporary folder only
    where it is unset on a local master, whose driver and tasks share one disk.
    """
    sc = _context(spark)
    if sc is None:
        conf = spark.conf.get("spark.checkpoint.dir", None)
        if not conf:
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
        return conf
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not conf:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
        conf = tempfile.mkdtemp(prefix="cadenza-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder for a derived table."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/cadenza-{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def session_conf(spark: SparkSession, key: str, value):
    """``key`` set to ``value`` for the jobs planned inside, and put back after."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(value))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def register_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Register the driver tables as temp views (for ``spark.sql`` queries)."""
    for n in names:
        read_table(spark, sf_dir, n).createOrReplaceTempView(n)


def cut_lineage(df: DataFrame, name: str = "table", files: int | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared checkpoint folder and read
    it back: the plan is computed once (an RDD checkpoint computes it twice
    unless persisted), the lineage is cut, a lost executor re-reads files
    instead of recomputing, and later reads prune columns. ``files``: the most
    files to write (see :func:`files_for`)."""
    path = scratch_path(df.sparkSession, name)
    df = df if files is None else df.coalesce(files)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def files_for(spark: SparkSession, rows: int, rows_per_file: int) -> int:
    """How many files so many rows are worth, at least two for each core. A table
    has a file for each shuffle partition otherwise, and on a local disk Hadoop
    starts several processes for each file, from an executor of any size."""
    sc = _context(spark)
    return max(2 * sc.defaultParallelism if sc is not None else 0, -(-rows // rows_per_file), 1)


def _application(spark: SparkSession) -> str:
    sc = _context(spark)
    return sc.applicationId if sc is not None else spark.conf.get("spark.app.id", str(id(spark)))


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers, once per application, so that jobs run from any folder."""
    sc = _context(spark)
    if sc is None or sc.applicationId in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(here):  # else the package already comes from an archive
        made = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="cadenza-"), "cadenza"), "zip",
                                   os.path.dirname(here), os.path.basename(here))
        sc.addPyFile(made)
    _SHIPPED.add(sc.applicationId)


_MATERIALISED: dict[tuple, DataFrame] = {}


def _input_stamp(spark: SparkSession, inputs: list[str]) -> tuple:
    """Count, bytes, newest time and name hash of the input files, listed by Spark
    wherever it can read (the contents are not read)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(inputs))
    return tuple(files.agg(F.count(F.lit(1)), F.sum("length"), F.max("modificationTime"),
                           F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first())


def materialised(spark: SparkSession, name: str, inputs: list[str], build) -> DataFrame:
    """A table written once per session and read by later queries (like a
    stored table the application loads once). The key includes the input
    files' sizes and modification times, so changed inputs rebuild it."""
    key = (_application(spark), checkpoint_root(spark), name, _input_stamp(spark, inputs))
    if key not in _MATERIALISED:
        _MATERIALISED[key] = cut_lineage(build(), name)
    return _MATERIALISED[key]


_WRITTEN: dict[tuple, str] = {}


def written_once(spark: SparkSession, name: str, inputs: list[str], write) -> str:
    """Like :func:`materialised` for data kept as files (``write()`` returns
    the path it wrote)."""
    key = (_application(spark), checkpoint_root(spark), name, _input_stamp(spark, inputs))
    if key not in _WRITTEN:
        _WRITTEN[key] = write()
    return _WRITTEN[key]

