"""Paths that the whole cluster shares, and small Spark helpers."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import zipfile
from contextlib import contextmanager, suppress
from pathlib import Path
from threading import Lock

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir, or the context's checkpoint folder; a local folder only where master is local too."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if root is None and current.isDefined():
        root = current.get()
    if root is None:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        root = tempfile.mkdtemp(prefix="stratum-")
    if not current.isDefined():
        sc.setCheckpointDir(root)
    return root


def shared_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A fresh path below the shared folder; it goes when the scope around it ends (with keep, the one around that)."""
    path = f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if len(_SCOPES) > keep:
        _SCOPES[-1 - keep].append(path)
    return path


_SCOPES: list[list[str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


@contextmanager
def scope(spark: SparkSession):
    """What is materialized inside goes at the end, but for what is kept: so a result that rests on one small table leaves only that."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            _delete(spark, path)
        tidy(spark)


def materialize(df: DataFrame, name: str, codec: str = "zstd", keep: bool = False) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it again.

    Lineage ends there: a lost executor costs its own tasks and no more.  The
    shuffle files of the write go as soon as it is done.
    """
    spark = df.sparkSession
    path = shared_path(spark, name, keep)
    # and the driver keeps no long texts of plans
    with settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true", spark__sql__maxPlanStringLength="20000"):
        df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stratum_path = path
    return out


def tidy(spark: SparkSession) -> None:
    """Lets go of what the driver holds of finished steps: plans and broadcasts that only garbage refers to, and memory that was freed already.

    The JVM keeps most of what a step has taken (a heap of three times what is
    alive, and what its compilers and threads have freed), so the driver would
    grow with the number of steps; it is asked to give that back as well.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
    jvm = spark.sparkContext._jvm
    with _lean_heap(jvm):
        jvm.System.gc()
    with suppress(Py4JError, PySparkException):  # a JVM without that command
        _diagnose(spark, "systemTrimNativeHeap")


def _diagnose(spark: SparkSession, command: str) -> str:
    """What the driver's JVM answers to one of its diagnostic commands (those of jcmd) without arguments."""
    gateway, jvm = spark.sparkContext._gateway, spark.sparkContext._jvm

    def array(kind, *values):
        out = gateway.new_array(kind, len(values))
        for i, value in enumerate(values):
            out[i] = value
        return out

    # by reflection on the interface: the server's own class isn't open to callers
    names = ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")
    find = jvm.java.lang.Class.forName
    method = find("javax.management.MBeanServer").getMethod("invoke", array(jvm.java.lang.Class, *map(find, names)))
    bean = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    call = array(jvm.java.lang.Object, bean, command, array(jvm.java.lang.Object), array(jvm.java.lang.String))
    return method.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), call)


_LEAN = Lock()


@contextmanager
def _lean_heap(jvm):
    """While it lasts, a collection leaves half as much heap again as is alive, if the JVM lets that be set."""
    with _LEAN:
        before = {}
        with suppress(Py4JError, PySparkException):
            bean = jvm.java.lang.management.ManagementFactory.getPlatformMXBean(jvm.java.lang.Class.forName("com.sun.management.HotSpotDiagnosticMXBean"))
            for k, v in (("MinHeapFreeRatio", "10"), ("MaxHeapFreeRatio", "33")):
                old = bean.getVMOption(k).getValue()
                bean.setVMOption(k, v)
                before[k] = old
        try:
            yield
        finally:
            for k, v in reversed(before.items()):  # the lesser may not pass the greater
                bean.setVMOption(k, v)


def discard(table: DataFrame) -> None:
    """Deletes a table that materialize gave and that nothing needs any more."""
    _delete(table.sparkSession, table._stratum_path)
    for paths in _SCOPES:
        if table._stratum_path in paths:
            paths.remove(table._stratum_path)


@contextmanager
def settings(spark: SparkSession, **conf: str):
    """Session settings for a while; keys have __ for dots."""
    names = {k.replace("__", "."): v for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the Python workers, once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_stratum_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="stratum-py-")) / "stratum_package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._stratum_shipped = True
