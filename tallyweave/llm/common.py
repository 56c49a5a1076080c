"""Shared plumbing of the corpus operators: tables, checkpoints, sizing."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only on one machine (master ``local[...]``) whose session names no checkpoint folder.
DEFAULT_CHECKPOINT_DIR = "/tmp/checkpoints"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the session names.  A cluster must name one; one machine alone has a default."""
    sc = spark.sparkContext
    if (found := sc.getCheckpointDir()) is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc._jsc.sc().isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or DEFAULT_CHECKPOINT_DIR)
        found = sc.getCheckpointDir()
    return found


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: rows are computed once, lineage is cut, lost executors cost nothing."""
    checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    let_go(df.sparkSession)
    return out


def let_go(spark: SparkSession) -> None:
    """Has the driver drop plans nobody holds any more: Spark then deletes their shuffle files and checkpoints.

    Without it they stay until the driver happens to collect its garbage, and a job of many rounds keeps
    the files of all of them.  What the driver's two processes have freed goes back to the system.
    """
    give_back()
    spark.sparkContext._jvm.System.gc()
    _trim_driver(spark)


def _trim_driver(spark: SparkSession) -> None:
    """Returns memory that the driver's JVM has freed outside its heap; the C library keeps it otherwise.

    It is the JVM's own command System.trim_native_heap.  Its class is hidden from py4j, so it goes by reflection.
    """
    jvm, array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    try:
        of = jvm.java.lang.Class.forName
        kinds, values = array(jvm.Class, 4), array(jvm.Object, 4)
        for k, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[k] = of(name)
        values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        beans = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        of("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(beans, values)
    except Py4JError:  # a JVM without that command
        pass


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate (file sizes for scans); free of jobs.  Used to choose partition counts."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def pieces(df: DataFrame, each: int, least: int = 8, most: int = 1 << 16) -> int:
    """How many pieces of about ``each`` bytes the plan's output makes."""
    return max(least, min(most, -(-plan_bytes(df) // each)))


def worded(df: DataFrame, *cols: str) -> DataFrame:
    """``df`` with columns as text: a whole number beside nulls would pass through Python as a float."""
    return df.withColumns({c: F.col(c).cast("string") for c in cols})


def typed(df: DataFrame, like: DataFrame, *cols: str) -> DataFrame:
    """Columns back to the types they have in ``like``."""
    kinds = dict(like.dtypes)
    return df.withColumns({c: F.col(c).cast(kinds[c]) for c in cols})


#: Rows of an Arrow batch to Python: texts may be long, and the default holds ten thousand.
BATCH_ROWS = 1000
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after lowering the session's Arrow batch rows to BATCH_ROWS where they are more or unbounded."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_BATCH_SETTING, "10000")) <= BATCH_ROWS:
        conf.set(_BATCH_SETTING, str(BATCH_ROWS))
    return df


def give_back() -> None:
    """Returns a Python process's freed memory to the system; workers live on between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
