"""Small Spark helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.cluster import ship


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where it is unset (local tests) a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="maskwright-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Spark's option to remove the shuffle files of a job when it ends, and not when the driver collects garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str = "step", clean: bool = False) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again: lineage is cut, lost executors cost nothing.

    ``clean``: the shuffle files of the job go with its end.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, None)
    if clean:
        spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        if clean:
            spark.conf.set(_CLEAN, before) if before is not None else spark.conf.unset(_CLEAN)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, *written: DataFrame) -> None:
    """Delete tables of ``materialise`` that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for df in written:
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _give_back() -> None:
    """Hand freed memory back to the system, so that a reused Python worker keeps nothing of a finished task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # no such call in this C library
        pass


#: glibc's option for the least size of a block that is mapped, and its greatest value.
_MAP_FROM, _MOST = -3, 32 << 20


def _map_from(size: int) -> None:
    """Blocks of ``size`` bytes or more are mapped, and so go back to the system as soon as they are freed."""
    try:
        ctypes.CDLL(None).mallopt(_MAP_FROM, size)
    except (OSError, AttributeError):  # no such call in this C library
        pass


def tidy(work: Callable, lean: bool = False) -> Callable:
    """A function over Arrow batches that leaves no freed memory behind when its task ends.

    ``lean``: nor while it runs. By default the C library raises the size from which it maps blocks with every large block
    that is freed; later arrays then lie in a heap whose gaps count as used. That costs some page faults.
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if lean:
            _map_from(1 << 20)
        try:
            yield from work(batches)
        finally:
            _give_back()
            if lean:
                _map_from(_MOST)

    return go


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, k: int) -> Column:
    """crc32 of the id's decimal text, modulo ``k``; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(k))
