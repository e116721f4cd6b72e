"""What several operators share: the shared folder, written tables, blobs of packed arrays."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word pattern `[^\x20\x09-\x0D]+`.
BLANKS = "\t\n\x0b\x0c\r "


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where it is unset and all tasks
    run in this process (tests) a local one is made."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not at:
        at = sc._jsc.sc().getCheckpointDir()
        if not at.isDefined() and sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = at.get() if at.isDefined() else f"file://{tempfile.mkdtemp(prefix='wavemill-')}"
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder name in the shared folder."""
    return f"{shared_dir(spark)}/wavemill-{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, path: str, *by: str) -> DataFrame:
    """df, cut from its lineage by writing it to path."""
    w = df.write.option("compression", "zstd").mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps, which it does when the JVM collects its garbage, and the driver give
    back the memory that they took: its heap shrinks to twice what is alive, freed native memory goes to the system. A JVM that
    can't do so goes without; its heap keeps that ratio afterwards."""
    import gc

    gc.collect()
    jvm = spark._jvm
    beans = jvm.java.lang.management.ManagementFactory
    with contextlib.suppress(Py4JError):
        kind = "com.sun.management.HotSpotDiagnosticMXBean"
        _call(spark, kind, beans.getPlatformMXBean(jvm.java.lang.Class.forName(kind)), "setVMOption", {"java.lang.String": "MaxHeapFreeRatio"}, {"java.lang.String": "50"})
    jvm.System.gc()
    with contextlib.suppress(Py4JError):
        name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        _call(spark, "javax.management.MBeanServer", beans.getPlatformMBeanServer(), "invoke", {"javax.management.ObjectName": name}, {"java.lang.String": "systemTrimNativeHeap"}, {"[Ljava.lang.Object;": None}, {"[Ljava.lang.String;": None})


def release_all(spark: SparkSession) -> None:
    """release(), and the executors' JVMs collect too, which else happens only where their heaps are full: a heap that a large step
    has grown shrinks before the next step. A task each, which Spark deals to all executors while they are idle."""
    release(spark)
    executors = spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - 1  # the driver is among them
    if executors > 0:
        spark.range(0, executors, 1, executors).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def _call(spark: SparkSession, kind: str, bean, method: str, *given: dict):
    """bean.method(...) by the method of its interface, as the classes of the JVM's beans can't be reached; given: {type: value} each."""
    gateway, jvm = spark.sparkContext._gateway, spark._jvm
    kinds, values = gateway.new_array(jvm.java.lang.Class, len(given)), gateway.new_array(jvm.java.lang.Object, len(given))
    for i, ((k, v),) in enumerate(x.items() for x in given):
        kinds[i], values[i] = jvm.java.lang.Class.forName(k), v
    return jvm.java.lang.Class.forName(kind).getMethod(method, kinds).invoke(bean, values)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buckets_for(spark: SparkSession, rows: int, each: int) -> int:
    """How many buckets to deal rows into, so that a bucket holds about `each` and all tasks have some."""
    return max(shuffle_parts(spark), -(-rows // each))


def known_id(docs: DataFrame):
    """doc_id as _id, a null one as the least long, which comes first."""
    return F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)).alias("_id")


def real_id(c: str = "_id"):
    return F.when(F.col(c) != F.lit(NULL_ID), F.col(c))


NULL_ID = -(1 << 63)


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores before it as no column of df begins with."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def pack(**arrays: np.ndarray) -> bytes:
    """Arrays of one length, column by column, as one compressed Arrow stream."""
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([_planes(a) for a in arrays.values()], names=[f"{k}:{a.dtype.str}" for k, a in arrays.items()])
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _planes(a: np.ndarray) -> pa.Array:
    """An array's bytes, plane by plane, in one cell: high bytes that are zero cost nothing then."""
    a = np.ascontiguousarray(a)
    return pa.array([a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes()], pa.large_binary())


def unpack(blob) -> dict[str, np.ndarray]:
    batch = pa.ipc.open_stream(pa.py_buffer(blob)).read_next_batch()
    out = {}
    for name, column in zip(batch.schema.names, batch.columns, strict=True):
        key, kind = name.split(":")
        kind = np.dtype(kind)
        raw = np.frombuffer(column[0].as_buffer(), np.uint8) if len(column[0].as_buffer()) else np.empty(0, np.uint8)
        out[key] = np.ascontiguousarray(raw.reshape(kind.itemsize, -1).T).reshape(-1).view(kind)
    return out


def unpack_all(blobs, like: dict[str, str]) -> dict[str, np.ndarray]:
    """The arrays of many blobs, one after another; like: names and types."""
    found = [unpack(x) for x in blobs]
    return {k: np.concatenate([x[k] for x in found]) if found else np.empty(0, kind) for k, kind in like.items()}


def split_by(part: np.ndarray, n: int, arrays: dict[str, np.ndarray]):
    """(part, blob) for every part that has rows; the rows keep their order."""
    order = np.argsort(part, kind="stable")
    ends = np.searchsorted(part[order], np.arange(n + 1))
    for i in np.flatnonzero(ends[1:] > ends[:-1]):
        at = order[ends[i] : ends[i + 1]]
        yield int(i), pack(**{k: a[at] for k, a in arrays.items()})
