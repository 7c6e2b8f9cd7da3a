"""Shared pieces: tables in the shared folder, document keys, packed texts, graph components."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import spread

#: A word is a run of bytes other than ASCII space, \t, \n, \v, \f and \r; bytes.split() uses the same rule.
WORD = r"[^\x20\x09-\x0D]+"
#: Stands for a null document id inside the operators; it sorts first.
NO_ID = -(2**63)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new local one where that is unset and Spark runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="larkspan-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, deleted when the driver ends."""
    jvm = spark.sparkContext._jvm
    path = f"{shared_dir(spark)}/larkspan-{uuid.uuid4().hex}/{name}"
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p.getParent())
    return path


#: Row groups of written tables are small, since a task holds one in memory while it writes.
WRITTEN = {"compression": "zstd", "parquet.block.size": 16 << 20}
#: While a table is written: Spark drops the query's shuffle files when it ends, and Python workers get texts in batches that stay small outside the heap, however long the texts are.
WHILE_WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}


def trim(spark: SparkSession) -> bool:
    """Returns what the driver's JVM has freed outside its heap to the system; whether the JVM can (HotSpot on Linux, 17.0.9 or later)."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway

    def array(kind, *values):
        out = gateway.new_array(kind, len(values))
        for i, v in enumerate(values):
            out[i] = v
        return out

    lang = jvm.java.lang
    try:
        command = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        given = command, "systemTrimNativeHeap", array(lang.Object), array(lang.String)
        kinds = command.getClass(), lang.Class.forName("java.lang.String"), given[2].getClass(), given[3].getClass()
        # by its interface: the class of the server is not open to others
        invoke = lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", array(lang.Class, *kinds))
        invoke.invoke(lang.management.ManagementFactory.getPlatformMBeanServer(), array(lang.Object, *given))
    except Py4JError:  # a JVM without the command
        return False
    return True


def table(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: the lineage ends there and survives lost executors.

    The shuffle files of the write go when it ends. A driver whose heap is over
    a quarter full collects its garbage first: plans of hundreds of small
    writes, which Python's objects keep alive, add up where it has little memory.
    What compiling and compressing freed outside the heap goes back too.
    """
    spark = df.sparkSession
    heap = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    if 4 * (heap.totalMemory() - heap.freeMemory()) > heap.maxMemory():
        gc.collect()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()  # else events that wait to be told hold metrics of thousands of tasks
        spark.sparkContext._jvm.System.gc()
        trim(spark)
    path, before = new_path(spark, name), {k: spark.conf.get(k, None) for k in WHILE_WRITING}
    for k, v in WHILE_WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.options(**WRITTEN).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._larkspan_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes what table() wrote; nothing may read it any more. Other DataFrames are left alone."""
    for t in tables:
        if path := getattr(t, "_larkspan_path", None):
            p = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p.getParent(), True)


#: Rows of a written table up to which it is sent to every task of a join; they are of a few hundred bytes at most.
SENT_ROWS = 50_000


def sent_if_small(written: DataFrame) -> DataFrame:
    """A table that table() wrote, or a part of one, marked for broadcast if its counted rows are few; a larger one is joined by shuffle."""
    return F.broadcast(written) if written.limit(SENT_ROWS + 1).count() <= SENT_ROWS else written


def doc_key(col: str = "doc_id") -> F.Column:
    return F.coalesce(F.col(col).cast("long"), F.lit(NO_ID))


def doc_id(col: str | F.Column) -> F.Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c != NO_ID, c)


def text_key(col: str = "text") -> F.Column:
    """64 bits of the text's hash; a null text is an empty one. With the id it tells rows apart."""
    return F.xxhash64(F.coalesce(F.col(col), F.lit("")))


def as_bytes(column: pa.Array) -> list:
    """A text column of an Arrow batch as a list of UTF-8 bytes or None."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def packed_texts(docs: DataFrame) -> DataFrame:
    """did, tk (64 bits of the text's hash, so that rows which share an id stay apart), n_bytes, z (the text, zstd)."""

    def run(batches):
        codec = pa.Codec("zstd", compression_level=1)
        for b in batches:
            texts = [t or b"" for t in as_bytes(b.column(2))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([len(t) for t in texts], pa.int64()), pa.array([codec.compress(t, asbytes=True) for t in texts], pa.binary())],
                names=["did", "tk", "n_bytes", "z"],
            )

    return keyed(docs).mapInArrow(run, "did long, tk long, n_bytes long, z binary")


def keyed(docs: DataFrame) -> DataFrame:
    """did, tk, text of documents; a null text is an empty one."""
    return spread(docs.select("doc_id", "text")).select(doc_key().alias("did"), text_key().alias("tk"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def unpack(z: bytes, n: int) -> bytes:
    return pa.Codec("zstd").decompress(z, decompressed_size=n, asbytes=True) if n else b""


def group_bounds(*columns: np.ndarray) -> np.ndarray:
    """Starts of runs of equal rows, and the length at the end."""
    n = len(columns[0])
    if not n:
        return np.zeros(1, np.int64)
    change = np.zeros(n, bool)
    change[0] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(change), n)


#: Neighbours beyond which the edges of a node do not meet in one task.
HUB = 512


def with_least(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """u, v, m (the smallest v of u) of each edge (u, v); and u, m, n (how many edges) of each u.

    Smallest neighbours are added up before they travel. Edges of a node with
    over HUB neighbours get theirs from a table that goes to every task and are
    dealt by the whole edge. That table has the SENT_ROWS nodes with the most
    neighbours, so any other node has less than one in SENT_ROWS of all edges.
    """
    low = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    # one row that is no hub keeps the plan's form the same with and without hubs
    none = edges.sparkSession.range(0, 1, 1, 1).select(F.lit(-1).cast("long").alias("u"), F.lit(None).cast("long").alias("hub_m"))
    hubs = low.where(F.col("n") > HUB).orderBy(F.desc("n"), "u").limit(SENT_ROWS).select("u", F.col("m").alias("hub_m"))
    tagged = edges.join(F.broadcast(hubs.unionByName(none)), "u", "left")
    dealt = tagged.withColumn("k", F.when(F.col("hub_m").isNull(), F.col("u")).otherwise(F.xxhash64("u", "v")))
    met = dealt.join(low.select(F.col("u").alias("k"), "m"), "k", "left")
    return met.select("u", "v", F.coalesce("hub_m", "m").alias("m")), low


#: Edges up to which a graph is solved in one task, in a few MB; rounds of joins over a small one cost the driver more than the task.
SOLVED = 1 << 16


def _solve(batches):
    """node, root of all edges (u, v) of the batches: each node's root hooks on to a smaller one that an edge reaches, paths are halved."""
    parts = [[b.column(i).to_numpy() for i in (0, 1)] for b in batches]
    u, v = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*parts) if parts else ((), ())))
    node, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(node))
    while (root[a] != root[b]).any():
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(node[root], pa.int64())], names=["node", "root"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """node, root (smallest node reachable) of every node that an edge touches.

    Alternates large-star and small-star steps; each is one aggregation and one
    join on the node, so no component is ever gathered in one place, nor are a
    hub's edges (see with_least). Stops when the edge set, compared by count and
    XOR of hashes, no longer changes. At most SOLVED edges, to begin with, are
    solved in one task with the same result.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = table(e, "edges")
    if e.limit(SOLVED + 1).count() <= SOLVED:
        solved = table(e.coalesce(1).mapInArrow(_solve, "node long, root long"), "roots")
        drop(e)
        return solved
    seen = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both)[0].select(F.col("v").alias("x"), F.least("u", "m").alias("y"), "u").where("x > u AND x <> y").select(F.col("x").alias("u"), F.col("y").alias("v"))
        met, low = with_least(large)
        small = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        last, e = e, table(small.where("u <> v").distinct(), "edges")
        drop(last)
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
