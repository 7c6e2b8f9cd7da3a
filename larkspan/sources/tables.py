"""Readers, generators and sinks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """Text without a header; the schema is given, so the file is read once. sep may have several characters."""
    return spark.read.csv(path, schema=schema, sep=sep)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """path and content of image files; operators.pictures decodes PNG files."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def last_texts(docs: DataFrame, id_column: str, text: str, limit: int) -> DataFrame:
    return docs.select(id_column, text).orderBy(F.col(id_column).desc()).limit(limit)


def constant(spark: SparkSession, n: int, **columns) -> DataFrame:
    """n rows of the same values, with a gapless id."""
    return spark.range(n).select("id", *[F.lit(v).alias(k) for k, v in columns.items()])


def ones(spark: SparkSession, *shape: int, value: float = 1.0) -> DataFrame:
    """A vector (id, v) or a matrix (i, j, v)."""
    if len(shape) == 1:
        return spark.range(shape[0]).select("id", F.lit(value).alias("v"))
    if len(shape) != 2:
        raise NotImplementedError("one or two dimensions")
    n = shape[1]
    return spark.range(shape[0] * n).select(F.expr(f"cast(id div {n} AS int)").alias("i"), (F.col("id") % n).cast("int").alias("j"), F.lit(value).alias("v"))


def zeros(spark: SparkSession, *shape: int) -> DataFrame:
    return ones(spark, *shape, value=0.0)


# Physical constants of the n-body workload (SI units).
GRAVITY, YEAR, LIGHT_YEAR, SUN = 6.67384e-11, 60 * 60 * 24 * 365.25, 9.4607e15, 1.9891e30


def galaxy(spark: SparkSession, n: int) -> DataFrame:
    """n bodies on a diagonal at rest: id, m, x, y, z, vx, vy, vz."""
    step = F.col("id") / float(n)
    place = ((step - 0.5) * (LIGHT_YEAR / 100)).alias
    return spark.range(n).select("id", ((step + 10.0) * (SUN / 10)).alias("m"), place("x"), place("y"), place("z"), *[F.lit(0.0).alias(c) for c in ("vx", "vy", "vz")])


def still_water(spark: SparkSession, n: int) -> DataFrame:
    """An n x n grid whose level rises by 0.1 a row: i, j, eta, u, v."""
    return ones(spark, n, n).select("i", "j", (0.1 * F.col("i")).alias("eta"), F.lit(0.0).alias("u"), F.lit(0.0).alias("v"))


def pixels(spark: SparkSession, images: int, height: int, width: int) -> DataFrame:
    """Synthetic images: smooth ramps with a pattern, channels 0 to 1."""
    at = spark.range(images * height * width)
    at = at.selectExpr(f"cast(id div {height * width} AS int) AS image_id", f"cast(id div {width} % {height} AS int) AS y", f"cast(id % {width} AS int) AS x")
    return at.select("image_id", "y", "x", ((F.col("x") * 7 + F.col("image_id")) % 256 / 255.0).alias("r"), ((F.col("y") * 5 + F.col("x")) % 256 / 255.0).alias("g"), ((F.col("x") + F.col("y") * 3) % 256 / 255.0).alias("b"))


def replicate(df: DataFrame, times: int, once: str = "false") -> DataFrame:
    """Each row `times` times, but once where the condition holds (the first line of a file, say)."""
    n = F.when(F.expr(once), F.lit(1)).otherwise(F.lit(times))
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), n)))


def replicate_years(df: DataFrame, times: int, first_year: int) -> DataFrame:
    """Each row `times` times, in years from first_year on, its sex alternating with the copy."""
    out = replicate(df, times)
    return out.withColumn("year", F.lit(first_year) + F.col("copy") - 1).withColumn("sex", F.when(F.col("copy") % 2 == 0, "F").otherwise("M"))


def from_pandas(spark: SparkSession, frame, schema: str | None = None) -> DataFrame:
    return spark.createDataFrame(frame, schema) if schema else spark.createDataFrame(frame)


def to_pandas(df: DataFrame):
    """The result on the driver; for results that are known to be small."""
    return df.toPandas()


def save(df: DataFrame, path: str, kind: str = "parquet", **options) -> None:
    df.write.mode("overwrite").format(kind).options(**options).save(path)


def show_head(df: DataFrame, n: int = 5) -> None:
    df.limit(n).show(truncate=False)


def states(first: DataFrame, step, every: int = 5) -> Iterator[DataFrame]:
    """first, step(first), step(step(first)), ... without end; lineage is cut by a checkpoint every few steps."""
    n = 0
    while True:
        yield first
        n += 1
        first = step(first)
        if n % every == 0:
            first = checkpointed(first)


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that spark.checkpoint.dir names, or in a local one where it is unset and Spark runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="larkspan-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/larkspan-{uuid.uuid4().hex}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder, which the cluster names in spark.checkpoint.dir; a local one where it names none."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch(df.sparkSession))
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all cores if its files, by their size, make scan tasks for less than a quarter of the cores; else as it is.

    For work that takes much longer than moving the rows.
    """
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if 4 * size < split * cores else df
