"""Shared helpers: input tables, the cluster's shared folder, words and crc32 folds."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: U+0020 and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch: texts come to Python in batches of about that size, so that neither side holds a whole partition.
BATCH_BYTES = "8m"


def bounded_batches(spark: SparkSession) -> None:
    """Sets the bytes of an Arrow batch for the session, unless its user has set them."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if name not in spark.conf.getAll:
        spark.conf.set(name, BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a local session gets a temporary one (tests); a cluster must set it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        atexit.register(shutil.rmtree, folder, True)
        base = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A path of its own for each call, so that reruns and concurrent jobs don't meet."""
    return f"{shared_dir(spark)}/waymark/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """df written to the shared folder and read back: cuts lineage and survives lost executors. What is read later stays there; see forgotten()."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forgotten(df: DataFrame) -> None:
    """Deletes the folder of a table made by written() that nothing reads any more."""
    spark = df.sparkSession
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        if folder.startswith(f"{shared_dir(spark)}/waymark/") or folder.replace("file:///", "file:/").startswith(f"{shared_dir(spark)}/waymark/".replace("file:///", "file:/")):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def words(text: Column) -> Column:
    """Array of maximal runs of characters other than BLANKS; null and blank texts have none."""
    none = F.array().cast("array<string>")
    return let(trimmed(F.coalesce(text, F.lit(""))), lambda t: F.when(t == "", none).otherwise(F.split(t, "[\\x20\\x09-\\x0D]+")))


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def id_crc(doc_id: Column) -> Column:
    """crc32 of the id's decimal text; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once for the row."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def small(spark: SparkSession, rows: list[tuple], schema: str, limit: int = 20_000) -> DataFrame:
    """Rows made on the driver, marked for broadcast only up to limit rows."""
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= limit else df
