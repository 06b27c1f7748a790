"""Exact duplicates by stateful streaming, with DataFrame functions only.

Two streams read what has landed and stop when they have caught up. The first gives each row its digest
and its locator (file and row in it) and appends these to a log; texts go nowhere. The second keeps one state entry
for each digest: the stable identifier that stays (the largest id) with its locator, the locator of the first
content seen, and the number of rows. State lies in RocksDB on the executors' disks, its changes in the
checkpoint folder, and it never expires, so a row meets its copy whenever that came. Rows of one digest are
aggregated in each task before they are shuffled, so a hot text is a few rows.

A hit is a digest with more than one row. All rows of a hit are checked by their full bytes: the files that hold
new rows or the hit's first content are read again, a bitmap filter picks the hits' rows (key_filter), and
these are grouped by digest and text, equal ones first within each task. A digest with several texts is
written down as a collision; its rows are then told apart by their texts instead of the state.

A run that was cut off is taken up again: logs and state are exactly-once, a repeated batch overwrites its
own folder, and hits count as checked when their run is marked at its end.

Defined cases: null text is the empty text; null ids lose against others, and of rows with one id or with null ids
only the one with the largest locator stays; texts of any length are hashed and compared whole; no rows give
no rows; columns other than the id and the text aren't read, whatever their names.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.common import shared_path, written
from waymark.llm.key_filter import passing

#: Settings of the stream with state: on disk, with a bound for memory, changes instead of whole copies; no space reserved ahead, 4 MB for each partition.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}
_LOG = "doc_id bigint, digest binary, file string, row bigint, run int"
_ENTRY = "digest binary, keep struct<doc_id: bigint, file: string, row: bigint>, first struct<run: int, file: string, row: bigint>, n bigint"


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


class StreamingDedup:
    """Exact duplicates of all that ingest() has read; path: a folder that driver and executors share.

    digest: of a text (Column to a binary Column); collisions are found and resolved, so a shorter one only costs time.
    """

    def __init__(self, spark: SparkSession, path: str, digest=sha256):
        self.spark, self.path, self.digest = spark, path.rstrip("/"), digest

    def _table(self, name: str, schema: str) -> DataFrame:
        """A table of batches (run, batch), with no rows at first."""
        path = f"{self.path}/{name}"
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            self.spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/run=-1/batch=-1")
        return self.spark.read.schema(f"{schema}, run int, batch int").parquet(path)

    @property
    def log(self) -> DataFrame:
        """doc_id, digest, file, row, run of all rows."""
        return self.spark.read.schema(_LOG).parquet(f"{self.path}/log")

    def ingest(self, source: str, id_col: str = "doc_id", text_col: str = "text", files_per_batch: int | None = None) -> None:
        """Reads the Parquet files at source (a folder or pattern) that weren't read before, and checks the hits."""
        done = self._table("checked", "texts bigint").agg(F.max("run")).first()[0]
        run = 0 if done is None else done + 1
        self._table("changes", _ENTRY)
        self._read(source, run, id_col, text_col, files_per_batch)
        self._keep(run)
        self._check(run, id_col, text_col)

    def _rows(self, reader, id_col: str, text_col: str, *paths: str) -> DataFrame:
        rows = reader.schema(f"`{id_col}` bigint, `{text_col}` string").parquet(*paths)
        text = F.coalesce(rows[text_col], F.lit(""))
        return rows.select(rows[id_col].alias("doc_id"), text.alias("text"), self.digest(text).alias("digest"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))

    def _read(self, source: str, run: int, id_col: str, text_col: str, files_per_batch: int | None) -> None:
        reader = self.spark.readStream
        if files_per_batch:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)
        rows = self._rows(reader, id_col, text_col, source).select("doc_id", "digest", "file", "row", F.lit(run).alias("run"))
        sink = rows.writeStream.format("parquet").option("compression", "zstd").option("checkpointLocation", f"{self.path}/log-checkpoint")
        sink.trigger(availableNow=True).start(f"{self.path}/log").awaitTermination()

    def _keep(self, run: int) -> None:
        """Takes the log's new rows into the state and writes the entries that changed."""
        before = {k: self.spark.conf.get(k, None) for k in STATE}
        for k, v in STATE.items():
            self.spark.conf.set(k, v)
        try:
            rows = self.spark.readStream.schema(_LOG).parquet(f"{self.path}/log")
            keep, first = F.max(F.struct("doc_id", "file", "row")), F.min(F.struct("run", "file", "row"))
            state = rows.groupBy("digest").agg(keep.alias("keep"), first.alias("first"), F.count(F.lit(1)).alias("n"))

            def changed(batch: DataFrame, number: int) -> None:
                batch.write.mode("overwrite").parquet(f"{self.path}/changes/run={run}/batch={number}")

            sink = state.writeStream.outputMode("update").foreachBatch(changed).option("checkpointLocation", f"{self.path}/state")
            sink.trigger(availableNow=True).start().awaitTermination()
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)

    def _check(self, run: int, id_col: str, text_col: str) -> None:
        """Compares the full bytes of the hits that this run touched."""
        hits = written(_latest(self._table("changes", _ENTRY).where(F.col("run") == run)).where("n > 1"), "hits")
        files = self.log.where(F.col("run") == run).select("file").union(hits.where(F.col("first.run") < run).select("first.file")).distinct()
        paths = [unquote(r.file) for r in files.collect()]  # file names, as Spark's reader lists them too
        texts = hits.select("digest", F.lit(0).cast("bigint").alias("texts")).limit(0)
        if paths and not hits.isEmpty():
            rows = self._rows(self.spark.read, id_col, text_col, *paths).select("digest", "text")
            rows = passing(rows, F.xxhash64("digest"), hits.select(F.xxhash64("digest").alias("key")))
            texts = rows.groupBy("digest", "text").agg(F.count(F.lit(1)).alias("n")).groupBy("digest").agg(F.count(F.lit(1)).alias("texts"))
        self._table("collisions", "digest binary, texts bigint")
        texts.where("texts > 1").write.mode("overwrite").parquet(f"{self.path}/collisions/run={run}/batch=0")
        self.spark.range(1).select(F.lit(0).cast("bigint").alias("texts")).write.mode("overwrite").parquet(f"{self.path}/checked/run={run}/batch=0")

    def classes(self) -> DataFrame:
        """digest, keep, first, n of each digest: the state's entries."""
        return _latest(self._table("changes", _ENTRY))

    def collisions(self) -> DataFrame:
        """Digests of which several texts were seen."""
        return self._table("collisions", "digest binary, texts bigint").select("digest").distinct()

    def members(self, source: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id, keep_id, group_size, kept and digest of each row. source is read only where there are collisions."""
        classes, log = written(self.classes(), "classes"), self.log
        collided = written(self.collisions(), "collided")
        if not collided.isEmpty():
            rows = self._rows(self.spark.read, id_col, text_col, source).join(collided, "digest", "left_semi")
            keep = F.max(F.struct("doc_id", "file", "row"))
            by_text = written(rows.groupBy("digest", "text").agg(keep.alias("keep"), F.count(F.lit(1)).alias("n")), "by-text")
            told = _judged(rows.join(by_text, ["digest", "text"]))
            log = log.join(collided, "digest", "left_anti")
            return _judged(log.join(classes, "digest")).unionByName(told)
        return _judged(log.join(classes, "digest"))


def _latest(changes: DataFrame) -> DataFrame:
    """The entry of each digest with the most rows; entries only grow."""
    last = changes.groupBy("digest").agg(F.max_by(F.struct("keep", "first", "n"), "n").alias("e"))
    return last.select("digest", "e.keep", "e.first", "e.n")


def _judged(rows: DataFrame) -> DataFrame:
    kept = (F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row"))
    return rows.select("doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"), "digest")


def op11_exact_dedup(spark, sf_dir: str) -> DataFrame:
    source = f"{sf_dir}/documents.parque[t]"  # a pattern, since a stream's source is a folder or a pattern, and the table may be one file
    dedup = StreamingDedup(spark, shared_path(spark, "exact-dedup"))
    dedup.ingest(source)
    return dedup.members(source).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


#: DuckDB SQL with the same rows.
OP11_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
