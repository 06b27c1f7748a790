"""A table with a key in buckets, of which an upsert rewrites only those that it touches.

Rows lie in buckets by the hash of their key. An upsert stages its rows by bucket (they are computed once, and
the staged folders tell which buckets they touch), merges those buckets and writes them as new folders. A
manifest, one small JSON file, points to the folder of each bucket; writing it is the commit. Readers see the
manifest they began with; folders that none of the last manifests names are removed. A manifest also keeps
the schema, to which new columns are added (null in older rows), and the number of each stream's last batch, so that a
batch that is run again changes nothing. One writer at a time.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from waymark.operators.upsert import latest, merge

BUCKET = "__bucket"


class KeyedTable:
    """The table at path with a row for each key; buckets: their number, fixed when the table is made. rules: as in upsert.merge."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64, rules: dict[str, str] | None = None, keep: int = 2):
        self.spark, self.path, self.keys, self.buckets, self.rules, self.keep = spark, path.rstrip("/"), keys, buckets, rules or {}, keep

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self, folder: str) -> list[str]:
        fs, path = self._at(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def _load(self, name: str) -> dict:
        fs, path = self._at(f"manifests/{name}")
        stream = fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def manifest(self) -> dict | None:
        """version, schema, buckets (number to folder), batches (stream to its last number)."""
        names = self._names("manifests")
        return self._load(names[-1]) if names else None

    def _commit(self, manifest: dict) -> None:
        fs, path = self._at(f"manifests/{manifest['version']:012d}.json")
        stream = fs.create(path, False)  # fails if another writer was faster
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()

    def _tidy(self) -> None:
        names = self._names("manifests")
        used = {f.split("/")[0] for n in names[-self.keep :] for f in self._load(n)["buckets"].values()}
        for n in names[: -self.keep]:
            self._remove(f"manifests/{n}")
        for folder in self._names("data"):
            if folder not in used:
                self._remove(f"data/{folder}")

    def _remove(self, name: str) -> None:
        fs, path = self._at(name)
        fs.delete(path, True)

    def _rows(self, manifest: dict, numbers: list[str]) -> DataFrame:
        schema = StructType.fromJson(manifest["schema"])
        folders = [f"{self.path}/data/{manifest['buckets'][n]}" for n in numbers if n in manifest["buckets"]]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame | None:
        """All rows, None before the first write."""
        manifest = self.manifest()
        return manifest and self._rows(manifest, list(manifest["buckets"]))

    def create(self, schema: str) -> None:
        """The table without rows."""
        kinds = self.spark.createDataFrame([], schema).schema
        self._commit({"version": 0, "n_buckets": self.buckets, "schema": kinds.jsonValue(), "buckets": {}, "batches": {}})

    def _number(self, n_buckets: int):
        return F.pmod(F.xxhash64(*self.keys), F.lit(n_buckets)).cast("int")

    def rows_of(self, keys: DataFrame) -> DataFrame:
        """The rows of the buckets in which keys (rows with the key's columns) lie: these keys' rows and some others."""
        manifest = self.manifest()
        kinds = {f.name: f.dataType for f in StructType.fromJson(manifest["schema"])}
        numbers = keys.select(*[F.col(k).cast(kinds[k]) for k in self.keys]).select(self._number(manifest["n_buckets"]).alias("n")).distinct()
        return self._rows(manifest, [str(r.n) for r in numbers.collect()])  # n_buckets numbers at most

    def upsert(self, source: DataFrame, keys: list[str] | None = None, rules: dict[str, str] | None = None, order: str | None = None, batch: tuple[str, int] | None = None) -> list[int]:
        """Merges source's rows by key; returns the buckets that were rewritten.

        Of rows with one key that with the largest order wins (a column whose name begins with __ isn't stored). batch: a
        stream's name and the number of its batch; one that was committed before is left out.
        """
        if keys is not None and keys != self.keys:
            raise ValueError(f"the table's key is {self.keys}")
        manifest = self.manifest()
        version = manifest["version"] + 1 if manifest else 0
        buckets = manifest["n_buckets"] if manifest else self.buckets
        if batch and manifest and manifest["batches"].get(batch[0], -1) >= batch[1]:
            return []
        schema = StructType.fromJson(manifest["schema"]) if manifest else StructType()
        kinds = {f.name: f.dataType for f in schema}
        new = source.select(*[F.col(c).cast(kinds[c]) if c in kinds else F.col(c) for c in source.columns])
        new = latest(new, self.keys, order)
        new = new.drop(*([order] if order and order.startswith("__") else []))
        for f in new.schema:
            if f.name not in kinds:
                schema = schema.add(f.name, f.dataType)
        staged, folder = f"staged-{version:012d}", f"v{version:012d}"
        self._remove(f"data/{staged}")
        self._remove(f"data/{folder}")  # of a run that was cut off before its commit
        number = self._number(buckets)
        new.withColumn(BUCKET, number).repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/data/{staged}")
        touched = sorted(int(n.split("=")[1]) for n in self._names(f"data/{staged}") if n.startswith(BUCKET))
        new_rows = self.spark.read.schema(new.schema).parquet(*[f"{self.path}/data/{staged}/{BUCKET}={n}" for n in touched]) if touched else None
        if manifest and not touched and not batch:
            self._remove(f"data/{staged}")
            return []
        pointers = dict(manifest["buckets"]) if manifest else {}
        if touched:
            if manifest:
                old = self._rows({**manifest, "schema": schema.jsonValue()}, [str(n) for n in touched])
                rows = merge(old, new_rows, self.keys, {**self.rules, **(rules or {})})
            else:
                rows = new_rows
            rows.withColumn(BUCKET, number).repartition(len(touched), BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/data/{folder}")
            pointers |= {str(n): f"{folder}/{BUCKET}={n}" for n in touched}
        batches = dict(manifest["batches"]) if manifest else {}
        if batch:
            batches[batch[0]] = batch[1]
        self._commit({"version": version, "n_buckets": buckets, "schema": schema.jsonValue(), "buckets": pointers, "batches": batches})
        self._tidy()
        return touched
