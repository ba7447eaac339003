"""A keyed table in versions: upserts rewrite the buckets that they touch and become visible at once.

    data/v=3/bucket=5/...    rows of bucket 5 as of version 3
    manifest/v=3/...         one small file: for each bucket the version that holds it, and the batch that wrote this version

An upsert reads the buckets of its keys, merges, writes them under the next version, and writes the manifest last. A reader takes the newest manifest; a run
that ends before its manifest is there leaves the old version, and the next one overwrites what it had written. The last batch id of
each writer is in the manifest, so a batch that is replayed after its commit changes nothing. One writer at a time; any number of readers.

Rows with a null key are one key. Of rows of one key the first in `order` stays. A table without a manifest is empty.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .store import stored_before

MANIFEST = "bucket int, version long, writer string, batch long"
NO_BUCKET = -1


@dataclass
class KeyedTable:
    """`order` ranks the rows of a key; `bloom` names columns whose Parquet files get bloom filters, for lookups by value."""

    spark: SparkSession
    path: str
    schema: T.StructType
    keys: tuple[str, ...]
    order: tuple[Column | str, ...]
    buckets: int = 16
    bloom: tuple[str, ...] = ()

    def manifest(self) -> tuple[int, dict[int, int], dict[str, int]]:
        """Newest version (-1 if none), version by bucket, last batch by writer."""
        at = f"{self.path}/manifest"
        if not stored_before(self.spark, at):
            return -1, {}, {}
        all_versions = self.spark.read.schema(MANIFEST + ", v long").option("basePath", at).json(at)
        newest = all_versions.agg(F.max("v")).first()[0]
        rows = all_versions.where(F.col("v") == newest).collect()  # a row per bucket and writer
        return (-1 if newest is None else newest, {r.bucket: r.version for r in rows if r.bucket != NO_BUCKET}, {r.writer: r.batch for r in rows if r.bucket == NO_BUCKET})

    def _folders(self, held: dict[int, int]) -> DataFrame:
        if not held:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/v={v}/bucket={b}" for b, v in sorted(held.items())])

    def read(self) -> DataFrame:
        return self._folders(self.manifest()[1])

    def lookup(self, column: str, values: list) -> DataFrame:
        """Rows with one of a few values; bloom filters leave out row groups that hold none of them, buckets those that cannot."""
        held = self.manifest()[1]
        if (column,) == self.keys:
            some = self.spark.createDataFrame([(v,) for v in values], T.StructType([self.schema[column]]))
            wanted = {r.b for r in some.select(self._bucket().alias("b")).distinct().collect()}
            held = {b: v for b, v in held.items() if b in wanted}
        return self._folders(held).where(F.col(column).isin(values))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def merge(self, rows: DataFrame) -> DataFrame:
        w = Window.partitionBy("bucket", *self.keys).orderBy(*self.order)
        return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")

    def stage(self, new: DataFrame, version: int, held: dict[int, int]) -> list[int]:
        """Writes the touched buckets under `version`, merged with what they hold; no reader sees them yet."""
        names = [f.name for f in self.schema]
        fresh = materialize(self.merge(new.select(*names).withColumn("bucket", self._bucket())), "upsert")
        touched = sorted(r.bucket for r in fresh.select("bucket").distinct().collect())
        old = self._folders({b: v for b, v in held.items() if b in touched}).withColumn("bucket", self._bucket())
        out = self.merge(old.unionByName(fresh)).hint("rebalance", F.col("bucket")).write.mode("overwrite").partitionBy("bucket")
        for column in self.bloom:
            out = out.option(f"parquet.bloom.filter.enabled#{column}", "true")
        out.parquet(f"{self.path}/data/v={version}")
        return touched

    def upsert(self, new: DataFrame, batch: int | None = None, writer: str = "stream") -> bool:
        """Puts rows in; False if this batch of this writer is in already."""
        version, held, batches = self.manifest()
        if batch is not None and batches.get(writer, -1) >= batch:
            return False
        touched = self.stage(new, version + 1, held)
        held = {**held, **dict.fromkeys(touched, version + 1)}
        if batch is not None:
            batches = {**batches, writer: batch}
        rows = [(b, v, None, None) for b, v in held.items()] + [(NO_BUCKET, None, w, n) for w, n in batches.items()]
        # One file, put in place by one rename.
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").json(f"{self.path}/manifest/v={version + 1}")
        return True

    def vacuum(self) -> int:
        """Deletes folders that the newest version does not use; for times when no reader is on an older one. Returns how many."""
        version, held, _ = self.manifest()
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        gone = 0
        for top, used in (("data", {f"v={v}/bucket={b}" for b, v in held.items()}), ("manifest", {f"v={version}"})):
            root = hadoop(f"{self.path}/{top}")
            fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
            depth = "*/bucket=*" if top == "data" else "v=*"
            for found in fs.globStatus(hadoop(root, depth)) or []:
                at = found.getPath()
                name = f"{at.getParent().getName()}/{at.getName()}" if top == "data" else at.getName()
                if name not in used:
                    fs.delete(at, True)
                    gone += 1
        return gone


def report_table(spark: SparkSession, path: str, schema: T.StructType, buckets: int = 16) -> KeyedTable:
    """Reports by company and year; of two the one processed last stays."""
    return KeyedTable(spark, path, schema, ("company", "year"), (F.desc("processed_at"), "document_id"), buckets)


def chunk_table(spark: SparkSession, path: str, schema: T.StructType, buckets: int = 16) -> KeyedTable:
    """Chunks by digest, with bloom filters on it."""
    return KeyedTable(spark, path, schema, ("chunk_id",), ("document_id", "page", "chunk_index"), buckets, ("chunk_id",))
