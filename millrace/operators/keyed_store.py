"""A keyed table in hash buckets: a batch reads and rewrites only the buckets its keys fall into.

Layout below the table's path::

    data/<write>/store_bucket=<n>/…   the rows of bucket n as one write left them
    manifest/version=<v>/…            one row per bucket in use: where its rows are, how many, and the last batch applied

A write first puts the new rows of the touched buckets into a folder of its own and then adds the next manifest, one
file, which is what makes them part of the table. Until then, and whenever a job fails in between, readers see the
version before. Files of other buckets are neither read nor written. Two writers of one version cannot both succeed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.upsert import apply_changes, upsert
from millrace.session import delete_path, list_names

MANIFEST = "bucket int, folder string, rows long, buckets int, batch long"
#: The manifest's row for the table itself: how many buckets it has and the last batch, also where no bucket has rows.
HEAD = -1
PART = "store_bucket"


class KeyedStore:
    """A table of unique keys, changed by batches.

    ``buckets`` is fixed when the table is made: choose it so that a bucket is some hundred MB. A batch is counted by
    ``batch_id`` where one is given: a batch at or below the last applied one changes nothing, so a stream may hand a
    batch in again.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, keys: list[str]) -> None:
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self.schema = spark.createDataFrame([], schema).schema

    @classmethod
    def create(cls, base: DataFrame, path: str, keys: list[str], buckets: int = 64) -> KeyedStore:
        """Store ``base`` in a new folder. Rows that share a key are an error; rows with a null in it are kept as they are."""
        store = cls(base.sparkSession, path, base.schema, keys)
        if list_names(store.spark, f"{store.path}/manifest"):
            raise ValueError(f"there is a table at {path}")
        known = [F.col(f"`{k}`").isNotNull() for k in keys]
        if not base.where(_all(known)).groupBy(*keys).count().where("count > 1").isEmpty():
            raise ValueError(f"rows of the table share a key of {keys}")
        store._write(base, None, buckets, 0, None)
        return store

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*(F.col(f"`{k}`") for k in self.keys)), F.lit(buckets)).cast("int")

    def versions(self) -> list[int]:
        """Complete versions, in order."""
        names = list_names(self.spark, f"{self.path}/manifest")
        found = sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version="))
        return [v for v in found if "_SUCCESS" in list_names(self.spark, f"{self.path}/manifest/version={v}")]

    def manifest(self, version: int | None = None) -> dict[int, dict]:
        """Bucket: where its rows are. As many entries as there are buckets, however large the table."""
        version = self.versions()[-1] if version is None else version
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/version={version}").collect()
        return {row["bucket"]: row.asDict() for row in rows}

    def _rows(self, manifest: dict[int, dict], wanted: set[int] | None = None) -> DataFrame:
        chosen = [e for b, e in manifest.items() if b != HEAD and (wanted is None or b in wanted)]
        paths = [f"{self.path}/data/{e['folder']}/{PART}={e['bucket']}" for e in chosen]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self, version: int | None = None) -> DataFrame:
        """The whole table, as of the last version or an earlier one that is still there."""
        return self._rows(self.manifest(version))

    def touched(self, batch: DataFrame, manifest: dict[int, dict] | None = None) -> set[int]:
        """The buckets that hold the keys of ``batch``."""
        buckets = (manifest or self.manifest())[HEAD]["buckets"]
        return {row[0] for row in batch.select(self._bucket(buckets)).distinct().collect()}

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows whose keys are in ``keys``; other buckets are not read."""
        manifest = self.manifest()
        wanted = keys.select(*self.keys).distinct()
        return self._rows(manifest, self.touched(wanted, manifest)).join(wanted, self.keys, "left_semi")

    def upsert(self, batch: DataFrame, precombine: list[str], compare_with_base: bool = False, batch_id: int | None = None) -> set[int]:
        """Put the rows of ``batch`` in by key, as ``upsert.upsert`` does. Returns the buckets rewritten."""
        return self._merge(batch, lambda base: upsert(base, batch, self.keys, precombine, compare_with_base), batch_id)

    def apply(self, changes: DataFrame, order: list[str], batch_id: int | None = None) -> set[int]:
        """Inserts, updates and deletes, as ``upsert.apply_changes`` does. Returns the buckets rewritten."""
        return self._merge(changes, lambda base: apply_changes(base, changes, self.keys, order), batch_id)

    def _merge(self, batch: DataFrame, merge: Callable[[DataFrame], DataFrame], batch_id: int | None) -> set[int]:
        version = self.versions()[-1]
        manifest = self.manifest(version)
        head = manifest[HEAD]
        if batch_id is not None and batch_id <= head["batch"]:
            return set()
        wanted = self.touched(batch, manifest)
        others = {b: e for b, e in manifest.items() if b not in wanted and b != HEAD}
        rows = merge(self._rows(manifest, wanted)) if wanted else None
        self._write(rows, others, head["buckets"], version + 1, batch_id if batch_id is not None else head["batch"])
        return wanted

    def _write(self, rows: DataFrame | None, others: dict[int, dict] | None, buckets: int, version: int, batch: int | None) -> None:
        folder = f"{version}-{uuid.uuid4().hex}"
        entries = [{**e, "buckets": buckets, "batch": None} for e in (others or {}).values()]
        if rows is not None:
            # One task per bucket: keys are unique, so no bucket is hot.
            dealt = rows.withColumn(PART, self._bucket(buckets)).repartition(buckets, PART)
            dealt.write.partitionBy(PART).parquet(f"{self.path}/data/{folder}")
            if any(n.startswith(f"{PART}=") for n in list_names(self.spark, f"{self.path}/data/{folder}")):
                kept = self.spark.read.schema(f"{PART} int").parquet(f"{self.path}/data/{folder}")
                counts = kept.groupBy(PART).count().collect()
                entries += [{"bucket": r[PART], "folder": folder, "rows": r["count"], "buckets": buckets, "batch": None} for r in counts]
        total = sum(e["rows"] for e in entries)
        entries.append({"bucket": HEAD, "folder": None, "rows": total, "buckets": buckets, "batch": -1 if batch is None else batch})
        table = self.spark.createDataFrame([tuple(e[c] for c in ("bucket", "folder", "rows", "buckets", "batch")) for e in entries], MANIFEST)
        table.coalesce(1).write.parquet(f"{self.path}/manifest/version={version}")

    def expire(self, keep: int = 2) -> list[str]:
        """Delete all versions but the last ``keep`` and the data folders only they used; returns these folders.

        Folders of writes that failed go too, so run it while nobody writes.
        """
        versions = self.versions()
        held = {e["folder"] for v in versions[-keep:] for e in self.manifest(v).values()}
        for version in versions[:-keep]:
            delete_path(self.spark, f"{self.path}/manifest/version={version}")
        gone = [n for n in list_names(self.spark, f"{self.path}/data") if n not in held]
        for name in gone:
            delete_path(self.spark, f"{self.path}/data/{name}")
        return gone


def _all(conditions: list[Column]) -> Column:
    found = F.lit(True)
    for condition in conditions:
        found = found & condition
    return found
