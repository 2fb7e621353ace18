"""Tables in versions: buckets by key, written beside the old ones, and a manifest that is put there last.

    <path>/data/<write>/bucket=<n>/*.parquet     what one write made, changed buckets only
    <path>/manifests/<version>.json              which folder holds which bucket in that version

A reader takes one manifest and sees that version whole, whatever is written
meanwhile; a write that dies leaves folders that no manifest names, and the
version before stays the last. What a write costs grows with the buckets that
it changes, not with the table.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another write has made the version that this one was to make."""


class VersionedTable:
    """Rows dealt to `buckets` buckets by the hash of `keys`; both must stay as they were when the table began.

    Rows of format 0, 1, ... are read through `upgrades`: the n-th function
    makes rows of format n + 1 from those of format n. Buckets are written in
    the newest format, so old rows move on as their buckets change.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64, upgrades: tuple[Callable[[DataFrame], DataFrame], ...] = ()):
        self.spark, self.path, self.keys, self.buckets, self.upgrades = spark, path.rstrip("/"), keys, buckets, upgrades
        self._hadoop = spark._jvm.org.apache.hadoop.fs

    # files

    def _at(self, name: str):
        path = self._hadoop.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def versions(self) -> list[int]:
        """All versions that can be read, oldest first."""
        fs, folder = self._at("manifests")
        if not fs.exists(folder):
            return []
        names = (s.getPath().getName() for s in fs.listStatus(folder))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict | None:
        """The manifest of a version, by default the last; None: there is none."""
        known = self.versions()
        version = known[-1] if version is None and known else version
        if version not in known:
            return None
        fs, path = self._at(f"manifests/{version:012d}.json")
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        """The one step that makes a version: a rename that fails if the version is there already."""
        fs, path = self._at(f"manifests/{manifest['version']:012d}.json")
        _, draft = self._at(f"manifests/draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if fs.exists(path) or not fs.rename(draft, path):
            fs.delete(draft, False)
            raise Conflict(f"version {manifest['version']} of {self.path} exists")

    # rows

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _rows(self, manifest: dict, only: set[int] | None = None) -> DataFrame | None:
        """The rows of a manifest's buckets in the newest format; None: no bucket is asked for."""
        kinds: dict[tuple, list[str]] = {}
        for number, folder in manifest["buckets"].items():
            if only is None or int(number) in only:
                made = manifest["writes"][folder]
                kinds.setdefault((made["format"], json.dumps(made["schema"], sort_keys=True)), []).append(f"{self.path}/data/{folder}/bucket={number}")
        out = None
        for (form, schema), folders in sorted(kinds.items()):
            rows = self.spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(*folders)
            for upgrade in self.upgrades[form:]:
                rows = upgrade(rows)
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        return out

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default the last. A version that is not there, or no longer, is an error."""
        manifest = self.manifest(version)
        if manifest is None:
            raise ValueError(f"{self.path} has no version" + (f" {version}" if version is not None else ""))
        rows = self._rows(manifest)
        return self.spark.createDataFrame([], StructType.fromJson(manifest["schema"])) if rows is None else rows

    def write(self, changes: DataFrame, merge: Callable[[DataFrame | None, DataFrame], DataFrame], mark: str | None = None) -> int:
        """A new version in which the buckets of `changes` hold merge(their rows or None, changes); returns its number.

        Rows that merge makes must stay in the buckets that it was given. A
        `mark` that the last version has already is not written again, so a
        step that is repeated after a failure changes nothing. `changes` is
        read twice: once for its buckets and once to be merged.
        """
        last = self.manifest() or {"version": -1, "buckets": {}, "writes": {}, "mark": None}
        if mark is not None and last["mark"] == mark:
            return last["version"]
        touched = {r["b"] for r in changes.select(self.bucket().alias("b")).distinct().collect()}  # as many as there are buckets, at most
        old = self._rows(last, touched)
        rows = merge(old, changes)
        folder = f"{last['version'] + 1:012d}-{uuid.uuid4().hex[:8]}"
        # by key and not by bucket alone: a task sorts what it is dealt, and buckets are few however much they hold
        rows.withColumn("bucket", self.bucket()).repartition("bucket", *self.keys).write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
        fs, made = self._at(f"data/{folder}")
        full = {int(s.getPath().getName().partition("=")[2]) for s in fs.listStatus(made) if s.getPath().getName().startswith("bucket=")}
        if stray := full - touched:
            raise ValueError(f"rows left their buckets: {sorted(stray)[:5]}")
        buckets = {b: f for b, f in last["buckets"].items() if int(b) not in touched} | {str(b): folder for b in sorted(full)}
        schema = rows.schema.jsonValue()
        writes = {f: w for f, w in last["writes"].items() if f in buckets.values()} | ({folder: {"schema": schema, "format": len(self.upgrades)}} if full else {})
        self._publish({"version": last["version"] + 1, "buckets": buckets, "writes": writes, "schema": schema, "mark": mark, "touched": len(touched)})
        return last["version"] + 1

    def vacuum(self, keep: int = 2) -> int:
        """Deletes all versions but the last `keep`, and folders that none of these needs; returns how many folders.

        Not to be run while another process writes: its folder has no manifest yet.
        """
        known = self.versions()
        stay = [self.manifest(v) for v in known[-keep:]]
        for v in known[:-keep]:
            fs, path = self._at(f"manifests/{v:012d}.json")
            fs.delete(path, False)
        needed = {f for m in stay for f in m["buckets"].values()}
        fs, folder = self._at("data")
        gone = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName() not in needed] if fs.exists(folder) else []
        for path in gone:
            fs.delete(path, True)
        return len(gone)


def by_key(keys: list[str], values: Callable[[str], Column] | None = None) -> Callable[[DataFrame | None, DataFrame], DataFrame]:
    """A merge in which the rows of changed keys replace all old rows of these keys."""

    def merge(old: DataFrame | None, new: DataFrame) -> DataFrame:
        if old is None:
            return new
        on = [old[k].eqNullSafe(new_k) for k, new_k in ((k, F.col(f"_new.{k}")) for k in keys)]
        return old.join(new.select(*keys).distinct().alias("_new"), on, "left_anti").unionByName(new, allowMissingColumns=True)

    return merge
