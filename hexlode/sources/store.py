"""Datasets on disk: versions of Parquet tables, each behind a manifest that appears at once.

A commit writes its tables to a folder of its own, and then the manifest of the next revision, which must not exist yet: of two writers
that started from one revision the second gets Conflict and its folder goes, readers see the old version or the new. Checksums of a version are
a table, with a row for each file, made and compared by Spark: the driver opens manifests alone.
"""

from __future__ import annotations

import json
import re
import uuid
from datetime import datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.text import human_size
from .files import Conflict, Folder

__all__ = ["Conflict", "Store", "stores"]

KEEP = 3
_MANIFEST = re.compile(r"manifest-(\d{9})\.json")
_CHECKS = "checks"


def _hashed(t: T.DataType, name: str):
    """A column for hashing: maps and variants as JSON."""
    return F.to_json(F.struct(F.col(f"`{name}`"))) if any(k in t.simpleString() for k in ("map<", "variant")) else F.col(f"`{name}`")


class Store:
    """A folder of versions, anywhere that Spark can write."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.folder = spark, str(path), Folder(spark, path)

    # Manifests

    def revisions(self) -> list[int]:
        return [int(m[1]) for n in self.folder.names() if (m := _MANIFEST.fullmatch(n))]

    def initialize(self, metadata: dict | None = None) -> dict:
        self.folder.make()
        if not self.revisions():
            try:
                self._publish(0, {"version": 0, "created_at": _now(), "metadata": metadata or {}, "stats": {}, "folder": None})
            except Conflict:
                pass
        return self.manifest()

    def manifest(self, revision: int | None = None) -> dict:
        return json.loads(self.folder.read(f"manifest-{max(self.revisions()) if revision is None else revision:09d}.json"))

    def _publish(self, revision: int, manifest: dict) -> None:
        self.folder.write_new(f"manifest-{revision:09d}.json", json.dumps(manifest | {"revision": revision}, indent=1))

    def update_manifest(self, changes: dict, base: int | None = None) -> dict:
        """Changes merged into the manifest, dicts within dicts too; base as in save()."""
        old = self.manifest()
        self._publish((old["revision"] if base is None else base) + 1, _merged(old, changes))
        self._drop_old()
        return self.manifest()

    # Versions

    def save(self, base: int | None = None, changes: dict | None = None, **tables: DataFrame) -> int:
        """A new version of the tables, with changes to the manifest; old versions beyond KEEP go. base: the revision that the tables were made from; if another one has been published since, Conflict."""
        old = self.initialize()
        base = old["revision"] if base is None else base
        version = old["version"] + 1
        folder = f"v={version}-{uuid.uuid4().hex[:12]}"
        try:
            for name, df in tables.items():
                df.write.parquet(self.folder.of(f"{folder}/{name}"))
                self._checks(f"{folder}/{name}", df.schema).write.parquet(self.folder.of(f"{folder}/{_CHECKS}/{name}"))
            counts = {name: self.spark.read.parquet(self.folder.of(f"{folder}/{_CHECKS}/{name}")).agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0] for name in tables}
            self._publish(base + 1, _merged(old, changes or {}) | {"version": version, "updated_at": _now(), "stats": counts, "folder": folder})
        except BaseException:
            self.folder.delete(folder)
            raise
        self._drop_old()
        return version

    def _published(self) -> dict[int, dict]:
        """The latest manifest of each version that has tables."""
        return {m["version"]: m for m in map(self.manifest, self.revisions()) if m["folder"]}

    def _drop_old(self) -> None:
        """Old versions go, and manifests of theirs; a folder without a manifest is another writer's and stays."""
        published = self._published()
        kept = sorted(published)[-KEEP:]
        last = max(self.revisions())
        for r in self.revisions():
            m = self.manifest(r)
            if r < last and (m["version"] not in kept or published[m["version"]]["revision"] != r):
                self.folder.delete(f"manifest-{r:09d}.json")
        for v in published:
            if v not in kept:
                self.folder.delete(published[v]["folder"])

    def versions(self) -> list[int]:
        return sorted(self._published())

    # Integrity

    def _checks(self, table: str, schema: T.StructType) -> DataFrame:
        """(file, bytes, rows, digest) of a table's files; a digest doesn't depend on the order of rows."""
        df = self.spark.read.schema(schema).parquet(self.folder.of(table))
        row = F.xxhash64(*(_hashed(f.dataType, f.name) for f in schema.fields)) if schema.fields else F.lit(0).cast("long")
        each = df.select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("bytes"), row.alias("h"))
        return each.groupBy("file", "bytes").agg(F.count("*").alias("rows"), F.sum(F.col("h").cast("decimal(38,0)")).alias("digest"))

    def _whole(self, manifest: dict, name: str, deep: bool) -> bool:
        """Whether a table has the files of its checks, of their length; deep: and their contents."""
        table = f"{manifest['folder']}/{name}"
        try:
            known = self.spark.read.parquet(self.folder.of(f"{manifest['folder']}/{_CHECKS}/{name}"))
            if deep:
                found, keys = self._checks(table, self.spark.read.parquet(self.folder.of(table)).schema), ["file", "bytes", "rows", "digest"]
            else:
                listed = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(self.folder.of(table))
                found, keys = listed.select(F.regexp_extract("path", "[^/]*$", 0).alias("file"), F.col("length").alias("bytes")), ["file", "bytes"]
            # empty files have no rows, and so no check
            return known.join(found, keys, "left_anti").isEmpty()
        except (PySparkException, Py4JJavaError):  # missing, or not readable as Parquet
            return False

    def intact(self, version: int | None = None) -> bool:
        """Whether a version's files, the published one's if none is given, have the contents that were written."""
        m = self.manifest() if version is None else self._published()[version]
        return all(self._whole(m, name, True) for name in m["stats"])

    def load(self, name: str, deep: bool = False) -> DataFrame:
        """A table of the published version, or of the newest older one where files are missing or cut short (deep: or altered)."""
        versions = self._published()
        newest = max(versions, default=0)
        for v in sorted(versions, reverse=True):
            if name in versions[v]["stats"] and self._whole(versions[v], name, deep):
                return self.spark.read.parquet(self.folder.of(f"{versions[v]['folder']}/{name}"))
        raise OSError(f"{self.path}: version {newest} is damaged and there is no older one")

    # Whole stores

    def info(self) -> dict:
        size = self.folder.size()
        return {"path": self.path, "bytes": size, "size": human_size(size), **self.manifest()}

    def export(self, target: str, compress: bool = True) -> str:
        """The published tables as a store of one version; compressed strongly, or not at all."""
        m, out = self.manifest(), Store(self.spark, target)
        if out.folder.exists():
            raise FileExistsError(target)
        out.initialize(m["metadata"])
        codec = ("spark.sql.parquet.compression.codec", "zstd" if compress else "uncompressed")
        before = self.spark.conf.get(codec[0])
        self.spark.conf.set(*codec)
        try:
            out.save(**{name: self.load(name) for name in m["stats"]})
        finally:
            self.spark.conf.set(codec[0], before)
        return target

    @classmethod
    def import_from(cls, spark: SparkSession, archive: str, path: str) -> Store:
        source = cls(spark, archive)
        if not source.folder.exists() or not source.revisions():
            raise FileNotFoundError(archive)
        source.export(path)
        return cls(spark, path)

    def delete(self) -> None:
        self.folder.delete()


def stores(spark: SparkSession, folder: str) -> list[str]:
    top = Folder(spark, folder)
    return [top.of(n) for n in top.names() if any(map(_MANIFEST.fullmatch, Folder(spark, top.of(n)).names()))]


def _now() -> str:
    return datetime.now(timezone.utc).isoformat()


def _merged(a: dict, b: dict) -> dict:
    return {k: _merged(a[k], b[k]) if isinstance(a.get(k), dict) and isinstance(b.get(k), dict) else b.get(k, a.get(k)) for k in {**a, **b}}
