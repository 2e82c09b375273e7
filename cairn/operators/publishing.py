"""Documents published to several tables at once, deleted from all of them, and read as of a version [A32-A34, G11-G13, L6].

A corpus is a folder: Parquet folders of rows for each table, and a manifest for each version that names the folders which
belong to it. A change stages its rows first, in as many Spark writes as it has tables, and is then made by one file, the
next manifest. If a write fails, its folders go and the version before stands; readers never see a part of a change. Two
writers that began from one version cannot both make the next: the later one's manifest is there already, and it gets a
Conflict. That rests on the file system's creating a file only if it is absent, as HDFS and local ones do.

Rows carry the version that wrote them. A deletion is a folder of tombstones (key, version), written before anything else
of its change; a scan leaves out the rows of a key that are older than its tombstone, by an anti-join on the key, in which a
key with many rows is spread like any other. Publishing a key again deletes what there was of it in the same change.
compact() writes what is alive anew; the manifest after it has no tombstones.

Cases: a null key is published and cannot be deleted; repeated keys in a change are all kept; a key published and deleted in
one change stays; rows of an empty change make a version all the same; tables keep the columns they were first written with
(a missing one is null, another one an error).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.sources.shared import filesystem

VERSION = "written_in"
_TOMBSTONES = "tombstones"


class Conflict(RuntimeError):
    """Another change came first."""


class Corpus:
    def __init__(self, spark: SparkSession, path: str, tables: dict[str, str], key: str = "doc_id"):
        """tables: name -> columns as DDL; all have the key."""
        self.spark, self.path, self.tables, self.key = spark, path.rstrip("/"), tables, key

    # --- manifests ------------------------------------------------------------------------------------------------------
    def version(self) -> int:
        """The newest version, 0 before the first change."""
        fs, p = filesystem(self.spark, f"{self.path}/manifests")
        return max((int(f.getPath().getName().split(".")[0]) for f in fs.listStatus(p)), default=0) if fs.exists(p) else 0

    def manifest(self, version: int | None = None) -> dict[str, list[str]]:
        version = self.version() if version is None else version
        if not version:
            return {}
        text = self.spark.read.text(self._manifest(version), wholetext=True).first()[0]
        return json.loads(text)

    def _manifest(self, version: int) -> str:
        return f"{self.path}/manifests/{version:012d}.json"

    def _commit(self, before: int, parts: dict[str, list[str]]) -> int:
        fs, p = filesystem(self.spark, self._manifest(before + 1))
        if self.version() != before:
            raise Conflict(f"version {before} is no longer the newest")
        try:
            out = fs.create(p, False)
        except Exception as error:  # whatever the file system calls a file that is there
            if fs.exists(p):
                raise Conflict(f"version {before + 1} is there already") from error
            raise
        out.write(bytearray(json.dumps(parts, sort_keys=True).encode()))
        out.close()
        return before + 1

    # --- reading --------------------------------------------------------------------------------------------------------
    def _rows(self, table: str, parts: list[str]) -> DataFrame:
        schema = f"{self.tables[table]}, {VERSION} bigint" if table != _TOMBSTONES else f"key string, {VERSION} bigint"
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/rows/{p}" for p in parts])

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """A table's live rows at a version (none: the newest), with the version that wrote each."""
        manifest = self.manifest(version)
        rows = self._rows(table, manifest.get(table, []))
        if not manifest.get(_TOMBSTONES):
            return rows
        gone = self._rows(_TOMBSTONES, manifest[_TOMBSTONES]).groupBy("key").agg(F.max(VERSION).alias("gone_in"))
        return rows.join(gone, (F.col(self.key).cast("string") == F.col("key")) & (F.col(VERSION) < F.col("gone_in")), "left_anti")

    # --- changes --------------------------------------------------------------------------------------------------------
    def _change(self, before: int, write: Callable[[Callable[[str, DataFrame], None]], None], keep: bool) -> int:
        """Stages what write() gives and makes the next version of it, beside the parts of the last if keep."""
        manifest = self.manifest(before) if keep else {}
        tag, staged = f"{before + 1:012d}-{uuid.uuid4().hex[:12]}", []

        def stage(table: str, rows: DataFrame) -> None:
            staged.append((table, f"{table}/{tag}"))
            rows.write.parquet(f"{self.path}/rows/{table}/{tag}")

        try:
            write(stage)
            parts = {t: list(p) for t, p in manifest.items()}
            for table, part in staged:
                parts.setdefault(table, []).append(part)
            return self._commit(before, parts)
        except BaseException:
            for _, part in staged:
                fs, p = filesystem(self.spark, f"{self.path}/rows/{part}")
                fs.delete(p, True)
            raise

    def _tombstones(self, keys: DataFrame, version: int) -> DataFrame:
        return keys.select(F.col(self.key).cast("string").alias("key")).where("key IS NOT NULL").distinct().withColumn(VERSION, F.lit(version).cast("long"))

    def publish(self, rows: dict[str, DataFrame], before: int | None = None) -> int:
        """The next version with these rows, in place of what there was of the first table's keys. before: the version that
        the rows were made from; the newest if none is given."""
        before = self.version() if before is None else before

        def write(stage: Callable[[str, DataFrame], None]) -> None:
            if before:
                stage(_TOMBSTONES, self._tombstones(next(iter(rows.values())), before + 1))
            for table, new in rows.items():
                fields = self.spark.createDataFrame([], self.tables[table]).schema
                unknown = set(new.columns) - set(fields.names)
                if unknown:
                    raise ValueError(f"{table} has no column {', '.join(sorted(unknown))}")
                typed = [(F.col(f.name) if f.name in new.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]
                stage(table, new.select(*typed, F.lit(before + 1).cast("long").alias(VERSION)))

        return self._change(before, write, keep=True)

    def delete(self, keys: DataFrame, before: int | None = None) -> int:
        """The next version without these keys, in all tables."""
        before = self.version() if before is None else before
        return self._change(before, lambda stage: stage(_TOMBSTONES, self._tombstones(keys, before + 1)), keep=True)

    def compact(self) -> int:
        """The next version: the same rows, written anew, without the deleted ones and their tombstones."""
        before = self.version()
        return self._change(before, lambda stage: [stage(t, self.read(t, before)) for t in self.tables], keep=False)

    def vacuum(self, keep: int = 1) -> list[str]:
        """Deletes manifests but the newest ones and all folders that none of these names; no change may be under way."""
        newest = self.version()
        held = {p for v in range(max(1, newest - keep + 1), newest + 1) for parts in self.manifest(v).values() for p in parts}
        fs, top = filesystem(self.spark, f"{self.path}/rows")
        gone = []
        for table in fs.listStatus(top) if fs.exists(top) else []:
            for part in fs.listStatus(table.getPath()):
                name = f"{table.getPath().getName()}/{part.getPath().getName()}"
                if name not in held:
                    fs.delete(part.getPath(), True)
                    gone.append(name)
        for version in range(1, newest - keep + 1):
            fs.delete(filesystem(self.spark, self._manifest(version))[1], False)
        return sorted(gone)
