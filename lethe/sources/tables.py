"""Versioned Parquet tables with a manifest; old versions of shreddable tables are deleted.

The manifest names the current files of each table.  A change writes new files, swaps the manifest
by a rename, and only then deletes files that it no longer names: keys that were shredded are gone.
New files of a change that fails are deleted too; ``sweep`` deletes those that a killed driver left.
A change is refused if the manifest isn't the one that was read: two writers can't undo each other.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "recipes": "recipe_id long, subject string, snapshot_id string, path string, chunk_ids array<string>, file_class string, n_bytes long",
    "chunk_log": "chunk_id string, payload binary, n_bytes long, file_class string",
    "recipe_flags": "recipe_id long, erased boolean, unrestorable boolean",
    "fp_index": "fp string, file_class string, chunk_id string",
    "wraps": "chunk_id string, subject string, wrapped binary",
    "subject_keys": "subject string, key binary",
    "holds": "hold_id string, subject string, snapshot_id string, path string, hold_seq long, released_seq long",
    "pending": "subject string, requested_seq long",
    "copyouts": "recipe_id long, subject string, snapshot_id string, path string, chunk_ids array<string>",
    "windows": "subject string, blocked boolean, holds array<string>, at_seq long, ended_seq long",
}


class Tables:
    """Tables below one folder, any that Hadoop's file systems reach."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.manifest: dict[str, list[str]] = {name: [] for name in SCHEMAS}
        self.state: dict = {}
        self._staged: list[str] = []
        if found := self._current():
            self.manifest |= found["tables"]
            self.state = found["state"]

    def _current(self) -> dict:
        if not self._fs.exists(self._path(f"{self.root}/manifest.json")):
            return {}
        return json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.root}/manifest.json").collect()))

    @contextmanager
    def staging(self) -> Iterator[None]:
        """Delete at the end what was staged inside and not committed."""
        self._staged = []
        try:
            yield
        finally:
            named = {f for files in self.manifest.values() for f in files}
            for file in self._staged:
                if file not in named:
                    self._fs.delete(self._path(f"{self.root}/{file}"), True)
            self._staged = []

    def sweep(self) -> None:
        """Delete files that the manifest doesn't name; only while nobody writes."""
        named = {f for files in self.manifest.values() for f in files}
        for name in SCHEMAS:
            if self._fs.exists(folder := self._path(f"{self.root}/{name}")):
                for status in self._fs.listStatus(folder):
                    if f"{name}/{status.getPath().getName()}" not in named:
                        self._fs.delete(status.getPath(), True)

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def read(self, name: str) -> DataFrame:
        reader = self.spark.read.schema(SCHEMAS[name])
        files = [f"{self.root}/{f}" for f in self.manifest[name]]
        return reader.parquet(*files) if files else self.spark.createDataFrame([], SCHEMAS[name])

    def read_file(self, name: str, file: str) -> DataFrame:
        """A staged file of a table."""
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{file}")

    def stage(self, name: str, df: DataFrame) -> str:
        """Write new files of a table; ``commit`` makes them current."""
        file = f"{name}/{uuid.uuid4().hex}"
        columns = [c.split()[0] for c in SCHEMAS[name].split(", ")]
        self._staged.append(file)
        df.select(*columns).write.parquet(f"{self.root}/{file}")
        return file

    def commit(self, *, append: dict[str, str] | None = None, replace: dict[str, str] | None = None, state: dict | None = None) -> None:
        """Swap the manifest, then delete what was replaced."""
        new = {k: list(v) for k, v in self.manifest.items()}
        for name, file in (append or {}).items():
            new[name].append(file)
        for name, file in (replace or {}).items():
            new[name] = [file]
        version = self.state.get("version", 0)
        if (self._current().get("state") or {}).get("version", 0) != version:
            raise RuntimeError("another writer has changed the store; open it anew")
        state = self.state | (state or {}) | {"version": version + 1}
        temporary, final = self._path(f"{self.root}/.manifest-{uuid.uuid4().hex}"), self._path(f"{self.root}/manifest.json")
        out = self._fs.create(temporary, True)
        out.write(bytearray(json.dumps({"tables": new, "state": state}).encode()))
        out.close()
        options = self._jvm.org.apache.hadoop.fs.Options.Rename
        kinds = self.spark.sparkContext._gateway.new_array(options, 1)
        kinds[0] = options.OVERWRITE
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri()).rename(temporary, final, kinds)
        old = {f for files in self.manifest.values() for f in files} - {f for files in new.values() for f in files}
        self.manifest, self.state = new, state
        for file in old:
            self._fs.delete(self._path(f"{self.root}/{file}"), True)
