"""Versions of a table of files: a numbered manifest for each, of which readers see exactly one.

A writer puts its files into a folder of its own and then creates the next manifest. A manifest is
created whole or not at all, and only if there is none of its number: of two writers that
started from the same version one gets a ``Conflict``. What a killed writer leaves is a
folder that no manifest lists.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer was first."""


def new_folder(spark: SparkSession) -> str:
    """A new path in the folder that all executors share; one is set under the warehouse only where none is."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


class Store:
    """Small files through Hadoop's file systems, so that any store which Spark reads will do."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._fs, self._conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
        self._store = self._path("").getFileSystem(self._conf)

    def _path(self, name: str) -> Any:
        return self._fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self._store.listStatus(path)) if self._store.exists(path) else []

    def age(self, name: str) -> float:
        """Seconds since a file or folder was changed."""
        return time.time() - self._store.getFileStatus(self._path(name)).getModificationTime() / 1000

    def read(self, name: str) -> str:
        stream = self._store.open(self._path(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Creates a file with its whole content in one step; False if there is one already."""
        draft, target = self._path(f"_drafts/{uuid.uuid4().hex}"), self._path(name)
        out = self._store.create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        self._store.mkdirs(target.getParent())
        try:
            if self._store.getScheme() == "file":  # renaming a local file replaces what is there; a second link does not
                local = lambda p: self.spark._jvm.java.io.File(p.toUri().getPath()).toPath()
                self.spark._jvm.java.nio.file.Files.createLink(local(target), local(draft))
            else:
                none = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE
                options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
                options[0] = none
                self._fs.FileContext.getFileContext(draft.toUri(), self._conf).rename(draft, target, options)
        except Exception as error:
            if self._store.exists(target):
                return False
            raise error
        finally:
            self._store.delete(draft, False)
        return True

    def delete(self, name: str = "") -> None:
        self._store.delete(self._path(name), True)


class Versions:
    """The manifests of a table under ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.store = Store(spark, root)

    def numbers(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self.store.names("_versions") if n.endswith(".json")]

    def read(self, number: int | None = None) -> tuple[int, dict[str, Any]]:
        """The manifest of a version, by default the last; (0, {}) where there is none yet."""
        if number is None:
            number = max(self.numbers(), default=0)
        return (number, json.loads(self.store.read(self._name(number)))) if number else (0, {})

    def commit(self, base: int, manifest: dict[str, Any]) -> int:
        """Makes the manifest the version after ``base``."""
        if not self.store.create(self._name(base + 1), json.dumps(manifest, sort_keys=True)):
            raise Conflict(f"version {base + 1} is there already")
        return base + 1

    def change(self, changed: Callable[[dict[str, Any]], dict[str, Any]], attempts: int = 20) -> dict[str, Any]:
        """Commits what ``changed`` makes of the last manifest, starting again where another writer was first; the manifest."""
        for attempt in range(attempts):
            base, manifest = self.read()
            manifest = changed(manifest)
            try:
                self.commit(base, manifest)
                return manifest
            except Conflict:
                if attempt == attempts - 1:
                    raise
        raise ValueError("no attempt")

    @staticmethod
    def _name(number: int) -> str:
        return f"_versions/{number:012d}.json"

    def clear(self, folders: set[str], keep: int = 1, older_than: float = 86_400.0) -> list[str]:
        """Deletes folders under ``data`` that are not among ``folders``, those in use, if no writer can still be at them; and all but the last manifests."""
        gone = [f for f in self.store.names("data") if f not in folders and self.store.age(f"data/{f}") >= older_than]
        for number in self.numbers()[:-keep]:
            self.store.delete(self._name(number))
        for folder in gone:
            self.store.delete(f"data/{folder}")
        return gone
